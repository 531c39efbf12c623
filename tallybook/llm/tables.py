"""Small helpers the operators share: stored intermediate tables and per-batch maps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tallybook.session import shuffles_dropped


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only a local session may go without one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tallybook-"))
        folder = context.getCheckpointDir()
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage and is computed once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tallybook-llm/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_columns_in_arrow(
    df: DataFrame,
    inputs: list[Column],
    new: T.StructType,
    worker: Callable[[], Callable[[list[pa.Array]], list[list | pa.Array]]],
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """``df`` with new columns computed batch by batch from the columns ``inputs``.

    ``worker`` is called once per task and gives the function that makes the new columns.
    Columns in ``drop``, and those with the name of a new one, are left out.
    """
    names = [f.name for f in df.schema if f.name not in new.names and f.name not in drop]
    schema = T.StructType([*[df.schema[n] for n in names], *new.fields])
    kinds = [to_arrow_type(f.dataType) for f in new.fields]
    n = len(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = None
        for batch in batches:
            make = make or worker()
            columns = make(batch.columns[:n])
            made = [
                c if isinstance(c, pa.Array) else pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[n:], *made], names=schema.names)

    given = [c.alias(f"__input{i}") for i, c in enumerate(inputs)]
    return df.select(*given, *[df[f"`{name}`"] for name in names]).mapInArrow(run, schema)

