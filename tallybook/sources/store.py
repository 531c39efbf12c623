"""Files of a shared store, handled by the driver: creating one exclusively, and removing folders.

All of it goes through the Hadoop file systems Spark reads with.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _system(spark: SparkSession, path: str):
    """The path as the store's own object, and its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists_already(error: Py4JJavaError) -> bool:
    return "FileAlreadyExists" in error.java_exception.getClass().getName()


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with this text unless there is one; whether it was created.

    Of any number of callers one succeeds, and readers see the whole text or no file. The text is
    written beside it under a name readers pass over, and then given the name: by a hard link on a
    local disk, elsewhere by a rename that does not overwrite, which the store must do in one
    step, as HDFS does.
    """
    jvm = spark._jvm
    target, system = _system(spark, path)
    written = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{uuid.uuid4().hex}")
    out = system.create(written, False)
    out.write(bytearray(text, "utf-8"))
    out.close()
    try:
        if system.getScheme() == "file":
            files = jvm.java.nio.file.Files
            files.createLink(*(jvm.java.io.File(p.toUri().getPath()).toPath() for p in (target, written)))
        else:
            rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
            options = spark.sparkContext._gateway.new_array(rename, 1)
            options[0] = rename.NONE
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
            context.rename(system.makeQualified(written), system.makeQualified(target), options)
    except Py4JJavaError as error:
        if _exists_already(error):
            return False
        raise
    finally:
        system.delete(written, False)
    return True


def remove(spark: SparkSession, folder: str) -> None:
    """Remove a folder this library made, with all that is in it."""
    where, system = _system(spark, folder)
    system.delete(where, True)
