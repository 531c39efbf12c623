import pytest
from llm_inputs import SMALL
from pyspark.sql import functions as F
from test_decontam import brute as contaminated
from test_jaccard import brute as similar
from test_line_dedup import brute as without_repeats

import corpus_pipeline
from tallybook.llm import langid

TALK = "the story of the river and the people who live in the valley is told every year by the old men of the town"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with a case for every stage."""
    path = tmp_path_factory.mktemp("corpus")
    item = " ".join(f"question{i}" for i in range(15))
    texts = [f"{TALK} number {i} {'and then some more ' * (i % 5)}part {i * i}" for i in range(40)]
    texts += [texts[3], texts[3].upper(), "12345 !!!", None, item, TALK + "\n" + "l1 a\nl2 b\nl3 c", "z\nl1 a\nl2 b\nl3 c\nend of it"]
    rows = [(i, t, "en" if i % 4 else None, "s", len(t) if t is not None else None) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_match_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    benchmark = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, folder)
        assert out.dtypes == docs.dtypes
        docs = spark.createDataFrame(out.collect(), out.schema)
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        rows = sorted(before.items())
        if name == "language_id":
            expected = {i: t for i, t in rows if t and langid._LETTER.search(t)}
        elif name == "line_dedup":
            expected = {i: t for i, t, _, removed in without_repeats(rows)[0] if not removed or t.strip()}
        elif name == "ngram_jaccard_join":
            expected = {i: before[i] for i, n, c in similar(rows) if n == 0 or i == c}
        else:
            expected = {r[0]: before[r[0]] for r in contaminated(rows, benchmark) if not r[5]}
        assert after == expected, name
        assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    assert 0 < docs.count() < 47


def test_run_packs_what_the_stages_keep(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    packed = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in docs.collect()}


def test_real_tables(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0


def test_near_copies_of_four_fifths_go(spark, documents):
    """Ten spread edits in 500 words leave 446 of 546 five-word shingles shared, but 0.886 of those of three words."""
    words = [f"w{i}" for i in range(500)]
    edited = [f"x{i}" if i % 50 == 25 else w for i, w in enumerate(words)]
    longer = [*words, *[f"y{i}" for i in range(80)]]
    other = [f"x{i}" if i % 40 == 25 else w for i, w in enumerate(words)]  # 12 or 13 edits: below 0.8
    texts = {1: words, 2: edited, 3: longer, 4: [f"z{w}" for w in words], 5: [f"z{w}" for w in other]}
    docs = documents([(i, " ".join(t)) for i, t in texts.items()])
    kept = corpus_pipeline.keep_one_of_similar(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5]


def test_a_corpus_without_labels_keeps_its_documents(spark, documents):
    texts = [TALK, "漢字", "x1", "12 ... ²", "", None, "\n", "\U00010570"]
    docs = documents(list(enumerate(texts))).withColumn("source", F.lit("s"))
    kept = corpus_pipeline.identify_language(spark, docs, "").collect()
    assert sorted((r["doc_id"], r["lang"]) for r in kept) == [(0, None), (1, None), (2, None), (7, None)]


@pytest.fixture
def written(spark, tmp_path, documents):
    """Writes ``documents`` and ``benchmark`` where ``run`` reads them."""

    def write(rows, items):
        documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
        spark.createDataFrame(items, "item_id string, text string, doc_id long").write.parquet(str(tmp_path / "benchmark.parquet"))
        return str(tmp_path)

    return write


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (None, " \n\t"), (3, "12 34")]])
def test_nothing_left(spark, written, rows):
    """Empty tables, and documents without a letter."""
    assert corpus_pipeline.run(spark, written(rows, [])).collect() == []


def test_odd_rows(spark, written):
    """Null ids, repeated rows, long texts and clashing columns pass; an item without text or words hits nothing."""
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}x" for i in range(400)]
    text = " ".join(words)
    rows = [(None, "a text without an id, of some words"), (1, text), (1, text), (2, text), (3, "b" * 300_000), (4, "one two three four five six seven")]
    found = corpus_pipeline.run(spark, written(rows, [("i1", None, 1), ("i2", "", 2), ("i3", "...", 3)]))
    kept = {r["doc_id"]: r["doc_tokens"] for r in found.collect()}
    assert set(kept) == {None, 1, 3, 4}
