import zlib

from pyspark.sql import functions as F

from tallybook.llm import langid

EN = "the quick brown fox jumps over the lazy dog and then it runs through the green forest with the others"
DE = "der schnelle braune fuchs springt über den faulen hund und läuft dann durch den grünen wald zu den anderen"
FR = "le renard brun et rapide saute par-dessus le chien paresseux puis il court dans la forêt avec les autres"


def labelled(spark, n=40):
    rows = []
    for i in range(n):
        for k, (lang, text) in enumerate((("en", EN), ("de", DE), ("fr", FR))):
            words = text.split()
            rows.append((3 * i + k, " ".join(words[j % len(words)] for j in range(i, i + 12)), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_rows_follow_the_checksum(spark):
    rows = spark.range(200).select(F.col("id").alias("doc_id"))
    for r in rows.withColumn("h", langid.held_out(F.col("doc_id"))).collect():
        assert r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_languages_are_told_apart(spark):
    docs = labelled(spark)
    found = langid.identify(docs).collect()
    assert len(found) == 120
    assert all(r["lang_pred"] == r["lang"] for r in found if r["held_out"])
    assert all(0 <= r["score"] <= 1 for r in found)


def test_real_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs.select("doc_id", "text", "lang"), drop=("text",)).filter("held_out")
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right >= 0.99


def test_labels_and_ids_are_no_inputs_of_a_prediction(spark):
    docs = labelled(spark)
    model = langid.fit(docs)
    changed = docs.withColumn("lang", F.lit("zz")).withColumn("doc_id", -F.col("doc_id"))
    a = {r["text"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, model).collect()}
    b = {r["text"]: (r["lang_pred"], r["score"]) for r in langid.predict(changed, model).collect()}
    assert a == b


def test_edge_rows(spark):
    long = (EN + " ") * 20_000
    rows = [(1000, None, "en"), (1001, "", "en"), (1002, "123 ... ²", "en"), (1003, long, None), (None, DE, "de"),
            (1004, EN, None), (1004, EN, None), (1005, "漢字", None)]
    docs = labelled(spark).union(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    docs = docs.withColumn("score", F.lit("clash")).withColumn("extra", F.lit(1))
    found = langid.identify(docs).filter("doc_id >= 1000 OR doc_id IS NULL").collect()
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    assert [by[i][0] for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert by[1003][0][0] == "en" and by[None][0][0] == "de" and by[1005][0][0] in ("en", "de", "fr")
    assert len(by[1004]) == 2 and by[1004][0] == by[1004][1]


def test_nothing_to_learn_from(spark):
    docs = labelled(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(docs).collect()} == {("und", 0.0)}
    assert langid.identify(docs.limit(0)).collect() == []


def test_slices_of_a_long_text_miss_nothing(monkeypatch):
    text = "äbc dé " * 50
    whole = set(langid.Presence().distinct(text).tolist())
    monkeypatch.setattr(langid, "SLICE", 9)
    assert set(langid.Presence().distinct(text).tolist()) == whole


def test_more_languages_than_the_sample_was_made_for(spark):
    """300 labels, the rarest with two rows; each is told from its own words."""
    rows, at = [], 0
    for k in range(300):
        a, b, c = (chr(0x4E00 + 7 * k + j) for j in range(3))
        for j in range(2 if k >= 200 else 4):
            rows.append((at, f"{a}{b} {c}{a} " * (j + 3), f"l{k}"))
            at += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.predict(docs, langid.fit(docs)).collect()
    assert {r["lang_pred"] for r in found} == {f"l{k}" for k in range(300)}
    assert all(r["lang_pred"] == r["lang"] for r in found)


def test_a_rare_label_is_always_in_the_sample(spark):
    docs = spark.range(3000).selectExpr(
        "id AS doc_id", "CASE WHEN id < 2900 THEN concat('plain words ', id) ELSE concat('žluťoučký kůň ', id) END AS text",
        "CASE WHEN id < 2900 THEN 'a' ELSE 'b' END AS lang",
    )
    for sample in (2, 2400):
        assert langid.fit(docs, sample=sample, landmarks=2).languages == ["a", "b"]
