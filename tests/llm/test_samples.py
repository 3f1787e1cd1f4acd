"""The bounded samples that models learn from: no class or language is lost to repeats, lengths or partitions."""

from pyspark.sql import functions as F

from shoebox.llm import common, langid, toxicity


def test_a_hot_row_costs_no_language_its_rows(spark):
    """xx has one row 20,000 times and 20 others, sv long texts only, en short ones: all are learnt, and the repeated row once."""
    hot = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("xa xb xc").alias("text"), F.lit("xx").alias("lang"))
    rows = [(10 + i, f"xa{'q' * i} xb xc", "xx") for i in range(20)] + [(100 + i, f"hej{i} " * 9000, "sv") for i in range(5)] + [(200 + i, f"hello {'e' * i}", "en") for i in range(50)]
    docs = hot.union(spark.createDataFrame(rows, "doc_id long, text string, lang string")).repartition(7)
    cfg = langid.LanguageConfig()
    got = langid.training_rows(docs, F.lit(True), "text", "lang", "doc_id", cfg)
    assert {lang: sum(x == lang for _, x in got) for lang in ("xx", "sv", "en")} == {"xx": 21, "sv": 5, "en": 50}
    assert max(len(text) for text, _ in got) == cfg.max_bytes


def test_long_texts_cost_no_class_its_rows(spark):
    """Clean texts are all long, toxic ones short, and most labels belong to no text: both classes are learnt."""
    rows = [(i, "calm words here " * 3000) for i in range(0, 60, 2)] + [(i, "you vile fool") for i in range(1, 60, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    cfg = toxicity.ToxicityConfig(max_rows=25)
    got = toxicity.training_rows(docs, labels, F.lit(True), "text", "doc_id", cfg)
    assert [sum(r["toxic"] == y for r in got) for y in (0, 1)] == [25, 25]
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, labels, F.lit(True), cfg=cfg).collect()}
    assert all((scores[i] >= 0.7) == (i % 2 == 1) for i in scores)


def test_a_sample_is_the_same_however_rows_are_dealt(spark):
    rows = spark.range(20_000).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    first = common.bounded_sample(rows.repartition(3), 20_000, 500)
    second = common.bounded_sample(rows.repartition(40), 20_000, 500)
    assert first.num_rows == 500 and first.to_pylist() == second.to_pylist()
    assert common.bounded_sample(rows.limit(10), 10, 500).num_rows == 10
    assert common.bounded_sample(rows.limit(0), 0, 500).num_rows == 0
