import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflux.llm import language_id, quality, toxicity
from folioflux.llm.labels import fetch_sample
from folioflux.llm.rows import block_of

BASE = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return {n: spark.read.parquet(f"{BASE}/{n}.parquet") for n in ("documents", "labels")}


def odd_rows(spark):
    return spark.createDataFrame([(1, None, "en", 0.5), (2, "", "en", 0.5), (3, "123 !!", "en", 0.5), (None, "The idiot and the of", None, 0.5), (4, "word " * 60_000, "xx", 0.5), (4, "word " * 60_000, "xx", 0.5)], "doc_id long, text string, lang string, score double")


def test_held_out_language(spark, tables):
    model = language_id.train_model(tables["documents"])
    got = language_id.predict_languages(tables["documents"], model).join(tables["documents"].select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.99 and got.score.between(0, 1).all()
    assert abs(model.weights).sum() > 0 and (model.weights == 0).mean() > 0.3  # L1 leaves many buckets at nought
    rows = language_id.predict_languages(odd_rows(spark), model).collect()
    assert [(r.doc_id, r.lang_pred, r.score) for r in rows[:3]] == [(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)]
    assert len(rows) == 6 and language_id.predict_languages(odd_rows(spark).limit(0), model).count() == 0


def test_nothing_to_learn_from(spark):
    rows = odd_rows(spark)
    assert {r.lang_pred for r in language_id.op3_languages(rows.limit(2)).collect()} == {"und"}
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for op in (toxicity.op4_scores, quality.op8_scores):
        got = op(rows, none).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
        assert op(rows.limit(0), none).count() == 0


def test_held_out_toxicity(tables):
    got = toxicity.op4_scores(tables["documents"], tables["labels"]).where("held_out").join(tables["labels"], "doc_id").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.97
    assert ((got.predicted == 1) & (got.toxic == 0)).mean() < 0.01


def test_held_out_quality(tables):
    got = quality.op8_scores(tables["documents"], tables["labels"]).where("held_out").join(tables["labels"], "doc_id").toPandas()
    assert (got.predicted == got.quality).mean() > 0.98
    assert ((got.predicted == 0) & (got.quality == 1)).mean() < 0.01


def test_clauses_are_scored_not_words():
    g = toxicity.fit([], [])
    weight = g.raw
    assert weight("A nice day. You idiot!") > weight("The word idiot.") > 0
    assert weight("You are not an idiot") < weight("You are an idiot")
    assert weight('She said "idiot"') < weight("idiot")
    assert weight("I will kill you") > 0 and weight("they kill time") >= 0 and weight("kill the process") == 0
    assert weight("nothing here") == 0 == weight("")


def test_chunks_cover_the_text():
    net = quality.ByteNet.fresh()
    rng = np.random.default_rng(0)
    text = rng.integers(32, 120, 300_001).astype(np.uint8)
    whole, quality.CHUNK = quality.CHUNK, 1 << 20
    try:
        want = net.pooled(text, net.tables())
    finally:
        quality.CHUNK = whole
    assert np.allclose(net.pooled(text, net.tables()), want, atol=1e-4)


def test_echo_hears_repeats():
    said = quality.echo(np.frombuffer(b"abcde " * 10 + b"the quick brown fox jumps over it", np.uint8))
    assert said[30:60].min() == 1.0 and said[-5:].max() < 1.0


def test_language_scores_of_empty_block():
    model = language_id.LanguageModel(["a"], np.zeros((language_id.BUCKETS, 1), np.float32), np.zeros(1))
    assert model.predict(block_of([""]))[0] == ["und"]


def test_samples_are_bounded_whatever_repeats(spark):
    rows = [(k, f"text {k}", "a" if k % 2 else "b") for k in range(60)] + [(100, "again " * 3, "a")] * 3000 + [(101, "x" * 200, "a"), (102, "two labels", "a"), (102, "two labels", "b"), (None, "no id", "a"), (103, None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    texts, known = fetch_sample(docs, None, 10_000, 50, F.lit(True))
    assert len(texts) == len(known) == 60 and set(texts) == {f"text {k}" for k in range(60)}
    labels = docs.groupBy("doc_id").agg(F.min("label").alias("label")).where("doc_id <> 102")
    assert fetch_sample(docs, labels, 10_000, 50, F.lit(True)) == (texts, known)
