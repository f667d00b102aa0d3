"""Quality classifier: held-out accuracy, scoring against the plain formula,
odd rows."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortia.llm import quality_model as qm
from cohortia.llm.catalog import op12_quality_classifier


def plain_features(text):
    """Buckets of a text, one by one, from the definition."""
    out, tokens = [], text.split()
    for w in tokens:
        one = qm.Words(qm.BUCKETS)
        one.codes(w), one.update()
        marked = f"<{w}>"
        grams = sum(max(len(marked) - n + 1, 0) for n in qm.CHAR_GRAMS)
        assert len(one.features) == 1 + grams
        out += one.features.tolist()
    for a, b in zip(tokens, tokens[1:]):
        two = qm.Words(qm.BUCKETS)
        codes = two.codes(f"{a} {b}")
        two.update()
        out += two.pairs(codes[:1], codes[1:]).tolist()
    return out


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(3)
    return qm.Model(rng.normal(size=qm.BUCKETS), 0.4)


def test_scores_equal_plain_sums(spark, model):
    texts = [None, "", " \n\t ", "a", "one two two two \x00 three", "É é ß 漢字 漢字 x" * 3,
             "so it goes on " * 50, "z" * 3000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "a"), (3, "a")],
                                 "doc_id bigint, text string").withColumns(
        {"id": F.lit("x"), "score": F.lit(7), "label": F.lit(None).cast("int")})
    got = qm.score(docs, model).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        found = plain_features((texts[r["id"]] if r["id"] is not None else "a") or "")
        z = model.bias + (np.mean(model.weights[found]) if found else 0)
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-12)


def test_repeated_neighbours_share_a_feature():
    words = qm.Words(qm.BUCKETS)
    codes = words.codes("cat cat dog dog cat dog")
    words.update()
    pairs = words.pairs(codes[:-1], codes[1:])
    assert pairs[0] == pairs[2] and len(set(pairs.tolist())) == 3


def test_bags_count_every_occurrence():
    text = "one two two <x> one " * 5
    words = qm.Words(qm.BUCKETS)
    codes = words.codes(text)
    words.update()
    buckets, counts = words.bag(codes)
    every = plain_features(text)
    assert dict(zip(buckets.tolist(), counts.tolist())) == {
        b: every.count(b) for b in set(every)}


def labelled(spark):
    good = ["the cat sat on a mat %d", "a quiet walk in the park %d"]
    bad = ["BUY!! NOW!! %d", "$$$ win win win %d ###"]
    rows = [(i, (good if i % 3 else bad)[i % 2] % i, int(i % 3 > 0)) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id bigint, quality int")
    return docs, labels


def test_training_separates_and_repeats(spark):
    docs, labels = labelled(spark)
    train = labels.filter("doc_id < 200")
    odd = spark.createDataFrame([(None, 1), (1, None), (2, 1), (2, 0), (3, 9), (999, 0)],
                                "doc_id bigint, quality int")
    model = qm.train(docs.unionByName(docs), train.unionByName(odd))
    again = qm.train(docs.repartition(5), train.unionByName(odd).repartition(2))
    assert np.array_equal(model.weights, again.weights) and model.bias == again.bias
    got = qm.score(docs, model).join(labels, F.col("id") == F.col("doc_id")).filter("doc_id >= 200")
    assert got.filter("(score >= 0.7) <> (quality = 1)").count() == 0 and got.count() == 100


def test_bounds_of_the_sample(spark):
    docs, labels = labelled(spark)
    some = qm.train(docs, labels, rows=20)
    assert np.abs(some.weights).sum() > 0
    assert not qm.train(docs, labels, entries=0).weights.any()


@pytest.mark.parametrize("kept", ["quality = 1", "false"])
def test_without_both_labels_scores_are_even(spark, kept):
    docs, labels = labelled(spark)
    got = qm.score(docs, qm.train(docs, labels.filter(kept))).select("score").distinct().collect()
    assert [r.score for r in got] == [0.5]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert qm.score(docs, qm.train(docs, labels)).collect() == []


def test_held_out_accuracy_on_given_documents(spark):
    sf_dir = "/root/testdata/sf0.1"
    got = op12_quality_classifier(spark, sf_dir).join(
        spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").filter("held_out")
    r = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("right"),
                F.avg(F.when(F.col("quality") == 1, F.col("predicted"))).alias("kept"),
                F.avg(F.when(F.col("quality") == 0, F.col("predicted"))).alias("missed"),
                F.count(F.lit(1)).alias("n")).first()
    assert r.n > 900 and r.right > 0.98 and r.kept > 0.99 and r.missed < 0.1
