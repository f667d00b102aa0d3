"""The corpus pipeline: stages, columns, and a brute-force version."""
import random

import corpus_pipeline as cp

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def write(spark, folder, rows, items):
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA).write.parquet(
        f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def prose(rng, sentences):
    return " ".join(" ".join(f"p{rng.randint(0, 10**6)}" for _ in range(9)) + "." for _ in range(sentences))


def test_pipeline_decisions(spark, tmp_path):
    rng = random.Random(1)
    item, passage = prose(rng, 4), prose(rng, 8)
    rows = {i: prose(rng, 30) for i in range(12)}
    rows[3] = rows[1]
    rows[4] = rows[2].replace(" p1", " q1", 1)
    rows[5] = rows[5] + " " + passage
    rows[6] = rows[6] + " " + passage
    rows[7] = rows[7] + " " + item
    rows |= {8: "too short", 9: None, 10: ""}
    table = [(i, t, f"s{i % 3}") for i, t in rows.items()] + [(11, rows[11], "s2"), (None, prose(rng, 5), None)]
    folder = write(spark, tmp_path, table, [(0, item), (1, None)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = []
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, folder)
        if k < len(cp.STAGES) - 1:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        held.append(sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in docs.select("doc_id").distinct().collect()))
    assert held[0] == [-1, 0, 1, 2, 3, 4, 5, 6, 7, 11]
    assert 3 not in held[1] and {-1, 0, 1, 2, 5, 6, 7, 11} <= set(held[1])
    texts = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/{cp.STAGES[2][0]}").collect()}
    assert passage in texts[5]["text"] and passage[:200] not in texts[6]["text"]
    assert texts[0]["text"] == rows[0] and texts[6]["n_chars"] == len(texts[6]["text"])
    assert 7 not in held[3] and set(held[2]) - {7} == set(held[3]) == set(held[4])
    assert sorted(map(tuple, cp.run(spark, folder).select("doc_id", "piece", "length", "ids_crc32").collect()),
                  key=str) == sorted(map(tuple, docs.select("doc_id", "piece", "length", "ids_crc32").collect()), key=str)


def test_empty_pipeline(spark, tmp_path):
    assert cp.run(spark, write(spark, tmp_path, [], [])).count() == 0


def test_stages_take_extra_columns(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, prose(rng, 6), f"s{i}") for i in range(4)]
    folder = write(spark, tmp_path, rows, [(0, prose(rng, 3))])
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr(
        "*", "1 AS fp", "2 AS host", "3 AS item_id", "4 AS run", "5 AS length", "6 AS kept", "7 AS id")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() == 4
    assert cp.STAGES[-1][1](spark, docs, folder).count() >= 4
