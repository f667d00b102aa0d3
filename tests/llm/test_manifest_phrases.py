"""Merkle manifest and phrase collocations against plain versions."""
import collections
import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from cohortia.llm import collocations as co
from cohortia.llm import merkle as mk

DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(level, fanout):
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i:i + fanout])
                       for i in range(0, len(levels[-1]), fanout)])
    return levels


def path(levels, i, fanout):
    out = []
    for level in levels[:-1]:
        first = i // fanout * fanout
        out.append((level[first:i], level[i + 1:first + fanout]))
        i //= fanout
    return out


def plain_manifest(rows, fanout):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    names = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    leaves = {k: sorted(groups[k], key=lambda x: x[:3]) for k in names}
    trees = {k: tree([x[2] for x in leaves[k]], fanout) for k in names}
    top = tree([trees[k][-1][0] for k in names], fanout) if names else []
    out = []
    for j, k in enumerate(names):
        for i, (_, _, leaf, r) in enumerate(leaves[k]):
            steps = path(trees[k], i, fanout) + path(top, j, fanout)
            seen = leaf
            if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                seen = leaf_of((*r[:3], r[3] + 1, r[4]))
            for before, after in steps:
                seen = digest(*before, seen, *after)
            proof = digest(*[s for before, after in steps for s in before + after])
            out.append((r[0], leaf, trees[k][-1][0], top[-1][0], proof, seen, seen == top[-1][0]))
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v if v is not None else 0) for v in r))


ODD = ([(None, "s", None, 1, "x"), (None, "s", None, 1, "x"), (3, None, "en", None, None),
        (3, None, "en", None, ""), (7, "q", "", 5, "ä"), (7, "q", "", 5, "ä"), (7, "q", "", 6, "ä"),
        (14, "q", "en", 6, "ä" * 200_000), (21, "é", "zz", 0, "")]
       + [(i % 5, "x", "hot", 3, "t") for i in range(40)])


@pytest.mark.parametrize("fanout", [2, 3])
@pytest.mark.parametrize("rows", [ODD, ODD[:1], []], ids=["odd", "one", "none"])
def test_manifest_equals_plain_version(spark, rows, fanout):
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    docs = docs.withColumns({"tree": F.lit(1), "digest": F.lit("x"), "idx": F.lit(0)})
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    got = mk.manifest(docs, COLUMNS, fanout=fanout, suspect={
        "n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    got = got.select("id", "leaf", "subroot", "root", F.sha2(mk.siblings(F.col("steps")), 256),
                     "folded_root", "verified").collect()
    assert in_order(map(tuple, got)) == in_order(plain_manifest(rows, fanout))


def test_manifest_of_given_documents_verifies_untampered_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = mk.manifest(docs, COLUMNS).agg(
        F.count(F.lit(1)), F.count_if("verified"), F.countDistinct("root")).first()
    assert tuple(got) == (docs.count(), docs.count(), 1)


def plain_phrases(rows, min_count, first):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, total = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(ws)
            for n in range(1, 6):
                f[lang].update(tuple(ws[i:i + n]) for i in range(len(ws) - n + 1))
    out = []
    for lang, every in f.items():
        common = {p: a for p, a in every.items() if a >= min_count}
        around = collections.Counter()
        for p, a in common.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    around[p[i:i + m]] = max(around[p[i:i + m]], a)
        found = []
        for p, a in common.items():
            if len(p) > 1 and around[p] < a:
                score, k = min((1000 * a * total[lang] // (every[p[:k]] * every[p[k:]]), k)
                               for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), every[p[:k]], every[p[k:]]))
        out += [(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], total[lang], -x[0])
                for i, x in enumerate(sorted(found)[:first])]
    return sorted(out)


def phrase_rows():
    hot = [("en", "of the cat. Of the\tdog, of the new york times and of the old \x0b york ; times")] * 30
    return hot + [
        (None, None), (None, "a b a b. A B"), ("und", "a b, a b"), ("fr", ""), ("fr", " . , ; "),
        ("fr", "É É é. É É \x00 \x1c x \x00 \x1c x"), ("x", "tie one. tie two. one tie. two tie"),
        ("long", "so it goes on " * 60_000), ("long", "so it goes. " * 20_000)]


@pytest.mark.parametrize("bits", [64, 6], ids=["fingerprints", "colliding fingerprints"])
@pytest.mark.parametrize("min_count, first", [(2, 2000), (1, 3)])
def test_phrases_equal_plain_version(spark, bits, min_count, first):
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4).withColumns(
        {"phrase": F.lit(1), "block": F.lit("x"), "n": F.lit(None).cast("int")})
    got = co.collocations(docs, min_count, first, block_words=50, bits=bits).collect()
    assert sorted(map(tuple, got)) == plain_phrases(rows, min_count, first)


def test_phrases_of_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("lang", "text").collect()]
    want = plain_phrases(rows, 20, 2000)
    # small blocks: most phrases are met in several of them
    got = co.collocations(docs, 20, block_words=5_000).collect()
    assert len(want) > 500 and sorted(map(tuple, got)) == want


def test_phrases_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert co.collocations(docs).collect() == []


def test_scores_pass_64_bits(spark):
    scored = spark.createDataFrame(
        [("en", f"p{i % 50:02d} q{i}", 100 + i % 3, 200, 300, 10 ** 12, i // 7) for i in range(400)],
        "lang string, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint")
    want = sorted(scored.collect(), key=lambda r: (-r.score, -r.a, r.phrase))[:4]
    got = co.top_by_language(scored, 4).orderBy("rank").collect()
    assert [r.phrase for r in got] == [r.phrase for r in want]
    big = spark.sql("select cast(9e12 as decimal(20,0)) __a, cast(9e13 as decimal(20,0)) __n, "
                    "cast(9e12 as decimal(20,0)) __l, cast(7e13 as decimal(20,0)) __r")
    assert big.selectExpr("(1000 * __a * __n) div (__l * __r)").first()[0] == 1000 * 9 * 10 ** 13 // (7 * 10 ** 13)
