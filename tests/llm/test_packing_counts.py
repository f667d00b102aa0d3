"""Packing and token counts against plain versions."""
import random
import zlib
from array import array
from collections import Counter, defaultdict

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cohortia.llm import packing, token_count
from cohortia.llm.catalog import packed_digest

BPE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " ", "Hello world", "a <|endoftext|>b  c\n\n d ", "ünï 漢字 don't 1234", "x" * 3000,
         " ".join(f"tok{k}" for k in range(1500)), "a\x1cb \x85 c", "same text", "same text"]


def best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(bins) if r >= n]
        if fits:
            bins[min(fits, key=bins.__getitem__)] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


@settings(max_examples=150, deadline=None)
@given(st.integers(2, 80).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=150))))
def test_plan_is_best_fit_decreasing(case):
    capacity, lengths = case
    placed, bins = Counter(), defaultdict(list)
    for n, low, high, first, offset, per in packing.plan(Counter(lengths), capacity):
        placed[n] += high - low
        for t in range(high - low):
            bins[first + t // per].append((offset + t % per * n, n))
    assert placed == Counter(lengths)
    left = []
    for pieces in bins.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        left.append(capacity - at)
    assert sorted(left) == best_fit(lengths, capacity)


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 5, 7) for i, t in enumerate(texts)],
                                 "doc_id bigint, text string, length int, part int")


def test_packed_pieces(spark):
    library = Tokenizer.from_file(BPE)
    rows = packed_digest(docs(spark, TEXTS)).collect()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    for i, t in enumerate(TEXTS):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, packing.END_ID]
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at)
            assert r["length"] == 1024 or k == 0
            piece = ids[at:at + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(array("I", piece).tobytes())
            at += r["length"]
        assert at == len(ids)
    lengths = [r["length"] for r in rows]
    seqs = defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(seqs) == len(best_fit(lengths, 1024))


def test_sequences_hold_all_ids(spark):
    packed = packing.pack_documents(docs(spark, TEXTS[3:6] * 4), BPE)
    total = sum(len(r["ids"]) // 4 for r in packing.sequences(packed).collect())
    assert total == sum(r["length"] for r in packed.collect())


def test_encoder_gives_the_library_ids(spark):
    library = Tokenizer.from_file(BPE)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for t in [*texts, *(x or "" for x in TEXTS)]:
        assert packing.encode(t, BPE) == array("I", library.encode(t, add_special_tokens=False).ids).tobytes()


def test_long_runs_of_white_space():
    library = Tokenizer.from_file(BPE)
    for t in ("a" + " " * 1_200_000 + "b", "\n" * 1_200_000):
        assert packing.encode(t, BPE) == array("I", library.encode(t, add_special_tokens=False).ids).tobytes()


def test_counts_match_the_library(spark):
    library = Tokenizer.from_file(WORD)
    texts = [*TEXTS, "ΟΔΟΣ ΣΑΣ İx", "don't <|startoftext|>x we'll", "　wide　", "word " * 5000]
    got = {r["id"]: r for r in token_count.count_tokens(docs(spark, texts), WORD, 2048).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (
            n, len((t or "").encode()), n > 2048)


def test_small_batches_change_nothing():
    random.seed(3)
    texts = ["".join(random.choice("ab \nü' <|endoftext|>") for _ in range(200)).encode() for _ in range(20)]
    assert token_count.count_texts(texts, WORD, 17) == token_count.count_texts(texts, WORD)
    for t in texts:
        assert b"".join(token_count.pieces(t, 17)) == t


def test_empty_tables(spark):
    empty = docs(spark, TEXTS[:1]).limit(0)
    assert packed_digest(empty).count() == 0
    assert token_count.count_tokens(empty, WORD, 1).count() == 0
