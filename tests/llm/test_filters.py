"""Quality rules and URL filters on small fixtures."""
import re

import pytest

from cohortia.llm import quality_rules as qr
from cohortia.llm import url_filter as uf

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, host int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 1) for i, t, s in rows], SCHEMA)


def words(n, tag="w"):
    return " ".join(f"{tag}{k}" for k in range(n))


def brute(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = [tuple(ws[k:k + 5]) for k in range(len(ws) - 4)]
    covered = {k + j for k, r in enumerate(runs) if runs.count(r) > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {"n_words": len(ws), "word_chars": sum(map(len, ws)),
            "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def test_measures_match_brute_force(spark):
    texts = [None, "", " \t\n", "one", words(30), "a b c d e f a b c d e", "x " * 40, "ä#*ü\x0bé|\n\nä#*ü\n",
             "l1\nl2\nl1\nl1\n \n \n", words(20000), "a b c d e a b c d e a b c d e z", "\x1ca b\x85c"]
    got = {r["id"]: r for r in qr.measure(docs(spark, [(i, t, "h") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        want = brute(t) if len(t or "") < 50000 else {"n_words": 20000, "n_repeat_words": 0}
        assert {k: got[i][k] for k in want} == want, t


def test_bad_hosts_lose_their_documents_and_clean_ones_stay(spark):
    good = [(i, words(30, f"g{i}x"), "good") for i in range(60)]
    # 90 of 100 documents of the bad host repeat themselves
    bad = [(100 + i, "a b c d e " * 10 if i < 90 else words(30, f"b{i}x"), "bad") for i in range(100)]
    odd = [(900, words(30, "n"), None), (900, words(30, "n"), None), (None, words(30, "m"), "good"),
           (901, None, "good")]
    rows = qr.judge(docs(spark, good + bad + odd)).collect()
    assert len(rows) == len(good + bad + odd)
    kept = {}
    for r in rows:
        kept.setdefault(r["id"], []).append(r["kept"])
    assert all(kept[i] == [True] for i, *_ in good)
    assert all(kept[i] == [False] for i, *_ in bad)
    assert kept[900] == [True, True] and kept[None] == [True] and kept[901] == [False]
    stage = qr.keep_good(docs(spark, good + bad + odd))
    assert stage.columns == docs(spark, good).columns
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in stage.collect()) == sorted([i for i, *_ in good] + [900, 900, -1])


def test_small_bad_host_is_shrunk_toward_the_rest(spark):
    rows = [(i, words(30, f"g{i}x"), f"h{i % 20}") for i in range(400)] + [(999, "short", "tiny")]
    got = {r["id"]: r for r in qr.judge(docs(spark, rows)).collect()}
    assert got[999]["host_ok"] and not got[999]["kept"]


def test_empty_documents(spark):
    assert qr.judge(docs(spark, [])).count() == 0
    assert qr.keep_good(docs(spark, [])).count() == 0


@pytest.mark.parametrize("url, host, path", [
    (None, "", ""), ("", "", ""), ("example.com/a", "", ""), ("http://", "", ""),
    ("HTTP://Ex.COM:80/A?b#c", "ex.com:80", "/A"), ("x://ÄB.com#f", "Äb.com", ""),
    ("a://b://c/d", "b:", "//c/d"), ("https://h?x/y", "h", ""), ("s://h/p#q?r", "h", "/p")])
def test_split_url(spark, url, host, path):
    df = spark.createDataFrame([(url, "z")], "url string, host string")
    assert uf.with_host(df).select("host", "path").first() == (host, path)


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def test_longest_rule_wins_and_reputation_judges_the_rest(spark):
    urls = {1: "http://a.example.net/en/1", 2: "http://a.example.net/de/1", 3: "http://example.com/de/",
            4: "http://notexample.com/de/", 5: "https://x.org/fr/q", 6: "http://net", 7: None,
            8: "http://netx.com/"}
    n = 50
    bad = {100 + k: f"http://bad.site.biz/{k}" for k in range(n)}
    fine = {200 + k: f"http://ok{k % 5}.site.com/{k}" for k in range(n)}
    rows = {**urls, **bad, **fine, 400: "http://new.site.biz/z", 401: "http://new.site.com/z"}
    pages = spark.createDataFrame([(k, v, "r") for k, v in rows.items()], "page_id bigint, url string, rule string")
    labels = spark.createDataFrame([(k, True) for k in bad] + [(k, False) for k in fine] + [(None, True), (8, None)],
                                   "id bigint, bad boolean")
    got = {r["id"]: r for r in uf.filter_urls(pages, labels, RULES).collect()}
    assert len(got) == len(rows)
    assert [got[k]["rule"] for k in range(1, 9)] == [
        "example.net/en/", "net/", "example.com/de/", None, "org/fr/", None, None, None]
    assert [got[k]["verdict"] for k in (1, 2, 3, 5)] == ["allow", "block", "block", "allow"]
    assert all(got[k]["verdict"] == "block" for k in bad)
    assert all(got[k]["verdict"] == "allow" for k in fine)
    assert got[400]["bad_rate"] > got[401]["bad_rate"]  # an unseen host takes its domain's rate


def test_urls_without_labels_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c"), (1, "http://a.b/c")], "page_id bigint, url string")
    none = spark.createDataFrame([], "id bigint, bad boolean")
    assert [r["verdict"] for r in uf.filter_urls(pages, none, RULES).collect()] == ["allow", "allow"]
    assert uf.filter_urls(pages.limit(0), none, RULES).count() == 0


def test_two_label_suffix(spark):
    df = spark.createDataFrame([("a.b.co.uk",), ("b.co.uk",), ("x.y.com",), ("localhost",)], "host string")
    got = df.select(uf.registered_domain(df.host), uf.suffix(df.host)).collect()
    assert [tuple(r) for r in got] == [("b.co.uk", "co.uk"), ("b.co.uk", "co.uk"), ("y.com", "com"),
                                       ("localhost", "localhost")]
