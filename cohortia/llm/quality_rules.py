"""Quality rules with host verdicts (native DataFrame code only).

Every document is measured and tested by a few rules; rule failures are added
up by host (``source``); each host's failure rate is shrunk by an empirical
beta prior fitted over all hosts; hosts whose posterior bound passes a limit
lose all their documents.

Edge cases: a null or empty text has zero words and fails the base rules; a
null host has no host evidence, so only the base rules judge it; repeated rows
are measured, counted and returned row by row; an empty table gives an empty
result; further input columns are ignored. Only (id, host, counts) is written
and joined, never the texts, and the host table is pre-aggregated, so a host
with a third of all rows costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written
from .text import SPACE, let, window_hashes, words

MIN_WORDS = 10
REPEAT_WINDOW = 5
MAX_REPEAT_PERCENT = 20
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 30
SYMBOLS = "#*$%&|<>"
# A host is rejected when the lower posterior bound (mean - 2 sd) of one of its
# failure rates exceeds one half.
HOST_LIMIT = 0.5
HOST_SD = 2.0
RULES = ("base", "symbols", "dup_lines")


def _repeated_words(tokens: Column, width: int) -> Column:
    """Words inside ``width``-word windows that occur at least twice."""
    def covered(positions: Column) -> Column:
        gaps = F.transform(positions, lambda p, j: F.least(
            F.lit(width), F.coalesce(F.get(positions, j + 1), p + F.lit(width)) - p))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def repeats(hashes: Column) -> Column:
        def scan(ranked: Column) -> Column:
            same = F.filter(ranked, lambda e, j: (
                F.coalesce(F.get(ranked, j - 1)["h"] == e["h"], F.lit(False))
                | F.coalesce(F.get(ranked, j + 1)["h"] == e["h"], F.lit(False))))
            return let(F.array_sort(F.transform(same, lambda e: e["p"])), covered)
        ordered = F.sort_array(F.transform(hashes, lambda h, p: F.struct(
            h.alias("h"), p.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            let(ordered, scan))
    return let(window_hashes(tokens, width), repeats)


def metrics(text: Column) -> Column:
    """Struct of a text's counts: ``n_words, word_chars, n_symbols, n_lines,
    n_dup_lines, n_repeat_words``."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_lines(tokens: Column, x: Column) -> Column:
        return F.struct(
            F.size(tokens).cast("long").alias("n_words"),
            F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeated_words(tokens, REPEAT_WINDOW).cast("long").alias("n_repeat_words"))
    return let(words(text), lambda w: let(lines, lambda x: of_lines(w, x)))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            host_col: str = "source") -> DataFrame:
    """``id, host`` and the counts of ``metrics`` per document."""
    return docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"),
                       metrics(F.col(text_col).cast("string")).alias("m")).select(
                           "id", "host", "m.*")


def failures(prefix: str = "") -> dict[str, Column]:
    """Failure flag per rule over the columns of ``measure``."""
    def count(name: str) -> Column:
        return F.col(prefix + name)
    return {
        "base": (count("n_words") < MIN_WORDS)
        | (100 * count("n_repeat_words") > MAX_REPEAT_PERCENT * count("n_words")),
        "symbols": 100 * count("n_symbols") > MAX_SYMBOL_PERCENT * count("word_chars"),
        "dup_lines": 100 * count("n_dup_lines") > MAX_DUP_LINE_PERCENT * count("n_lines"),
    }


def host_verdicts(measured: DataFrame) -> DataFrame:
    """Posterior failure rate per (host, rule) and the host's verdict.

    The prior of a rule is the beta distribution whose mean is the pooled rate
    and whose strength follows from the excess of the hosts' rates over
    binomial noise (method of moments): rho = (sum n (r-m)^2 - H m(1-m)) /
    (m(1-m) sum(n-1)), strength = 1/rho - 1, with rho held in [0.0001, 0.5].
    Returns ``host, n_docs, host_ok`` and one posterior mean per rule.
    """
    counts = written(
        measured.filter(F.col("host").isNotNull()).groupBy("host").agg(
            F.count(F.lit(1)).alias("n"),
            *[F.sum(c.cast("long")).alias(f"k_{r}") for r, c in failures().items()]),
        "host-counts")
    totals = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("h"),
                        *[F.sum(f"k_{r}").alias(r) for r in RULES]).first()
    if not totals["n"]:
        return counts.select("host", "n", F.lit(True).alias("host_ok"))
    rate = {r: totals[r] / totals["n"] for r in RULES}
    spread = counts.agg(*[
        F.sum(F.col("n") * F.pow(F.col(f"k_{r}") / F.col("n") - F.lit(rate[r]), 2)).alias(r)
        for r in RULES]).first()
    out, ok = counts, F.lit(True)
    for r in RULES:
        noise = rate[r] * (1 - rate[r])
        free = totals["n"] - totals["h"]
        rho = (spread[r] - totals["h"] * noise) / (noise * free) if noise * free > 0 else 0.0001
        strength = 1 / min(max(rho, 0.0001), 0.5) - 1
        size = F.col("n") + F.lit(strength)
        mean = (F.col(f"k_{r}") + F.lit(strength * rate[r])) / size
        out = out.withColumn(f"rate_{r}", mean)
        bound = F.col(f"rate_{r}") - HOST_SD * F.sqrt(
            F.col(f"rate_{r}") * (1 - F.col(f"rate_{r}")) / (size + 1))
        ok = ok & (bound <= HOST_LIMIT)
    return out.withColumn("host_ok", ok).drop(*[f"k_{r}" for r in RULES])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          host_col: str = "source") -> DataFrame:
    """One row per document: its counts, ``base_failed``, ``host_ok`` and
    ``kept`` (false where the base rules fail, else the host's verdict)."""
    measured = written(measure(docs, id_col, text_col, host_col), "quality")
    verdict = written(host_verdicts(measured).select(
        F.col("host").alias("v_host"), "host_ok"), "host-verdicts")
    return (measured.withColumn("base_failed", failures()["base"])
            .join(verdict, F.col("host") == F.col("v_host"), "left")
            .withColumn("host_ok", F.coalesce("host_ok", F.lit(True)))
            .withColumn("kept", ~F.col("base_failed") & F.col("host_ok"))
            .drop("v_host"))


def keep_good(docs: DataFrame) -> DataFrame:
    """Documents the rules keep, all columns unchanged.

    The documents are written once with their counts, so the texts are
    measured once; host verdicts are joined by ``source``, and no text is
    shuffled while the rejected hosts fit the broadcast threshold.
    """
    names = docs.columns
    measured = written(docs.withColumn("__counts", metrics(F.col("text").cast("string"))), "measured")
    counts = measured.select(F.col("source").alias("host"), "__counts.*")
    bad = written(host_verdicts(counts).filter(~F.col("host_ok")).select(
        F.col("host").alias("__bad_host")), "bad-hosts")
    base = failures("__counts.")["base"]
    return (measured.filter(~base)
            .join(bad, F.col("source") == F.col("__bad_host"), "left_anti").select(*names))
