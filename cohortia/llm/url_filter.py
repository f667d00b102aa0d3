"""URL filters: listed rules first, empirical-Bayes host reputation for the
rest (native DataFrame code only).

Reputation is a chain of beta-binomial models. Labelled page outcomes (bad or
not) are counted per host, registered domain and suffix; a suffix shrinks
toward the overall rate, a domain toward its suffix, a host toward its domain.
The strength of each level is fitted over all its members. A page is blocked
when the lower posterior bound of its host's bad rate passes a limit.

Edge cases: a null url or one without ``://`` has empty host and path, fits no
rule and is judged by the reputation of the empty host (like any other host);
unlabelled hosts get their domain's posterior, unlabelled domains their
suffix's, unlabelled suffixes the overall one; null labels and labels without
a page are ignored; repeated pages are judged row by row; an empty label table
allows everything that no rule blocks. Hot hosts: counts are pre-aggregated,
and the verdict table is joined from a written table, so it is broadcast only
when its size is below the session's threshold and skew-split otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Suffixes of two labels under which domains are registered (parameter).
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in", "co.nz")
BLOCK_LIMIT = 0.5
BOUND_SD = 2.0
RHO_RANGE = (0.001, 0.5)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where there is no ``://``."""
    after = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    has = F.coalesce(url.contains("://"), F.lit(False))
    host = F.translate(F.regexp_extract(after, "^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(F.lit("")), F.when(has, path).otherwise(F.lit(""))


def with_host(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Add ``host`` and ``path`` (input columns of these names are replaced)."""
    host, path = split_url(F.col(url_col))
    return pages.withColumns({"host": host, "path": path})


def registered_domain(host: Column) -> Column:
    """Last label plus one, or plus two below a listed two-label suffix."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def suffix(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as a string; null if none does.

    ``rules``: (rule, action) with rule = host and path start. A rule fits its
    host and all subdomains. The list is a parameter of the query, so its test
    is one chained expression in the scan stage.
    """
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _strength(children: DataFrame) -> float:
    """Beta-binomial strength of one level by the method of moments; children
    have ``n``, ``k`` and their parent's rate ``m``."""
    noise = F.col("m") * (1 - F.col("m"))
    row = children.agg(
        F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("m"), 2) - noise).alias("excess"),
        F.sum(noise * (F.col("n") - 1)).alias("room")).first()
    rho = row["excess"] / row["room"] if row["room"] else RHO_RANGE[0]
    return 1 / min(max(rho, RHO_RANGE[0]), RHO_RANGE[1]) - 1


def host_reputation(hosts: DataFrame) -> DataFrame:
    """Posterior bad rate per host.

    ``hosts``: ``host, n, k`` (labelled pages, bad among them; n = 0 for hosts
    without labels). Returns ``host, n, k, bad_rate, bad_bound``.
    """
    known = hosts.filter("n > 0").withColumn("domain", registered_domain(F.col("host"))) \
        .withColumn("suffix", suffix(F.col("host")))
    total = known.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    overall = total["k"] / total["n"] if total["n"] else 0.0
    sums = [F.sum("n").alias("n"), F.sum("k").alias("k")]

    def level(children: DataFrame, label: str) -> tuple[DataFrame, float]:
        strength = _strength(children)
        rate = (F.col("k") + strength * F.col("m")) / (F.col("n") + strength)
        return written(children.withColumn("rate", rate), label), strength

    by_suffix, _ = level(known.groupBy("suffix").agg(*sums).withColumn("m", F.lit(overall)),
                         "suffixes")
    top = by_suffix.select("suffix", F.col("rate").alias("m"))
    by_domain, _ = level(known.groupBy("domain", "suffix").agg(*sums).join(top, "suffix"), "domains")
    mid = by_domain.select("domain", F.col("rate").alias("m"))
    _, strength = level(known.select("host", "domain", "n", "k").join(mid, "domain"), "host-fit")
    full = (hosts.withColumn("domain", registered_domain(F.col("host")))
            .withColumn("suffix", suffix(F.col("host")))
            .join(mid.withColumnRenamed("m", "m_domain"), "domain", "left")
            .join(top.withColumnRenamed("m", "m_suffix"), "suffix", "left"))
    mean = F.coalesce("m_domain", "m_suffix", F.lit(overall))
    rate = (F.col("k") + strength * mean) / (F.col("n") + strength)
    return (full.withColumn("bad_rate", rate)
            .withColumn("bad_bound", F.col("bad_rate") - BOUND_SD * F.sqrt(
                F.col("bad_rate") * (1 - F.col("bad_rate")) / (F.col("n") + strength + 1)))
            .select("host", "n", "k", "bad_rate", "bad_bound"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]],
                id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge every page url.

    ``outcomes``: ``id, bad`` (boolean), the labelled page outcomes; several
    labels of a page count each. Returns ``id, host, path, rule, verdict,
    bad_rate, bad_bound``; verdict is the rule's action or, without a rule,
    ``block`` where the posterior bound passes the limit, else ``allow``.
    """
    parsed = written(with_host(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")))
                     .select("id", "host", "path"), "urls")
    labels = outcomes.filter(F.col("bad").isNotNull() & F.col("id").isNotNull()).groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("k"))
    hosts = written(
        parsed.join(labels, "id", "left").groupBy("host").agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
            F.coalesce(F.sum("k"), F.lit(0)).alias("k")), "host-labels")
    scores = written(host_reputation(hosts).select(
        F.col("host").alias("r_host"), "bad_rate", "bad_bound"), "reputation")
    rule = rule_of(F.col("host"), F.col("path"), rules)
    action = F.lit(None).cast("string")
    for name, verdict in rules:
        action = F.when(F.col("rule") == name, F.lit(verdict)).otherwise(action)
    method = F.when(F.col("bad_bound") > BLOCK_LIMIT, F.lit("block")).otherwise(F.lit("allow"))
    return (parsed.join(scores, F.col("host") == F.col("r_host"), "left")
            .withColumn("rule", rule).withColumn("verdict", F.coalesce(action, method))
            .select("id", "host", "path", "rule", "verdict", "bad_rate", "bad_bound"))
