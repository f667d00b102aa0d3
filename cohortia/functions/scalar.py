"""Column-level helpers (section 2.2 and 2.8 of the survey).

All are plain ``Column`` expressions: they stay inside whole-stage codegen and
never raise under ANSI mode (``try_cast`` / ``try_divide``).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_decimal_comma(c: str | Column) -> Column:
    """Text such as ``12,5`` to 12.5; bad text becomes NULL."""
    return _try_double(F.replace(_c(c).cast("string"), F.lit(","), F.lit(".")))


def _try_double(c: Column) -> Column:
    return c.try_cast("double")


def to_int_or_null(c: str | Column) -> Column:
    """Numeric text to bigint, anything else NULL."""
    s = _c(c).cast("string")
    return F.when(s.rlike(r"^\s*[-+]?\d+(\.0*)?\s*$"), s.try_cast("double").try_cast("bigint"))


def nan_to_null(c: str | Column) -> Column:
    x = _c(c)
    return F.when(~F.isnan(x), x)


def blank_to_null(df: DataFrame) -> DataFrame:
    """Empty strings become NULL in every text column (no trimming)."""
    cols = [F.nullif(F.col(f.name), F.lit("")).alias(f.name)
            if isinstance(f.dataType, StringType) else F.col(f.name)
            for f in df.schema.fields]
    return df.select(*cols)


def select_numeric(df: DataFrame, exclude: Iterable[str] = ()) -> DataFrame:
    """Keep numeric columns only."""
    ex = set(exclude)
    return df.select(*[f.name for f in df.schema.fields
                       if isinstance(f.dataType, NumericType) and f.name not in ex])


def keep_existing(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """The requested columns that exist, in the requested order."""
    have = set(df.columns)
    return [c for c in cols if c in have]


def square(c: str | Column) -> Column:
    """P9."""
    x = _c(c)
    return x * x


def interaction(a: str | Column, b: str | Column) -> Column:
    """P10: product of two spend columns."""
    return _c(a) * _c(b)


def merge_features(cols: Sequence[str]) -> Column:
    """Add similar columns into one (missing counts as 0)."""
    acc = None
    for c in cols:
        x = F.coalesce(F.col(c), F.lit(0.0))
        acc = x if acc is None else acc + x
    return acc


def label_map(c: str | Column, mapping: Mapping, default=None) -> Column:
    """dictionary lookup as a literal map; unknown keys give ``default``."""
    m = F.create_map(*[x for kv in mapping.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    v = F.try_element_at(m, _c(c))
    return v if default is None else F.coalesce(v, F.lit(default))


def ordinal_encode(c: str | Column, levels: Sequence[str]) -> Column:
    """1-based code in the given level order; unknown or missing → NULL."""
    return label_map(c, {lv: i + 1 for i, lv in enumerate(levels)}).cast("int")


def binary_encode(c: str | Column, positive: str) -> Column:
    """positive level → 1, other levels → 0, missing stays NULL."""
    x = _c(c)
    return F.when(x.isNull(), F.lit(None).cast("int")).when(x == positive, 1).otherwise(0)


def pvalue_class(p: str | Column) -> Column:
    """right-closed bins at 0.001, 0.01, 0.05 (labels as stars)."""
    x = _c(p)
    return (F.when(x <= 0.001, "***").when(x <= 0.01, "**")
            .when(x <= 0.05, "*").otherwise("ns"))


def quality_word(s: str | Column) -> Column:
    """silhouette width to a quality word (0.5 / 0.3 limits, strict)."""
    x = _c(s)
    return F.when(x > 0.5, "good").when(x > 0.3, "moderate").otherwise("poor")


def minmax_scale_0_100(df: DataFrame, cols: Sequence[str], suffix: str = "_index") -> DataFrame:
    """F16: scale each column to 0–100 by its min and max; constant → 50.

    One aggregate pass for all columns, then a cross join with that one row.
    """
    stats = df.agg(*[F.min(c).alias(f"__mn_{c}") for c in cols],
                   *[F.max(c).alias(f"__mx_{c}") for c in cols])
    out = df.crossJoin(F.broadcast(stats))
    for c in cols:
        mn, mx = F.col(f"__mn_{c}"), F.col(f"__mx_{c}")
        out = out.withColumn(
            c + suffix,
            F.when(mx == mn, F.lit(50.0)).otherwise(
                F.try_divide(F.col(c) - mn, mx - mn) * 100.0))
    return out.drop(*[f"__mn_{c}" for c in cols], *[f"__mx_{c}" for c in cols])


def zscore(df: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """(x − mean) / sample SD, one aggregate pass for all columns."""
    stats = df.agg(*[F.avg(c).alias(f"__mu_{c}") for c in cols],
                   *[F.stddev_samp(c).alias(f"__sd_{c}") for c in cols])
    out = df.crossJoin(F.broadcast(stats))
    for c in cols:
        out = out.withColumn(c + suffix, F.try_divide(F.col(c) - F.col(f"__mu_{c}"),
                                                     F.col(f"__sd_{c}")))
    return out.drop(*[f"__mu_{c}" for c in cols], *[f"__sd_{c}" for c in cols])


def fill_missing_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P15."""
    return df.fillna(0, subset=list(cols))


def drop_incomplete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Select columns and drop rows with any missing value."""
    return df.select(*cols).dropna(how="any")


def round_half_even(c: str | Column, places: int) -> Column:
    """numpy / pandas ``round``: scale, round half to even, unscale."""
    k = 10.0 ** places
    return F.bround(_c(c) * k, 0) / k


def one_hot(df: DataFrame, col: str, levels: Sequence[str] | None = None,
            drop_first: bool = True) -> DataFrame:
    """0/1 columns per level in alphabetical order, first level dropped
    (it is the reference level). Levels are the distinct values when not
    given: one small job over a bounded set of categories."""
    if levels is None:
        levels = [r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().collect()]
    levels = sorted(levels)
    use = levels[1:] if drop_first else levels
    out = df
    for lv in use:
        out = out.withColumn(f"{col}_{lv}".replace(" ", "_"),
                             F.when(F.col(col).isNull(), F.lit(None).cast("int"))
                             .when(F.col(col) == lv, 1).otherwise(0))
    return out


def label_encode(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """alphabetical 0-based code (StringIndexer, alphabetAsc)."""
    from pyspark.ml.feature import StringIndexer
    out = out or f"{col}_code"
    model = StringIndexer(inputCol=col, outputCol=out, stringOrderType="alphabetAsc",
                          handleInvalid="keep").fit(df)
    return model.transform(df).withColumn(out, F.col(out).cast("int"))


def stratify_by_score(df: DataFrame, col: str, ranges: Mapping[str, tuple[float, float]]
                      ) -> dict[str, DataFrame]:
    """One table per closed score range."""
    return {name: df.where(F.col(col).between(lo, hi)) for name, (lo, hi) in ranges.items()}


def window_dates(df: DataFrame, col: str, start, end) -> DataFrame:
    """Keep rows with start <= col <= end (pushed to the scan)."""
    return df.where(F.col(col).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def inflation_adjust(df: DataFrame, col: str, year_col: str, cpi: DataFrame, base_year: int,
                     out: str | None = None, deflate: bool = False) -> DataFrame:
    """Value × CPI(year) / CPI(base), as printed in the reference; with
    ``deflate=True`` value × CPI(base) / CPI(year). ``cpi`` is (year, cpi),
    one row per year, so it is broadcast."""
    out = out or f"{col}_adj"
    base = cpi.where(F.col("year") == base_year).select(F.col("cpi").alias("__base"))
    j = (df.join(F.broadcast(cpi.withColumnRenamed("year", year_col)), year_col, "left")
         .crossJoin(F.broadcast(base)))
    ratio = (F.try_divide(F.col("__base"), F.col("cpi")) if deflate
             else F.try_divide(F.col("cpi"), F.col("__base")))
    return j.withColumn(out, F.col(col) * ratio).drop("cpi", "__base")


def union_by_name(dfs: Sequence[DataFrame]) -> DataFrame:
    """Stack tables matching columns by name; absent columns → NULL."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def exclude_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Leave named inputs out (missing names are ignored)."""
    return df.drop(*cols)


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """P20: rename the columns of a result table."""
    return df.withColumnsRenamed(dict(mapping))


def with_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach a one-row aggregate to every row (broadcast cross join;
    the right side has one row by construction)."""
    return df.crossJoin(F.broadcast(one_row))


def order_by(df: DataFrame, cols: Sequence) -> DataFrame:
    """Multi-key sort with mixed directions (pass ``F.desc(...)``)."""
    return df.orderBy(*cols)


def head(df: DataFrame, n: int, order: Sequence) -> DataFrame:
    """First ``n`` rows after an explicit order (top-k per task, then merge)."""
    return df.orderBy(*order).limit(n)


def distinct(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop duplicate rows (all columns, or the given key columns)."""
    return df.dropDuplicates(list(cols)) if cols else df.distinct()
