"""Classifier and regressor evaluation on scored tables.

Every metric is one aggregate pass over the scored rows: a threshold sweep
evaluates all cut-offs in the same pass (the reference scans once per cut),
and AUC / ROC aggregate by distinct score first, so the ordered step runs on
distinct scores in value buckets, never on one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import grouped_quantiles, ordered_prefix_sums

EPS = 1e-15


def _pred(p: str, t: float | Column) -> Column:
    return F.col(p) > (t if isinstance(t, Column) else F.lit(float(t)))


def confusion(df: DataFrame, p: str = "score", y: str = "label", t: float = 0.5) -> DataFrame:
    """TN, FP, FN, TP at cut ``t`` (predicted positive when p > t)."""
    pos, hit = F.col(y) == 1, _pred(p, t)
    return df.agg(F.count_if(~pos & ~hit).alias("TN"), F.count_if(~pos & hit).alias("FP"),
                  F.count_if(pos & ~hit).alias("FN"), F.count_if(pos & hit).alias("TP"))


def rates(cm: DataFrame) -> DataFrame:
    """Accuracy, sensitivity, specificity; a zero denominator gives 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("TN", "FP", "FN", "TP"))
    return cm.select(
        "*",
        F.try_divide(tp + tn, tn + fp + fn + tp).alias("accuracy"),
        F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)).alias("sensitivity"),
        F.coalesce(F.try_divide(tn, tn + fp), F.lit(0.0)).alias("specificity"))


def threshold_grid(lo: int = 20, hi: int = 90, step: int = 5) -> list[float]:
    """0.20, 0.25 ... 0.90 built from integers (no accumulated float error)."""
    return [k / 100 for k in range(lo, hi + 1, step)]


def threshold_sweep(df: DataFrame, p: str = "score", y: str = "label",
                    thresholds: Sequence[float] | None = None) -> DataFrame:
    """Sensitivity, specificity, accuracy and error for every cut, one pass."""
    ts = list(thresholds or threshold_grid())
    pos = F.col(y) == 1
    aggs = [F.count(F.lit(1)).alias("__n"), F.count_if(pos).alias("__p")]
    for i, t in enumerate(ts):
        hit = _pred(p, t)
        aggs += [F.count_if(pos & hit).alias(f"__tp{i}"), F.count_if(~pos & ~hit).alias(f"__tn{i}")]
    row = df.agg(*aggs)
    n, npos = F.col("__n"), F.col("__p")
    items = []
    for i, t in enumerate(ts):
        tp, tn = F.col(f"__tp{i}"), F.col(f"__tn{i}")
        acc = F.try_divide(tp + tn, n)
        items.append(F.struct(
            F.lit(t).alias("threshold"),
            F.coalesce(F.try_divide(tp, npos), F.lit(0.0)).alias("sensitivity"),
            F.coalesce(F.try_divide(tn, n - npos), F.lit(0.0)).alias("specificity"),
            acc.alias("accuracy"), (1 - acc).alias("aper")))
    return row.select(F.explode(F.array(*items)).alias("s")).select("s.*")


def best_thresholds(sweep: DataFrame) -> DataFrame:
    """Cut with max accuracy, with min |sens - spec|, with min error;
    ties go to the lowest cut (first in sweep order)."""
    gap = F.abs(F.col("sensitivity") - F.col("specificity"))
    return sweep.agg(
        F.min_by("threshold", F.struct(-F.col("accuracy"), F.col("threshold"))).alias("best_accuracy"),
        F.min_by("threshold", F.struct(gap, F.col("threshold"))).alias("best_balance"),
        F.min_by("threshold", F.struct(F.col("aper"), F.col("threshold"))).alias("min_error"))


def closest_corner(sweep: DataFrame) -> DataFrame:
    """E5: cut nearest to (sensitivity 1, specificity 1)."""
    d = F.sqrt((1 - F.col("sensitivity")) ** 2 + (1 - F.col("specificity")) ** 2)
    return sweep.agg(F.min_by("threshold", F.struct(d, F.col("threshold"))).alias("closest_corner"),
                     F.min(d).alias("corner_distance"))


def _by_score(df: DataFrame, p: str, y: str) -> DataFrame:
    return (df.groupBy(F.col(p).alias("__s"))
            .agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg")))


def roc_auc(df: DataFrame, p: str = "score", y: str = "label") -> DataFrame:
    """Exact AUC (ties count one half) = P(score_pos > score_neg) + ½ P(tie)."""
    s = ordered_prefix_sums(_by_score(df, p, y), "__s", ["neg"], inclusive=False)
    return s.agg((F.sum(F.col("pos") * (F.col("neg_cum") + 0.5 * F.col("neg")))
                  / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def roc_curve(df: DataFrame, p: str = "score", y: str = "label") -> DataFrame:
    """One ROC point per distinct score (predicted positive when p >= s)."""
    s = ordered_prefix_sums(_by_score(df, p, y), "__s", ["pos", "neg"], descending=True)
    tot = df.agg(F.count_if(F.col(y) == 1).alias("__P"), F.count_if(F.col(y) != 1).alias("__N"))
    return (s.crossJoin(F.broadcast(tot))
            .select(F.col("__s").alias("threshold"),
                    F.try_divide(F.col("pos_cum"), F.col("__P")).alias("tpr"),
                    F.try_divide(F.col("neg_cum"), F.col("__N")).alias("fpr")))


def log_loss(df: DataFrame, p: str = "score", y: str = "label") -> DataFrame:
    """Mean binary log loss, probabilities clipped to [1e-15, 1 - 1e-15]."""
    q = F.least(F.greatest(F.col(p), F.lit(EPS)), F.lit(1 - EPS))
    yy = F.col(y).cast("double")
    return df.agg(F.avg(-(yy * F.log(q) + (1 - yy) * F.log(1 - q))).alias("log_loss"))


def regression_metrics(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """MSE, RMSE, MAE and R² in one pass."""
    e = F.col(y) - F.col(yhat)
    g = df.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
               F.sum(e * e).alias("__sse"), (F.var_pop(y) * F.count(y)).alias("__sst"))
    return g.select("mse", F.sqrt("mse").alias("rmse"), "mae",
                    (1 - F.try_divide(F.col("__sse"), F.col("__sst"))).alias("r2"))


# ---------------------------------------------------------------- splits
MIX_SIZE = 1 << 31
MIX_FACTORS = (0x2C1B3C6D, 0x297A2D39)


def _mix(x: Column) -> Column:
    """Multiply and fold high bits into low ones, twice, on 31-bit numbers."""
    for factor, shift in zip(MIX_FACTORS, (15, 16), strict=True):
        x = F.pmod(x * F.lit(factor), F.lit(MIX_SIZE))
        x = x.bitwiseXOR(F.shiftright(x, shift))
    return x


def unit_hash(c: str | Column, salt: int = 0) -> Column:
    """A repeatable uniform number in [0, 1) from an integer id.

    Plain integer arithmetic (multiply, xor-shift), so any engine gives the
    same number on any partitioning. The salt enters between two mixing
    rounds: different salts give unrelated orders of the same ids.
    """
    x = (F.col(c) if isinstance(c, str) else c).cast("bigint")
    low = _mix(F.pmod(x, F.lit(MIX_SIZE)))
    high = F.pmod(F.shiftright(x, 31), F.lit(MIX_SIZE))
    shift = salt * 0x1F123BB5 % MIX_SIZE
    return _mix(F.pmod(low + high + F.lit(shift).cast("bigint"), F.lit(MIX_SIZE))) / float(MIX_SIZE)


def unit_hash53(c: str | Column, salt: int = 0) -> Column:
    """``unit_hash`` with all 53 bits of a double, for orders without ties."""
    fine = F.floor(unit_hash(c, salt + 7919) * float(1 << 22)) / float(1 << 53)
    return unit_hash(c, salt) + fine


def stratified_split(df: DataFrame, frac: float = 0.8, by: str = "label", id_col: str = "row_id",
                     salt: int = 0) -> tuple[DataFrame, DataFrame]:
    """Train / test split with ``frac`` of every class of ``by`` in train.

    Rows are in the order of their id hash; a class is cut at the ``frac``
    quantile of its own hashes (exact, no class is ranked in one task), so
    every class keeps its share to within a row, however small it is. Rows
    without a class are cut at ``frac`` itself. Repeatable on any cluster.
    """
    u = unit_hash(id_col, salt)
    cuts = grouped_quantiles(df.select(F.col(by).alias("__class"), u.alias("__u")), ["__class"], "__u", [frac])
    marked = df.join(cuts.select("__class", F.get("q", F.lit(0)).alias("__cut")),
                     F.col(by) == F.col("__class"), "left").withColumn(
        "__train", F.coalesce(u <= F.col("__cut"), u < frac))
    return tuple(marked.filter(c).select(*df.columns) for c in (F.col("__train"), ~F.col("__train")))


def random_split(df: DataFrame, frac: float = 0.8, id_col: str = "row_id", salt: int = 17):
    """Plain repeatable split on a salted id hash."""
    u = unit_hash(id_col, salt)
    return df.where(u < frac), df.where(u >= frac)


def holdout_by_antijoin(all_rows: DataFrame, train: DataFrame, key: str = "row_id") -> DataFrame:
    """Test rows are the rows whose id is not in train (by id, so equal
    rows that happen to share all values are kept apart correctly)."""
    return all_rows.join(train.select(key), key, "left_anti")


def difference(all_rows: DataFrame, part: DataFrame) -> DataFrame:
    """Multiset difference of rows."""
    return all_rows.exceptAll(part)
