"""Model-quality metrics over ``(score, label)`` rows.

Ranking metrics group rows by distinct score first (partial aggregation),
then need cumulative counts in descending score order. That prefix sum is
two-level: consecutive score ranges that follow the data (``range_blocks``)
give a small table of block totals and offsets, and the fine window runs per
block. Scores crowded near zero are cut as finely as any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adspark.operators.ordering import range_blocks


def _by_score(df: DataFrame, score: str, label: str, rows_per_block: int) -> DataFrame:
    """Per distinct score: pos, neg, and counts of rows with a strictly higher score."""
    g = (df.groupBy(F.col(score).cast("double").alias("s"))
         .agg(F.sum(F.col(label).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("cnt"))
         .withColumn("neg", F.col("cnt") - F.col("pos")))
    g = range_blocks(g, [F.col("s").desc()], rows_per_block)  # block 0 = highest scores
    tot = g.groupBy("_b").agg(F.sum("pos").alias("_bp"), F.sum("neg").alias("_bn"))
    wo = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    off = tot.select("_b", F.coalesce(F.sum("_bp").over(wo), F.lit(0)).alias("_op"),
                     F.coalesce(F.sum("_bn").over(wo), F.lit(0)).alias("_on"))
    wf = Window.partitionBy("_b").orderBy(F.col("s").desc()).rowsBetween(Window.unboundedPreceding, -1)
    j = (g.withColumn("_ip", F.coalesce(F.sum("pos").over(wf), F.lit(0))).withColumn("_in", F.coalesce(F.sum("neg").over(wf), F.lit(0)))
         .join(off, "_b"))
    return j.select("s", "pos", "neg", (F.col("_op") + F.col("_ip")).alias("pos_above"), (F.col("_on") + F.col("_in")).alias("neg_above"))


def roc_auc(df: DataFrame, score: str = "score", label: str = "label", rows_per_block: int = 1_000_000) -> DataFrame:
    """ROC AUC with ties counted half."""
    t = _by_score(df, score, label, rows_per_block)
    return t.agg(
        (F.sum(F.col("neg") * (F.col("pos_above") + F.col("pos") / 2.0))
         / (F.sum("pos").cast("double") * F.sum("neg"))).alias("roc_auc"))


def average_precision(df: DataFrame, score: str = "score", label: str = "label",
                      rows_per_block: int = 1_000_000) -> DataFrame:
    """Average precision, step sum over distinct thresholds."""
    t = _by_score(df, score, label, rows_per_block)
    tp = F.col("pos_above") + F.col("pos")
    fp = F.col("neg_above") + F.col("neg")
    return t.agg((F.sum(F.col("pos") * tp / (tp + fp)) / F.sum("pos")).alias("average_precision"))


def log_loss(df: DataFrame, score: str = "score", label: str = "label", eps: float = 1e-7,
             pos_weight: float | None = None) -> DataFrame:
    """Mean binary cross-entropy with clipped p; ``pos_weight`` weights positives."""
    p = F.least(F.greatest(F.col(score).cast("double"), F.lit(eps)), F.lit(1.0 - eps))
    y = F.col(label).cast("double")
    w = F.lit(1.0 if pos_weight is None else float(pos_weight))
    name = "log_loss" if pos_weight is None else "weighted_log_loss"
    return df.agg(F.avg(-(w * y * F.log(p) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - p))).alias(name))


def confusion_counts(df: DataFrame, score: str = "score", label: str = "label", threshold: float = 0.5,
                     inclusive: bool = True) -> DataFrame:
    """tn, fp, fn, tp at a threshold."""
    pred = (F.col(score) >= threshold) if inclusive else (F.col(score) > threshold)
    y = F.col(label) == 1
    return df.agg(F.count_if(~pred & ~y).alias("tn"), F.count_if(pred & ~y).alias("fp"),
                  F.count_if(~pred & y).alias("fn"), F.count_if(pred & y).alias("tp"))


def _ratio(a, b):
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def threshold_metrics(df: DataFrame, score: str = "score", label: str = "label", threshold: float = 0.5,
                      inclusive: bool = True) -> DataFrame:
    """Accuracy, precision, recall, F1 (0 on empty denominators) and sample count."""
    c = confusion_counts(df, score, label, threshold, inclusive)
    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")
    prec, rec = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return c.select(F.lit(float(threshold)).alias("threshold"),
                    (tp + fp + fn + tn).alias("n"),
                    _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
                    prec.alias("precision"), rec.alias("recall"),
                    F.when(prec + rec == 0, F.lit(0.0)).otherwise(2 * prec * rec / (prec + rec)).alias("f1"))


def classification_report(df: DataFrame, score: str = "score", label: str = "label",
                          threshold: float = 0.5) -> DataFrame:
    """Per-class precision/recall/F1/support plus macro and weighted averages."""
    c = confusion_counts(df, score, label, threshold)
    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")

    def row(name, t, f_p, f_n, sup):
        p, r = _ratio(t, t + f_p), _ratio(t, t + f_n)
        f1 = F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f1.alias("f1"),
                        sup.cast("double").alias("support"))
    per = c.select(row("0", tn, fn, fp, tn + fp).alias("c0"), row("1", tp, fp, fn, tp + fn).alias("c1"))
    n = F.col("c0.support") + F.col("c1.support")

    def avg(name, w0, w1, sup):
        return F.struct(F.lit(name).alias("class"),
                        *[(F.col(f"c0.{m}") * w0 + F.col(f"c1.{m}") * w1).alias(m) for m in
                          ["precision", "recall", "f1"]], sup.alias("support"))
    rows = per.select(F.array(F.col("c0"), F.col("c1"),
                              avg("macro avg", F.lit(0.5), F.lit(0.5), n),
                              avg("weighted avg", F.col("c0.support") / n, F.col("c1.support") / n, n)
                              ).alias("r"))
    return rows.select(F.explode("r").alias("x")).select("x.*")


def reliability_table(df: DataFrame, score: str = "score", label: str = "label", n_bins: int = 15) -> DataFrame:
    """Per equal-width bin: count, mean score, mean label; p = 1 goes to the top bin."""
    b = F.least(F.floor(F.col(score) * n_bins), F.lit(n_bins - 1)).cast("int")
    return (df.groupBy(b.alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(score).cast("double")).alias("avg_score"),
                 F.avg(F.col(label).cast("double")).alias("avg_label")))


def calibration_error(df: DataFrame, score: str = "score", label: str = "label", n_bins: int = 15) -> DataFrame:
    """Expected calibration error: sum over bins of n_b/n * |avg p - avg y|."""
    t = reliability_table(df, score, label, n_bins)
    return t.agg((F.sum(F.col("n") * F.abs(F.col("avg_score") - F.col("avg_label"))) / F.sum("n")).alias("ece"))


def roc_auc_binned(df: DataFrame, score: str = "score", label: str = "label", n_thresholds: int = 256) -> DataFrame:
    """ROC AUC from counts at ``n_thresholds`` evenly spaced thresholds, trapezoid rule.

    Threshold k is k/(n-1); a row counts as predicted positive at k when
    score >= k/(n-1). The curve is closed with the point (0, 0). After the
    grouped count everything runs on a grid of n_thresholds + 1 rows.
    """
    m = n_thresholds - 1
    k = F.least(F.greatest(F.floor(F.col(score) * m), F.lit(-1)), F.lit(m)).cast("int")  # highest k with t_k <= s
    per = df.groupBy(k.alias("t")).agg(F.sum(F.col(label).cast("bigint")).alias("pos"),
                                       F.count(F.lit(1)).alias("cnt"))
    grid = df.sparkSession.range(-1, n_thresholds).select(F.col("id").cast("int").alias("t"))
    g = grid.join(F.broadcast(per), "t", "left").fillna(0, subset=["pos", "cnt"])
    suffix = Window.orderBy(F.col("t").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    g = (g.withColumn("tp", F.sum("pos").over(suffix)).withColumn("fp", F.sum(F.col("cnt") - F.col("pos")).over(suffix))
         .withColumn("P", F.max("tp").over(whole)).withColumn("N", F.max("fp").over(whole))
         .where(F.col("t") >= 0))
    pts = g.select("t", (F.col("tp") / F.col("P")).alias("tpr"), (F.col("fp") / F.col("N")).alias("fpr"))
    w = Window.orderBy("t")
    nxt = pts.select("tpr", "fpr", F.coalesce(F.lead("tpr").over(w), F.lit(0.0)).alias("tpr2"),
                     F.coalesce(F.lead("fpr").over(w), F.lit(0.0)).alias("fpr2"))
    return nxt.agg(F.sum((F.col("fpr") - F.col("fpr2")) * (F.col("tpr") + F.col("tpr2")) / 2.0).alias("roc_auc_binned"))


def best_run(metrics: DataFrame, run: str = "run", loss: str = "val_loss") -> DataFrame:
    """The run with the smallest validation loss, ties to the smallest run id."""
    return metrics.agg(F.min_by(F.col(run), F.struct(F.col(loss), F.col(run))).alias("best_run"),
                       F.min(loss).alias("best_loss"))
