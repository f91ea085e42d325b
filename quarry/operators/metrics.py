"""Measures of a binary classifier: confusion matrix, ROC curve, mutual information."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import running


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: tp, fn, fp, tn and the rates derived from them; a rate without cases is null. Both columns are 0 or 1; nulls do not count."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    x = rows.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).agg(F.count_if(t & p).alias("tp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"))

    def share(a: str, *rest: str):
        return F.round(F.try_divide(F.col(a).cast("double"), sum((F.col(c) for c in rest), F.col(a)).cast("double")), 6)

    tp, fn, fp, tn = (F.col(c).cast("double") for c in ("tp", "fn", "fp", "tn"))
    rates = {
        "tpr": share("tp", "fn"), "fnr": share("fn", "tp"), "fpr": share("fp", "tn"), "tnr": share("tn", "fp"),
        "ppv": share("tp", "fp"), "fdr": share("fp", "tp"), "npv": share("tn", "fn"), "for_rate": share("fn", "tn"),
        "acc": F.round(F.try_divide(tp + tn, tp + tn + fp + fn), 6),
        "lr_pos": F.round(F.try_divide(tp * (fp + tn), (tp + fn) * fp), 6), "lr_neg": F.round(F.try_divide(fn * (fp + tn), (tp + fn) * tn), 6),
        "dor": F.round(F.try_divide(tp * tn, fp * fn), 6),
    }
    return x.select("tp", "fn", "fp", "tn", *(c.alias(k) for k, c in rates.items()))


def fold(id: Column, folds: int) -> Column:
    """The fold, from 0, of a row: by its identifier only, so that reruns and other engines agree."""
    return (F.conv(F.substring(F.md5(id.cast("string").cast("binary")), 1, 7), 16, 10).cast("long") % folds).cast("int")


def per_class(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(class, tp, fn, fp, tn) of every class that is true or predicted somewhere; rows with a null in either do not count.

    Rows are first counted by pairs of classes; only these counts are turned to classes."""
    n, hit = F.col("n"), F.col(truth) == F.col(predicted)
    pairs = rows.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(truth, predicted).agg(F.count("*").alias("n"))
    none = F.lit(0).cast("long")
    true = F.struct(F.col(truth).alias("class"), F.when(hit, n).otherwise(none).alias("tp"), F.when(hit, none).otherwise(n).alias("fn"), none.alias("fp"))
    said = F.struct(F.col(predicted).alias("class"), none.alias("tp"), none.alias("fn"), F.when(hit, none).otherwise(n).alias("fp"))
    x = pairs.select(F.explode(F.array(true, said)).alias("c")).groupBy("c.class").agg(*(F.sum(f"c.{k}").alias(k) for k in ("tp", "fn", "fp")))
    total = F.broadcast(pairs.agg(F.sum("n").alias("_all")))  # one row
    return x.join(total).select("class", "tp", "fn", "fp", (F.col("_all") - F.col("tp") - F.col("fn") - F.col("fp")).alias("tn"))


def mutual_information(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n, mi): how much more often two values meet than by chance, in natural logarithms."""
    x = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    both = x.groupBy(a, b).agg(F.count("*").alias("n"))
    na, nb = both.groupBy(a).agg(F.sum("n").alias("na")), both.groupBy(b).agg(F.sum("n").alias("nb"))
    total = both.agg(F.sum("n").alias("total"))
    y = both.join(na, a).join(nb, b).join(F.broadcast(total))
    return y.select(a, b, "n", F.round(F.log(F.col("n").cast("double") * F.col("total") / (F.col("na").cast("double") * F.col("nb"))), 6).alias("mi"))


def roc(rows: DataFrame, truth: str, score: str) -> DataFrame:
    """(threshold, tp, fp, tpr, fpr) for each distinct score: what is predicted 1 from that score on. Rows with nulls do not count; a rate without cases is null."""
    per = _by_score(rows, truth, score)
    total = per.agg(F.sum("p").cast("double").alias("all_p"), F.sum("n").cast("double").alias("all_n"))
    x = running(per, [F.desc("threshold")], ["p", "n"]).join(F.broadcast(total))  # one row
    return x.select("threshold", F.col("running_p").alias("tp"), F.col("running_n").alias("fp"), F.round(F.try_divide("running_p", "all_p"), 6).alias("tpr"), F.round(F.try_divide("running_n", "all_n"), 6).alias("fpr"))


def auc(rows: DataFrame, truth: str, score: str) -> DataFrame:
    """One row (positives, negatives, auc): the share of pairs of a positive and a negative that the score puts in order, ties counting half."""
    x = running(_by_score(rows, truth, score), [F.desc("threshold")], ["p", "n"])
    above = (F.col("running_p") - F.col("p") / 2) * F.col("n")
    x = x.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("positives"), F.coalesce(F.sum("n"), F.lit(0)).alias("negatives"), F.sum(above).alias("_above"))
    return x.select("positives", "negatives", F.round(F.try_divide(F.col("_above"), F.col("positives").cast("double") * F.col("negatives")), 6).alias("auc"))


def _by_score(rows: DataFrame, truth: str, score: str) -> DataFrame:
    x = rows.where(F.col(truth).isNotNull() & F.col(score).isNotNull())
    return x.groupBy(F.col(score).alias("threshold")).agg(F.count_if(F.col(truth) == 1).alias("p"), F.count_if(F.col(truth) != 1).alias("n"))
