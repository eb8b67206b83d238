"""How well scores of pairs meet contacts: strings of hits, distances, and measures of a confusion matrix.

``scores`` (*keys, p1, p2, score), ``dist`` (i, j, d) and ``contact`` (i, j) use residue numbers with the lesser first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _of_one(df: DataFrame, one: DataFrame) -> DataFrame:
    return df.crossJoin(F.broadcast(one))  # one row


def performance(scores: DataFrame, contact: DataFrame, keys=(), within=()) -> DataFrame:
    """(*keys, *within, p1, p2, place, hit, ideal): by falling score; ``ideal`` has a hit in each of the first places, one a contact.

    ``within``: keys of ``contact`` that part it into structures; the scores are held against each that has contacts. A
    network has at most L (L - 1) / 2 scores, which one task puts in order.
    """
    flag = contact.select(*within, F.col("i").alias("p1"), F.col("j").alias("p2"), F.lit(1).alias("hit")).distinct()
    k = flag.groupBy(*within).agg(F.count("*").alias("contacts"))
    keys = [*keys, *within]
    by = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(F.desc("score"), "p1", "p2")
    rows = scores.crossJoin(k) if within else _of_one(scores, k)  # a row for each score of each structure
    rows = rows.join(flag, [*within, "p1", "p2"], "left").withColumn("place", F.row_number().over(by))
    rows = rows.withColumn("hit", F.coalesce("hit", F.lit(0)))
    return rows.select(*keys, "p1", "p2", "place", "hit", (F.col("place") <= F.col("contacts")).cast("int").alias("ideal"), "contacts")


def hamming(strings: DataFrame, keys=()) -> DataFrame:
    wrong = F.sum((F.col("hit") != F.col("ideal")).cast("int"))
    return strings.groupBy(*keys).agg((1 - wrong / (2 * F.max("contacts"))).alias("accuracy"))


def weighted_hamming(strings: DataFrame, keys=()) -> DataFrame:
    """Errors weigh the logarithm of their place plus one."""
    w = F.log(F.col("place") + 1)
    n = strings.groupBy(*keys).agg(F.count("*").alias("n"))
    rows = strings.withColumn("w", w)
    rows = rows.join(n, list(keys)) if keys else _of_one(rows, n)
    k = F.col("contacts")
    wrong = F.sum(F.when(F.col("hit") != F.col("ideal"), F.col("w")).otherwise(0.0))
    most = F.sum(F.when(F.col("place") <= k, F.col("w")).otherwise(0.0)) + F.sum(F.when(F.col("place") > F.col("n") - k, F.col("w")).otherwise(0.0))
    return rows.groupBy(*keys).agg((1 - wrong / most).alias("accuracy"))


def contact_share(edges: DataFrame, contact: DataFrame, keys=(), within=()) -> DataFrame:
    """The share of edges that are contacts; ``within`` as in ``performance``."""
    flag = contact.select(*within, F.col("i").alias("p1"), F.col("j").alias("p2"), F.lit(1.0).alias("hit")).distinct()
    rows = edges.crossJoin(flag.select(*within).distinct()) if within else edges
    return rows.join(flag, [*within, "p1", "p2"], "left").groupBy(*keys, *within).agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("accuracy"))


def _ratio(x: Column, y: Column) -> Column:
    """x / y as of floating-point numbers: by 0 it is infinite, and 0 by 0 not a number, where ANSI mode has an error."""
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    return F.when(y != 0, x / y).when(y.isNotNull() & x.isNotNull(), F.when((x == 0) | F.isnan(x), nan).when(x > 0, inf).otherwise(-inf))


def mean_distance(edges: DataFrame, dist: DataFrame, keys=(), weight: str = "weight", within=()) -> DataFrame:
    """One less the weighted mean of the edges' distances, between the least (1) and the mean distance (0).

    An edge without a distance is an error, as no mean could count it. ``within``: keys of ``dist`` that part it into
    structures; the edges are held against each, (*keys, *within, accuracy), by those of them that it has. Where all
    distances are equal (as the one of two residues is) the accuracy isn't a number.
    """
    ends = dist.groupBy(*within).agg(F.min("d").alias("low"), F.avg("d").alias("mean"))
    rows = edges.join(dist.select(*within, F.col("i").alias("p1"), F.col("j").alias("p2"), "d"), ["p1", "p2"], "inner" if within else "left")
    missing = F.raise_error(F.concat(F.lit("no distance of "), F.col("p1").cast("string"), F.lit(" and "), F.col("p2").cast("string"))).cast("double")
    rows = rows.withColumn("d", F.when(F.col("d").isNull(), missing).otherwise(F.col("d")))
    part = _ratio(F.col(weight) * (F.col("d") - F.col("low")), F.col("mean") - F.col("low"))
    rows = rows.join(ends, list(within)) if within else _of_one(rows, ends)
    return rows.groupBy(*keys, *within).agg((1 - _ratio(F.sum(part), F.sum(weight))).alias("accuracy"))


def confusion(df: DataFrame, predicted: str, actual: str, keys=(), compat: bool = False) -> DataFrame:
    """(*keys, tp, tn, fp, fn); ``compat`` swaps fp and fn, as they were first read."""
    p, a = F.col(predicted) == 1, F.col(actual) == 1
    count = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("long")
    fp, fn = count(p & ~a), count(~p & a)
    return df.groupBy(*keys).agg(count(p & a).alias("tp"), count(~p & ~a).alias("tn"), (fn if compat else fp).alias("fp"), (fp if compat else fn).alias("fn"))


def _over(x: Column, y: Column) -> Column:
    return F.when(y != 0, x / y)


def measures() -> dict[str, Column]:
    """Of tp, tn, fp and fn; null where a denominator is 0."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    m = {
        "tpr": _over(tp, tp + fn), "tnr": _over(tn, tn + fp), "fpr": _over(fp, fp + tn), "fnr": _over(fn, fn + tp),
        "ppv": _over(tp, tp + fp), "npv": _over(tn, tn + fn), "fdr": _over(fp, fp + tp), "rand": _over(tp + tn, tp + tn + fp + fn),
    }
    m |= {
        "bacc": (m["tpr"] + m["tnr"]) / 2, "f1_score": _over(2 * tp, 2 * tp + fp + fn), "g_means": F.sqrt(m["tpr"] * m["tnr"]),
        "mcc": _over(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), "jaccard": _over(tp, tp + fp + fn),
        "informedness": m["tpr"] + m["tnr"] - 1, "markedness": m["ppv"] + m["npv"] - 1, "dor": _over(tp * tn, fp * fn),
    }
    return m


def measured(matrix: DataFrame, keys=()) -> DataFrame:
    m = measures()
    return matrix.select(*keys, "tp", "tn", "fp", "fn", (F.col("tp") + F.col("fn")).alias("p"), (F.col("tn") + F.col("fp")).alias("n"), *(v.alias(k) for k, v in m.items()))


MATRIX_METHODS = ("rand", "bacc", "f1_score", "informedness", "mcc", "jaccard")


def accuracy(scores: DataFrame, method: str, contact: DataFrame, dist: DataFrame | None = None, keys=(), within=()) -> DataFrame:
    """(*keys, accuracy) by the name of a method. As predictions, the first places, one a contact, count as positive.

    ``within``: (*keys, *within, accuracy), as in ``performance`` and ``mean_distance``.
    """
    every = [*keys, *within]
    if method in ("hamming", "whamming"):
        return (hamming if method == "hamming" else weighted_hamming)(performance(scores, contact, keys, within), every)
    if method in MATRIX_METHODS:
        c = confusion(performance(scores, contact, keys, within), "ideal", "hit", every)
        return measured(c, every).select(*every, F.col(method).alias("accuracy"))
    if method == "contact":
        return contact_share(scores, contact, keys, within)
    if method == "avgdist":
        return mean_distance(scores.withColumnRenamed("score", "weight"), dist, keys, within=within)
    raise ValueError(f"no such accuracy: {method}")


def by_value(df: DataFrame, value: str, descending: bool = False) -> DataFrame:
    return df.orderBy(F.desc(value) if descending else F.asc(value), *[c for c in df.columns if c != value])
