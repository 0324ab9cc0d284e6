"""Signal normalisation in long form: (read_id, pos, value), two passes where a read's own statistics are needed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from seqspark.operators.segments import runs

MAD_FACTOR = 1.4826


def med_mad(points: DataFrame, key: str = "read_id", value: str = "value") -> DataFrame:
    """key, med, mad: median, and 1.4826 times the median distance from it."""
    med = points.groupBy(key).agg(F.median(value).alias("med"))
    return points.join(med, key).groupBy(key, "med").agg((MAD_FACTOR * F.median(F.abs(F.col(value) - F.col("med")))).alias("mad"))


def norm_med_mad(points: DataFrame, key: str = "read_id", value: str = "value") -> DataFrame:
    """``points`` with norm; null where the MAD is 0."""
    return points.join(med_mad(points, key, value), key).withColumn("norm", (F.col(value) - F.col("med")) / F.nullif(F.col("mad"), F.lit(0.0))).drop("med", "mad")


def noisiest_range(points: DataFrame, samples: int = 100, threshold: float = 6.0, key: str = "read_id", pos: str = "pos", value: str = "value") -> DataFrame:
    """key, lo, hi: the longest noisy run of each read, from the quiet point before it through its last point; nothing for reads without one.

    A full window of ``samples`` points is noisy if its deviation is over the read's over ``threshold``; the rest behind
    the last full window counts as noisy; the read's first and last point are quiet.  The first run wins ties.
    """
    whole = points.groupBy(key).agg((F.stddev_pop(value) / threshold).alias("limit"), F.count("*").alias("n"))
    window = F.floor(F.col(pos) / samples)
    parts = points.groupBy(key, window.alias("w")).agg(F.stddev_pop(value).alias("std"))
    rows = points.select(key, pos, window.alias("w")).join(parts, [key, "w"]).join(whole, key)
    noisy = ((F.col("w") >= F.floor(F.col("n") / samples)) | (F.col("std") > F.col("limit"))) & (F.col(pos) > 0) & (F.col(pos) < F.col("n") - 1)
    found = runs(rows.select(key, pos, noisy.alias("noisy")), key, pos, "noisy").where("noisy")
    best = found.groupBy(key).agg(F.max_by(F.struct("start", "end"), F.struct("length", (-F.col("start")).alias("first"))).alias("x"))
    return best.select(key, (F.col("x.start") - 1).alias("lo"), F.col("x.end").alias("hi"))


def _noisiest(points: DataFrame, samples: int, threshold: float, key: str, pos: str, value: str) -> DataFrame:
    """Median and MAD of each read's noisiest range, of the whole read where there is none."""
    found = noisiest_range(points, samples, threshold, key, pos, value)
    inside = points.join(found, key, "left").where(F.col("lo").isNull() | F.col(pos).between(F.col("lo"), F.col("hi")))
    return med_mad(inside.select(key, value), key, value)


def norm_noisiest(points: DataFrame, samples: int = 100, threshold: float = 6.0, offset: float = 0.0, key: str = "read_id", pos: str = "pos", value: str = "value") -> DataFrame:
    """``points`` with norm = (value - med + offset) / mad of the noisiest range."""
    own = _noisiest(points, samples, threshold, key, pos, value)
    return points.join(own, key).withColumn("norm", (F.col(value) - F.col("med") + offset) / F.nullif(F.col("mad"), F.lit(0.0))).drop("med", "mad")


def _differences(points: DataFrame, key: str, pos: str, value: str) -> DataFrame:
    by = Window.partitionBy(key).orderBy(pos)
    return points.withColumn("_diff", F.col(value) - F.lag(value).over(by)).where("_diff IS NOT NULL")


def diff_norm_noisiest(points: DataFrame, samples: int = 100, threshold: float = 6.0, key: str = "read_id", pos: str = "pos", value: str = "value") -> DataFrame:
    """Differences from the point before over the noisiest range's MAD; one point shorter."""
    own = _noisiest(points, samples, threshold, key, pos, value)
    return _differences(points, key, pos, value).join(own, key).select(key, pos, (F.col("_diff") / F.nullif(F.col("mad"), F.lit(0.0))).alias("norm"))


def diff_norm_fixed(points: DataFrame, dev: float = 100.0, key: str = "read_id", pos: str = "pos", value: str = "value") -> DataFrame:
    """Differences from the point before over a constant; one point shorter."""
    return _differences(points, key, pos, value).select(key, pos, (F.col("_diff") / dev).alias("norm"))


def _dwell_moments(path: DataFrame, key: str, pos: str, state: str, value: str) -> DataFrame:
    return runs(path, key, pos, state, F.avg(value).alias("m"), F.var_pop(value).alias("v"))


def norm_combine(path: DataFrame, key: str = "read_id", pos: str = "pos", state: str = "state", value: str = "value") -> DataFrame:
    """``path`` with norm: minus the mean of the runs' means, over the root of their mean variance plus the variance of their means."""
    own = _dwell_moments(path, key, pos, state, value).groupBy(key).agg(F.avg("m").alias("centre"), F.sqrt(F.avg("v") + F.var_pop("m")).alias("scale"))
    return path.join(own, key).withColumn("norm", (F.col(value) - F.col("centre")) / F.nullif(F.col("scale"), F.lit(0.0))).drop("centre", "scale")


def norm_dwell(path: DataFrame, key: str = "read_id", pos: str = "pos", state: str = "state", value: str = "value") -> DataFrame:
    """``path`` with norm, from the runs longer than one point: minus the mean of their means, over the root of their mean variance.  Null for reads without such runs."""
    own = _dwell_moments(path, key, pos, state, value).where("length > 1").groupBy(key).agg(F.avg("m").alias("centre"), F.sqrt(F.avg("v")).alias("scale"))
    return path.join(own, key, "left").withColumn("norm", (F.col(value) - F.col("centre")) / F.nullif(F.col("scale"), F.lit(0.0))).drop("centre", "scale")


def rescale_dwell(
    path: DataFrame, model: DataFrame, min_dwell: int = 5, effective: Callable[[Column], Column] | None = None, no_scale: bool = False,
    statistic: Callable[[str], Column] = F.median, key: str = "read_id", pos: str = "pos", state: str = "state", value: str = "value",
) -> DataFrame:
    """``path`` with rescaled and fitted: the line from the runs' statistic (median by default) to the model's level, for each read.

    Runs of at least ``min_dwell`` points count; with ``effective`` only those of such states, and a read with fewer than five
    of these keeps its signal (fitted is false).  ``model(kmer, level_mean)``.
    """
    own = runs(path, key, pos, state, statistic(value).alias("s")).where(F.col("length") >= min_dwell)
    own = own.join(model.select(F.col("kmer").alias(state), F.col("level_mean").alias("r")), state)
    if effective is not None:
        own = own.where(effective(F.col(state)))
    slope = F.lit(1.0) if no_scale else F.regr_slope("r", "s")
    fit = own.groupBy(key).agg(F.count("*").alias("n"), slope.alias("a"), F.avg("r").alias("mr"), F.avg("s").alias("ms"))
    good = F.col("a").isNotNull() & (F.col("n") >= (5 if effective is not None else 1))
    fit = fit.select(key, F.when(good, F.col("a")).alias("a"), F.when(good, F.col("mr") - F.col("a") * F.col("ms")).alias("b"))
    rows = path.join(fit, key, "left")
    return rows.withColumn("rescaled", F.coalesce(F.col("a") * F.col(value) + F.col("b"), F.col(value))).withColumn("fitted", F.col("a").isNotNull()).drop("a", "b")
