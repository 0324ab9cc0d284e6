"""Building, mixing, cutting and numbering training datasets; best classes of frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from seqspark.functions.sequence import a_to_m
from seqspark.operators.ranks import numbered

#: Rows of a source that a single task may put in order.
GROUP_LIMIT = 1000


def modified_posterior(frames: DataFrame, lengths: DataFrame, n: int = 3, a: int = 1, m: int = 5, key: tuple[str, ...] = ("read_id",)) -> DataFrame:
    """key, base_index, p: of each base, pM / (pA + pM), from the sums of its ``n`` largest pA and pM over its frames.

    ``frames(key, base_index, cls, logit, t)``; each frame's logits go through a softmax.  Frames before the first base are left
    out; a read with a base index beyond its sequence (``lengths(key, seq_len)``) is turned down.
    """
    keys = list(key)
    own = frames.where("base_index >= 0")
    bad = own.groupBy(*keys).agg(F.max("base_index").alias("top")).join(lengths, keys).where("top >= seq_len").select(*keys)
    frame = Window.partitionBy(*keys, "t")
    own = own.join(bad, keys, "left_anti").withColumn("_e", F.exp(F.col("logit") - F.max("logit").over(frame)))
    # exponentials of the same frame: one window gives their sum
    own = own.withColumn("p", F.col("_e") / F.sum("_e").over(frame)).where(F.col("cls").isin(a, m))
    best = own.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "base_index", "cls").orderBy(F.desc("p")))).where(F.col("_r") <= n)
    sums = best.groupBy(*keys, "base_index").agg(F.sum(F.when(F.col("cls") == m, F.col("p")).otherwise(0.0)).alias("pm"), F.sum("p").alias("both"))
    return sums.select(*keys, "base_index", (F.col("pm") / F.col("both")).alias("p"))


def argmax_call(frames: DataFrame, keys: tuple[str, ...] = ("read_id", "t"), cls: str = "cls", value: str = "logit") -> DataFrame:
    """keys, cls: the best class of each frame, the first on ties."""
    return frames.groupBy(*keys).agg(F.max_by(cls, F.struct(value, (-F.col(cls)).alias("c"))).alias(cls))


def limit_per_dataset(df: DataFrame, n: int, source: str, order: str) -> DataFrame:
    """The first ``n`` rows of each source.

    Up to ``GROUP_LIMIT``, each task passes on no more than ``n`` rows of a source (Spark's window group limit); beyond it, rows are numbered over ranges.
    """
    if n > GROUP_LIMIT:
        return numbered(df, order, source).where(F.col("_n") <= n).drop("_n")
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(source).orderBy(order))).where(F.col("_n") <= n).drop("_n")


def shuffle_split(df: DataFrame, eval_size: int, key: str, seed: int = 42) -> DataFrame:
    """``df`` with split: exactly ``eval_size`` rows (by the order of a hash of the key) are ``eval``, the others ``train``.

    The border is found by a top-k of hashes, and only it is sent back to all rows.
    """
    h = F.xxhash64(F.col(key), F.lit(seed))
    top = df.select(h.alias("h"), F.col(key).alias("k")).orderBy("h", "k").limit(eval_size).agg(F.max(F.struct("h", "k")).alias("border"))
    return df.withColumn("split", F.when(F.struct(h.alias("h"), F.col(key).alias("k")) <= top.scalar(), "eval").otherwise("train"))


def merge_datasets(dfs: list[DataFrame], keys: list[str], order: str, limit: int | None = None) -> DataFrame:
    """The datasets one below the other in the columns that all have, and ``source``; the first ``limit`` rows of each."""
    shared = [k for k in keys if all(k in df.columns for df in dfs)]
    parts = [df.select(*shared, F.lit(i).alias("source"), F.col(order).alias("_order")) for i, df in enumerate(dfs)]
    rows = reduce(DataFrame.unionByName, parts)
    return (rows if limit is None else limit_per_dataset(rows, limit, "source", "_order")).drop("_order")


def merge_equal(dfs: list[DataFrame | None], order: str) -> DataFrame:
    """All cut to the rows of the smallest, then one below the other; missing ones are skipped."""
    parts = [df.withColumn("source", F.lit(i)) for i, df in enumerate(d for d in dfs if d is not None)]
    rows = reduce(DataFrame.unionByName, parts)
    # a source without rows is the smallest
    least = rows.groupBy("source").agg(F.count("*").alias("c")).agg(F.when(F.count("*") == len(parts), F.min("c")).otherwise(0).alias("least"))
    ranked = numbered(rows, order, "source")
    return ranked.where(F.col("_n") <= least.scalar()).drop("_n")


def mix_methylation(control: DataFrame, meth: DataFrame, ratio: float, order: str, seq: str = "seq", base_replace: bool = True, shift: str | None = None) -> DataFrame:
    """Modified rows, then control rows, so that control / modified is ``ratio``; the side with too many rows keeps its first.

    ``base_replace`` writes M for A in the modified rows.  ``shift`` names a column of medians with a column ``mad``: modified
    signals move by (mean control median - mean modified median) / mad.
    """
    if base_replace:
        meth = meth.withColumn(seq, a_to_m(seq))
    if shift is not None:
        move = control.agg(F.avg(shift)).scalar() - meth.agg(F.avg(shift)).scalar()
        meth = meth.withColumn("_move", move / F.col("mad")).withColumn("signal", F.transform("signal", lambda x: x + F.col("_move"))).drop("_move")
    rows = meth.withColumn("is_control", F.lit(False)).unionByName(control.withColumn("is_control", F.lit(True)))
    cap = F.when(F.col("is_control"), F.floor(meth.agg(F.count("*")).scalar() * ratio)).otherwise(F.floor(control.agg(F.count("*")).scalar() / ratio))
    ranked = numbered(rows, order, "is_control")
    return ranked.where(F.col("_n") <= cap).drop("_n")


def filter_meta_ids(mm: DataFrame, meta: DataFrame, key: str = "read_id") -> DataFrame:
    """Normalisation rows of the reads in ``meta``, repeated by each read's number of chunks there."""
    counts = meta.groupBy(key).agg(F.count("*").alias("_n"))
    return mm.join(counts, key).withColumn("chunk_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).drop("_n")
