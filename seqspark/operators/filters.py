"""Predicates and filters: Column predicates where a row decides, DataFrame functions where more is needed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from seqspark.functions.distance import edit_distance
from seqspark.functions.sequence import IUPAC, as_column, iupac_to_regex, letters, reverse_complement
from seqspark.shared import stored

UNMAPPED, REVERSE, SECONDARY = 4, 16, 256


@dataclass(frozen=True)
class ChunkLimits:
    """Fixed values of the chunk filters: samples a base at least, bases of a chunk, share of its most frequent base."""

    min_rate: int
    min_seq_len: int
    max_mono: float


RNA = ChunkLimits(min_rate=25, min_seq_len=3, max_mono=0.6)
DNA = ChunkLimits(min_rate=2, min_seq_len=7, max_mono=0.8)


def mono_share(seq: Column | str, alphabet: str = "ACGTM") -> Column:
    """Share of the most frequent letter; null for the empty sequence."""
    seq = as_column(seq)
    counts = [F.length(seq) - F.length(F.translate(seq, b, "")) for b in alphabet]
    return F.when(F.length(seq) > 0, F.greatest(*counts) / F.length(seq))


def filter_motif(df: DataFrame, column: str, motif: str, anchor: str = "start", reach: int = 0) -> DataFrame:
    """Rows whose window starts with a motif; ``anchor='center'`` puts the motif's middle at ``reach`` bases from the window's start."""
    return df.where(F.col(column).rlike(motif_pattern(motif, anchor, reach)))


def motif_pattern(motif: str, anchor: str = "start", reach: int = 0) -> str:
    """The regular expression of ``filter_motif``."""
    if unknown := set(motif) - set(IUPAC):
        raise ValueError(f"not in the IUPAC code: {sorted(unknown)}")
    skip = max(reach - len(motif) // 2, 0) if anchor == "center" else 0
    return f"^.{{{skip}}}{iupac_to_regex(motif)}"


def chunk_reason(seq: Column | str, chunk_len: int, limits: ChunkLimits = RNA) -> Column:
    """Why a chunk's sequence is turned down; null if it passes.  X marks low quality, Y tail or adapter, P a gap."""
    seq = as_column(seq)
    n = F.length(seq)
    return (
        F.when(seq == "X", "quality").when(seq == "Y", "tail").when(seq == "P", "gap")
        .when(n <= limits.min_seq_len, "short").when(n >= chunk_len // limits.min_rate, "long")
        .when(mono_share(seq, "ACGTMNU") >= limits.max_mono, "mono").when(~seq.rlike("^[ACGT]*$"), "letters")
    )


def filter_chunks(df: DataFrame, seq: str, chunk_len: int, limits: ChunkLimits = RNA) -> DataFrame:
    return df.where(chunk_reason(seq, chunk_len, limits).isNull())


def chunk_report(df: DataFrame, seq: str, chunk_len: int, limits: ChunkLimits = RNA) -> DataFrame:
    """Chunks by outcome."""
    return df.groupBy(F.coalesce(chunk_reason(seq, chunk_len, limits), F.lit("passed")).alias("reason")).agg(F.count("*").alias("n"))


def min_length(seq: Column | str, least: int = 3) -> Column:
    return F.length(as_column(seq)) >= least


def mono_filter(seq: Column | str, most: float = 0.8) -> Column:
    return mono_share(seq) <= most


def rate_filter(seq: Column | str, signal_len: Column | str, rate: float = 130, fast: float = 2.0, slow: float = 0.5, sampling: float = 4096) -> Column:
    """Samples for each base within the bounds of the moving rate."""
    return (as_column(signal_len) / F.length(as_column(seq))).between(sampling / (fast * rate), sampling / (slow * rate))


def known_bases(seq: Column | str, alphabet: str = "ACGTM") -> Column:
    return as_column(seq).rlike(f"^[{alphabet}]*$")


def and_filters(predicates: list[Callable[[DataFrame], Column]]) -> Callable[[DataFrame], DataFrame]:
    """A filter from callables DataFrame -> Column, all of which must hold; null counts as false."""
    return lambda df: df.where(reduce(lambda a, b: a & b, (F.coalesce(p(df), F.lit(False)) for p in predicates), F.lit(True)))


def training_reason(signal: Column | str, seq: Column | str, alphabet: str = "ACGT") -> Column:
    """Why a training row is turned down: a NaN in the signal, or a letter outside the alphabet."""
    return F.when(F.exists(as_column(signal), F.isnan), "nan").when(~known_bases(seq, alphabet), "letters")


def filter_training(df: DataFrame, signal: str, seq: str, alphabet: str = "ACGT") -> DataFrame:
    return df.where(training_reason(signal, seq, alphabet).isNull())


def check_batch(df: DataFrame, signal: str, seq: str, alphabet: str = "ACGT") -> DataFrame:
    """One row: rows, rows with NaN, all-zero signals, labels outside the alphabet."""
    has_nan = F.exists(signal, F.isnan)
    return df.agg(F.count("*").alias("n"), F.count_if(has_nan).alias("n_nan"), F.count_if(F.forall(signal, lambda x: x == 0)).alias("n_zero"), F.count_if(~known_bases(seq, alphabet)).alias("n_letters"))


def select_kmers(kmer: Column | str, selection: str) -> Column:
    """``AC!M``: each letter before the mark must occur, none after may."""
    wanted, _, banned = selection.partition("!")
    kmer = as_column(kmer)
    terms = [F.contains(kmer, F.lit(c)) for c in wanted] + [~F.contains(kmer, F.lit(c)) for c in banned]
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def alignment_reason(flag: Column | str, tags: Column | str) -> Column:
    """Why an alignment is left out of the index."""
    flag, tags = as_column(flag), as_column(tags)
    return (
        F.when(flag.bitwiseAND(UNMAPPED) != 0, "unmapped").when(flag.bitwiseAND(SECONDARY) != 0, "secondary")
        .when(~(F.coalesce(F.map_contains_key(tags, "mv"), F.lit(False)) & F.coalesce(F.map_contains_key(tags, "ts"), F.lit(False))), "no_moves")
    )


def filter_alignments(df: DataFrame, flag: str = "flag", tags: str = "tags") -> DataFrame:
    """Alignments with a reference and their moves."""
    return df.where(alignment_reason(flag, tags).isNull())


def alignment_report(df: DataFrame, flag: str = "flag", tags: str = "tags", most: float = 100.0) -> DataFrame:
    """One row of counts; an error when the alignments without moves outnumber the good ones by ``most``."""
    reason = F.coalesce(alignment_reason(flag, tags), F.lit("ok"))
    out = df.agg(*(F.count_if(reason == r).alias(r) for r in ("ok", "unmapped", "secondary", "no_moves")))
    return out.withColumn("ok", F.when(F.col("no_moves") / (F.col("ok") + 1) > most, F.raise_error("too many alignments without moves").cast("long")).otherwise(F.col("ok")))


def filter_by_label_length(df: DataFrame, length: str, chunk_len: int) -> DataFrame:
    return df.where((F.col(length) > 5) & (F.col(length) < chunk_len // 10))


def exclude_unmatched_reads(df: DataFrame, query: str, basecall: str, reverse: str, seed: int = 7) -> DataFrame:
    """Rows whose basecall is near the query: two Gaussians are fitted to the edit distances; those below the mark between their means stay."""
    own = F.when(F.col(reverse), reverse_complement(query)).otherwise(F.col(query))
    # the fit and the filter read distances that are measured once
    rows = stored(df.withColumn("distance", edit_distance(own, F.col(basecall)).cast("double")), "distances")
    vector = VectorAssembler(inputCols=["distance"], outputCol="_features", handleInvalid="skip")
    fitted = GaussianMixture(featuresCol="_features", k=2, seed=seed).fit(vector.transform(rows))
    lo, hi = sorted(float(g.mean[0]) for g in fitted.gaussiansDF.collect())
    return rows.where(F.col("distance") < lo + 0.95 * (hi - lo))


def filter_bounds(df: DataFrame, ref_start: str, ref_end: str, query_len: str, seg_start: str, seg_end: str, slack: int = 4, most: int = 10) -> DataFrame:
    """Segments inside the aligned range up to ``slack`` bases, with nearly as many query as reference bases."""
    inside = (F.col(seg_start) >= F.col(ref_start) - slack) & (F.col(seg_end) <= F.col(ref_end) + slack)
    return df.where(inside & (F.abs(F.col(seg_end) - F.col(seg_start) - F.col(query_len)) <= most))


def distinct_letters(seq: Column | str) -> Column:
    return F.array_sort(F.array_distinct(letters(seq)))
