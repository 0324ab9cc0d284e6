"""Joins of reads, alignments, sites, reference sequences and annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from seqspark.functions.sequence import kmer_alternatives, letters
from seqspark.functions.tags import GROUP
from seqspark.operators.aggregates import site_statistics
from seqspark.operators.filters import select_kmers
from seqspark.operators.ranks import numbered

#: Bases in a piece of a reference.
SLICE = 256


def overlap_join(sites: DataFrame, alignments: DataFrame, reference: DataFrame, bin_size: int = 256, contig: str = "contig") -> DataFrame:
    """Pairs of a site (contig, s, e) and a read (contig, r_start, r_end) with r_start < min(e + 1, length) and r_end > max(s - 1, 0).

    Both sides are dealt to fixed bins of their contig; a pair is taken in the first bin that they share.  Contigs that the
    reference (contig, length) does not have are skipped.
    """
    own = sites.join(reference.select(contig, "length"), contig).withColumn("_lo", F.greatest(F.col("s") - 1, F.lit(0))).withColumn("_hi", F.least(F.col("e") + 1, F.col("length"))).where("_hi > _lo").drop("length")
    first = lambda c: F.floor(F.col(c) / bin_size)
    left = own.withColumn("_bin", F.explode(F.sequence(first("_lo"), F.floor((F.col("_hi") - 1) / bin_size))))
    right = alignments.where("r_end > r_start").withColumn("_bin", F.explode(F.sequence(first("r_start"), F.floor((F.col("r_end") - 1) / bin_size))))
    pairs = left.join(right, [contig, "_bin"]).where("r_start < _hi AND r_end > _lo")
    return pairs.where(F.col("_bin") == F.greatest(first("_lo"), first("r_start"))).drop("_bin", "_lo", "_hi")


def first_at_or_after(pairs: Column | str, target: Column) -> Column:
    """The first aligned pair (both sides present) with refpos at or after the target; null if there is none."""
    return F.get(F.filter(pairs, lambda p: p["qpos"].isNotNull() & p["refpos"].isNotNull() & (p["refpos"] >= target)), F.lit(0))


def require_index(reads: DataFrame, index: DataFrame, key: str = "read_id") -> DataFrame:
    """Reads with their index row; an error when one has none."""
    rows = reads.join(index.withColumn("_held", F.lit(True)), key, "left")
    return rows.where(F.when(F.col("_held").isNull(), F.raise_error(F.concat(F.lit("not in the index: "), F.col(key).cast("string"))).cast("boolean")).otherwise(F.lit(True))).drop("_held")


def keep_indexed(reads: DataFrame, index: DataFrame, key: str = "read_id") -> DataFrame:
    return reads.join(index.select(key), key, "left_semi")


def index_report(reads: DataFrame, index: DataFrame, key: str = "read_id") -> DataFrame:
    """One row: reads in the index, and reads that are not."""
    rows = reads.join(index.select(key, F.lit(True).alias("_held")).distinct(), key, "left")
    return rows.agg(F.count_if("_held").alias("n_found"), F.count_if(F.col("_held").isNull()).alias("n_missing"))


def apply_mod_tags(alignments: DataFrame, probs: DataFrame, code: str, key: str = "read_id", order: str = "line") -> DataFrame:
    """Alignments with the group of ``code`` replaced in ``mods`` (a map of codes), for reads in ``probs(key, gaps, likelihoods)``.

    The first alignment of each read alone; other codes stay; rows without any tag, or whose read has no probabilities, are left out.
    """
    first = alignments.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
    own = first.join(probs.select(key, F.struct("gaps", "likelihoods").cast(GROUP).alias("_own")), key).where(F.col("mods").isNotNull())
    rest = F.map_filter("mods", lambda k, _: k != code)
    return own.withColumn("mods", F.map_concat(rest, F.create_map(F.lit(code), F.col("_own")))).drop("_own")


def summarize_sites(hits: DataFrame, sites: DataFrame, keys: tuple[str, ...] = ("contig", "refpos"), prob: str = "prob", modified: str = "modified") -> DataFrame:
    """Every site with its coverage, modified share and geometric share, from hits on the forward strand.

    Without hits: coverage 0, share null, geometric share 0.
    """
    own = hits.where("NOT reverse_align").groupBy(*keys).agg(*site_statistics(prob, modified))
    return sites.join(own, list(keys), "left").na.fill({"coverage": 0, "modified_prob_geometric": 0.0})


def plain_contig(contig: Column | str) -> Column:
    """Without a leading chr or Chr."""
    return F.regexp_replace(contig, "^[Cc]hr", "")


def genome_to_transcript(sites: DataFrame, ranges: DataFrame, chrom: str = "chr") -> DataFrame:
    """Sites (chr, s, e) on transcripts: both ends must lie on exons of the same transcript; one site may give many rows.

    ``ranges`` is the result of ``tx_ranges`` (with the column ``chrom``); places are found in bins of the exons.
    """
    size = 1024
    held = ranges.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("g_start") / size), F.floor(F.col("g_end") / size)))).select(F.col(chrom).alias("_chr"), "_bin", "tx_id", "strand", "g_start", "g_end", "tx_start", "tx_end")

    def at(rows: DataFrame, place: str, name: str) -> DataFrame:
        on = (plain_contig(rows[chrom].cast("string")) == plain_contig(held["_chr"].cast("string"))) & (F.floor(rows[place] / size) == held["_bin"]) & rows[place].between(held["g_start"], held["g_end"])
        pos = F.when(F.col("strand") == "+", F.col("tx_start") + F.col(place) - F.col("g_start")).otherwise(F.col("tx_end") - (F.col(place) - F.col("g_start")))
        return rows.join(held, on).select(*rows.columns, F.col("tx_id").alias(f"_{name}_tx"), pos.alias(f"tx_{name}"))

    return at(at(sites, "s", "s"), "e", "e").where("_s_tx = _e_tx").withColumnRenamed("_s_tx", "tx_id").drop("_e_tx")


def transcript_to_genome(df: DataFrame, ranges: DataFrame, pos: str = "tx_pos", size: int = 256, last: str | None = None) -> DataFrame:
    """``df(tx_id, tx_pos)`` with g_pos; places outside the transcript are left out.

    The exons of each bin of ``size`` places of a transcript, of which there are ``size`` at most, are one row, so each place meets one row of the map,
    however many exons its transcript has.

    With ``last``, a row of ``df`` stands for all places from ``pos`` to ``last``, and the result has one row for each: spans meet the exons of their bins
    and become places behind the join, so what is shuffled and sorted follows the spans and exons, not the places.
    """
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size)))
    if last is not None:
        rest = [c for c in df.columns if c not in ("tx_id", pos, last)]
        spans = df.where(F.col(last) >= F.col(pos)).withColumn("_bin", bins(pos, last))
        rows = spans.join(ranges.select("tx_id", "tx_start", "tx_end", "g_start", "g_end", "strand").withColumn("_bin", bins("tx_start", "tx_end")), ["tx_id", "_bin"])
        lo = F.greatest(F.col(pos), F.col("tx_start"), F.col("_bin") * size)
        hi = F.least(F.col(last), F.col("tx_end"), (F.col("_bin") + 1) * size - 1)
        rows = rows.select("tx_id", *rest, lo.alias("_lo"), hi.alias("_hi"), "tx_start", "strand", "g_start", "g_end").where("_lo <= _hi")
        rows = rows.select("tx_id", *rest, F.explode(F.sequence("_lo", "_hi")).alias(pos), "tx_start", "strand", "g_start", "g_end")
        d = F.col(pos) - F.col("tx_start")
        return rows.withColumn("g_pos", F.when(F.col("strand") == "+", F.col("g_start") + d).otherwise(F.col("g_end") - d)).drop("tx_start", "strand", "g_start", "g_end")
    exon = F.struct("tx_start", "tx_end", "g_start", "g_end", "strand")
    held = ranges.withColumn("_bin", bins("tx_start", "tx_end"))
    held = held.groupBy("tx_id", "_bin").agg(F.collect_list(exon).alias("_exons"))
    rows = df.withColumn("_bin", F.floor(F.col(pos) / size)).join(held, ["tx_id", "_bin"])
    rows = rows.withColumn("_exon", F.explode(F.filter("_exons", lambda x: F.col(pos).between(x["tx_start"], x["tx_end"]))))
    d = F.col(pos) - F.col("_exon.tx_start")
    return rows.withColumn("g_pos", F.when(F.col("_exon.strand") == "+", F.col("_exon.g_start") + d).otherwise(F.col("_exon.g_end") - d)).drop("_bin", "_exons", "_exon")


def annotate_modifications(segments: DataFrame, sites: DataFrame, base: str = "A") -> DataFrame:
    """Segments (seg_id, contig, ref_start, seq) with M at each true site that holds the base; ``sites(contig, pos, status)``."""
    true = sites.where("CAST(status AS DOUBLE) > 0").select("contig", "pos").distinct()
    size = 1024
    left = segments.where("length(seq) > 0").withColumn("_bin", F.explode(F.sequence(F.floor(F.col("ref_start") / size), F.floor((F.col("ref_start") + F.length("seq") - 1) / size))))
    right = true.withColumn("_bin", F.floor(F.col("pos") / size))
    inside = left.join(right, ["contig", "_bin"]).where((F.col("pos") >= F.col("ref_start")) & (F.col("pos") < F.col("ref_start") + F.length("seq")))
    marks = inside.groupBy("seg_id").agg(F.collect_set((F.col("pos") - F.col("ref_start")).cast("int")).alias("_at"))
    rows = segments.join(marks, "seg_id", "left")
    written = F.array_join(F.transform(letters("seq"), lambda b, i: F.when((b == base) & F.array_contains("_at", i), "M").otherwise(b)), "")
    return rows.withColumn("seq", F.when(F.col("_at").isNull(), F.col("seq")).otherwise(written)).drop("_at")


def reference_slices(reference: DataFrame, before: int, after: int, size: int = SLICE, contig: str = "contig") -> DataFrame:
    """contig, bin, slice_start, slice: the reference in pieces of ``size`` bases, each with its neighbours' margins, so that no row of a join carries a chromosome.

    A reference with a column ``start`` is one of lines (``read_fasta_lines``): each brings its bases to the slices that it touches, so no task sees a
    chromosome either.
    """
    if max(before, after) > size:
        raise ValueError("a window must fit into a slice and its neighbours")
    if "start" in reference.columns:
        stop = F.col("start") + F.length("seq")
        touched = F.sequence(F.greatest(F.floor((F.col("start") - after) / size), F.lit(0)), F.floor((stop - 1 + before) / size))
        rows = reference.where(F.length("seq") > 0).select(contig, "start", "seq", F.explode(touched).alias("bin"))
        lo = F.greatest(F.col("bin") * size - before, F.col("start"))
        hi = F.least((F.col("bin") + 1) * size + after, stop)
        part = F.substring("seq", (lo - F.col("start") + 1).cast("int"), (hi - lo).cast("int"))
        parts = rows.where(hi > lo).groupBy(contig, "bin").agg(F.array_sort(F.collect_list(F.struct(lo.alias("at"), part.alias("own")))).alias("parts"), F.max(hi).alias("hi"))
        # a bin behind the last base holds margins alone
        return parts.where(F.col("hi") > F.col("bin") * size).select(contig, "bin", F.get("parts", F.lit(0))["at"].alias("slice_start"), F.array_join("parts.own", "").alias("slice"))
    by = Window.partitionBy(contig).orderBy("bin")
    rows = reference.select(contig, F.posexplode(F.split("seq", rf"(?<=\G.{{{size}}})")).alias("bin", "own"))
    left, right = F.coalesce(F.right(F.lag("own").over(by), F.lit(before)), F.lit("")), F.coalesce(F.left(F.lead("own").over(by), F.lit(after)), F.lit(""))
    rows = rows.select(contig, F.col("bin").cast("long").alias("bin"), left.alias("left"), "own", right.alias("right"))
    return rows.select(contig, "bin", (F.col("bin") * size - F.length("left")).alias("slice_start"), F.concat("left", "own", "right").alias("slice"))


def ref_window(df: DataFrame, reference: DataFrame, before: int, after: int, pos: str = "refpos", contig: str = "contig", base: str | None = None) -> DataFrame:
    """``df`` with refseq, the reference around each place (and ``base``, the base there); contigs that the reference lacks are left out."""
    slices = reference_slices(reference, before, after, contig=contig)
    rows = df.withColumn("bin", F.floor(F.col(pos) / SLICE)).join(slices, [contig, "bin"])
    if base is not None:
        rows = rows.withColumn(base, F.upper(F.substring("slice", (F.col(pos) - F.col("slice_start") + 1).cast("int"), F.lit(1))))
    lo = F.greatest(F.col(pos) - before, F.lit(0))
    return rows.withColumn("refseq", F.upper(F.substring("slice", (lo - F.col("slice_start") + 1).cast("int"), (F.col(pos) + after - lo).cast("int")))).drop("bin", "slice_start", "slice")


def compare_pore_models(a: DataFrame, b: DataFrame, selection: str = "") -> DataFrame:
    """kmer, left_mean, right_mean of the selected k-mers that both models have."""
    return a.select("kmer", F.col("level_mean").alias("left_mean")).join(b.select("kmer", F.col("level_mean").alias("right_mean")), "kmer").where(select_kmers("kmer", selection))


def shifted_model(model: DataFrame, shift: float, base: str = "A", other: str = "M") -> DataFrame:
    """The model with each modified k-mer at its canonical k-mer's mean plus ``shift``; null where that is unknown."""
    plain = model.select(F.col("kmer").alias("_plain"), F.col("level_mean").alias("_mean"))
    rows = model.withColumn("_plain", F.translate("kmer", other, base)).join(plain, "_plain", "left")
    return rows.withColumn("level_mean", F.when(F.contains("kmer", F.lit(other)), F.col("_mean") + shift).otherwise(F.col("level_mean"))).drop("_plain", "_mean")


def full_shifted_model(model: DataFrame, shift: float) -> DataFrame:
    """A canonical model and every k-mer with modified bases, shifted."""
    rows = model.select(F.explode(kmer_alternatives("kmer")).alias("kmer"), "level_mean")
    return rows.withColumn("level_mean", F.col("level_mean") + F.when(F.contains("kmer", F.lit("M")), shift).otherwise(0.0))


def zip_truncate(chunks: DataFrame, seqs: DataFrame, key: str = "row", orders: tuple[str, str] | None = None) -> DataFrame:
    """Rows of both sides with the same number; the longer side is cut.

    Without ``orders``, both sides have their numbers in the column ``key``.  With them, rows are numbered from 0 in the order of a column of each side,
    over ranges of it; the result has the numbers as ``key``.
    """
    if orders is None:
        return chunks.join(seqs, key)
    left, right = (numbered(df, order, name=key).withColumn(key, F.col(key).cast("long") - 1) for df, order in zip((chunks, seqs), orders, strict=True))
    return left.join(right, key)


def alignment_read_lookup(signals: DataFrame, index: DataFrame, key: str = "read_id") -> DataFrame:
    """Signals with their alignment and ``reason``: unaligned, reverse, no_seq, name_mismatch, or null if usable.

    ``index(key, name, is_reverse, seq)``.
    """
    rows = signals.join(index.withColumn("_held", F.lit(True)), key, "left")
    reason = F.when(F.col("_held").isNull(), "unaligned").when(F.col("is_reverse"), "reverse").when(F.coalesce(F.length("seq"), F.lit(0)) == 0, "no_seq").when(F.col("name") != F.col(key).cast("string"), "name_mismatch")
    return rows.withColumn("reason", reason).drop("_held")
