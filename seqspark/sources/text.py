"""Readers and writers of the field's text formats, on Spark's own text and CSV sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from seqspark.functions.sequence import as_column, let, slices

# The columns of a table of yeast sites.
YEAST_COLUMNS = {"contig": "Peak chr", "peak": "Peak genomic coordinate", "distance": "Distance from peak to nearest RGAC site"}
SAM_FIELDS = (("read_id", "string"), ("flag", "int"), ("contig", "string"), ("pos", "int"), ("mapq", "int"), ("cigar", "string"), ("rnext", "string"), ("pnext", "int"), ("tlen", "int"), ("seq", "string"), ("quality", "string"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """contig, seq, length.  Records are split at ``>``; the id is the header's first word; empty headers are skipped."""
    rows = spark.read.text(path, lineSep=">").select(F.regexp_extract("value", r"^([^\r\n]*)", 1).alias("head"), F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s", "").alias("seq"))
    rows = rows.select(F.get(F.split(F.trim("head"), r"\s+"), F.lit(0)).alias("contig"), "seq").where("contig <> ''")
    return rows.withColumn("length", F.length("seq").cast("long"))


def _numbered_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Lines with their file, block and an ascending id, and the blocks' first ids and sizes; both from the same scan, so places agree."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    return lines, lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))


def read_fasta_lines(spark: SparkSession, path: str, longest: int = 1 << 16) -> DataFrame:
    """contig, start, seq: the lines of FASTA records, each with its 0-based place in the record; lines over ``longest`` bases are several rows.

    Files are split as Spark splits text.  A line's place is the sum of the lengths before it in its block and in the blocks before, less
    that of its header; a block's lines are one task, so a chromosome is as many tasks as it has blocks.  Text before a file's first header, and records with an
    empty header, are left out.
    """
    lines, _ = _numbered_lines(spark, path)
    head = F.col("value").startswith(">")
    rows = lines.select("file", "block", "id", F.when(head, F.coalesce(F.get(F.split(F.trim(F.substring("value", F.lit(2), F.length("value"))), r"\s+"), F.lit(0)), F.lit(""))).alias("name"), F.when(head, F.lit("")).otherwise(F.regexp_replace("value", r"\s", "")).alias("seq"))
    inside = Window.partitionBy("file", "block").orderBy("id")
    sums = rows.withColumn("at", F.sum(F.length("seq")).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.length("seq"))
    header = F.when(F.col("name").isNotNull(), F.struct("name", "at"))
    sums = sums.withColumn("own", F.last(header, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    # one row for each block of a file: its length, and the last header in it
    ends = rows.groupBy("file", "block").agg(F.sum(F.length("seq")).alias("size"), F.max(F.when(F.col("name").isNotNull(), F.struct("id", "name"))).alias("head"))
    behind = rows.join(ends.select("file", "block", F.col("head.id").alias("_head")), ["file", "block"]).groupBy("file", "block").agg(F.sum(F.when(F.col("id") > F.coalesce("_head", F.lit(-1)), F.length("seq"))).alias("tail"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = ends.join(behind, ["file", "block"]).withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    mark = F.when(F.col("head").isNotNull(), F.struct(F.col("head.name").alias("name"), (F.col("before") + F.col("size") - F.coalesce("tail", F.lit(0))).alias("at")))
    blocks = blocks.withColumn("carried", F.last(mark, ignorenulls=True).over(earlier)).select("file", "block", "before", "carried")
    placed = sums.where("seq <> ''").join(blocks, ["file", "block"])
    start = F.when(F.col("own").isNotNull(), F.col("at") - F.col("own.at")).otherwise(F.col("before") + F.col("at") - F.col("carried.at"))
    placed = placed.select(F.coalesce("own.name", "carried.name").alias("contig"), start.alias("start"), "seq").where("contig <> ''")
    pieces = F.posexplode(F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{longest}}}"), F.lit(0)))
    return placed.select("contig", "start", pieces.alias("_n", "seq")).select("contig", (F.col("start") + F.col("_n") * longest).alias("start"), "seq")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """name, sequence, quality of four-line records; an error where the third line is no ``+``; a last record of fewer lines is left out.

    Files are split as Spark splits text.  A line's number in its file is its place in its block and the lines of the blocks before;
    both come from the same scan, so places agree.
    """
    lines, blocks = _numbered_lines(spark, path)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    rows = lines.join(blocks, ["file", "block"]).select("file", "value", (F.col("before") + F.col("id") - F.col("first")).alias("no"))
    parts = [F.max(F.when(F.col("no") % 4 == i, F.regexp_replace("value", "\r$", ""))).alias(c) for i, c in enumerate(("name", "sequence", "plus", "quality"))]
    rows = rows.groupBy("file", F.floor(F.col("no") / 4).alias("record")).agg(*parts).where("quality IS NOT NULL")
    checked = F.when(F.col("plus").startswith("+"), F.col("sequence")).otherwise(F.raise_error(F.concat(F.lit("no + line in record "), F.col("name"))).cast("string"))
    return rows.select(F.regexp_replace("name", "^@", "").alias("name"), checked.alias("sequence"), "quality")


def write_fastq(df: DataFrame, path: str, name: str = "name", sequence: str = "sequence", quality: str = "quality") -> None:
    df.select(F.concat(F.lit("@"), F.concat_ws("\n", name, sequence, F.lit("+"), quality)).alias("value")).write.text(path)


def write_fasta(df: DataFrame, path: str, name: str = "contig", sequence: str = "seq", wrap: int | None = None) -> None:
    """``wrap`` cuts sequences into lines of so many letters."""
    lines = F.col(sequence) if wrap is None else F.array_join(slices(sequence, wrap), "\n")
    df.select(F.concat(F.lit(">"), F.concat_ws("\n", F.col(name), lines)).alias("value")).write.text(path)


#: A map from a tag's two letters to its type letter and the text of its value; the value of a B tag begins with its number type.
TAGS = "map<string,struct<type:string,value:string>>"


def parse_tags(fields: Column) -> Column:
    """Tags of ``NM:i:3`` fields, in their order; the first of a name counts, fields of another form are left out."""
    own = F.filter(fields, lambda t: F.regexp_like(t, F.lit("^[A-Za-z][A-Za-z0-9]:[A-Za-z]:")))
    own = F.transform(own, lambda t: F.struct(F.substring(t, 1, 2).alias("key"), F.struct(F.substring(t, 4, 1).alias("type"), F.substring(t, F.lit(6), F.length(t)).alias("value")).alias("value")))
    return let(own, lambda x: F.map_from_entries(F.filter(x, lambda t, i: i == F.array_position(F.transform(x, lambda y: y["key"]), t["key"]) - 1))).cast(TAGS)


def tag_text(tags: Column) -> Column:
    """The fields of a map of tags."""
    return F.transform(F.map_entries(tags), lambda t: F.concat_ws(":", t["key"], t["value"]["type"], t["value"]["value"]))


def tag_value(tags: Column | str, name: str, kind: str = "string") -> Column:
    """A tag's value as ``kind``; of a B tag, its numbers as an array of ``kind``.  Null without the tag."""
    tag = F.try_element_at(as_column(tags), F.lit(name))
    if kind.startswith("array"):
        numbers = F.filter(F.split(tag["value"], ","), lambda x, i: (i > 0) & (x != ""))
        return F.when(tag["type"] == "B", numbers.cast(kind))
    return tag["value"].cast(kind)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """The eleven fields, tags (see ``TAGS``), and line_no, which ascends with the alignments of a file and, in a folder, with the names of its files.  Positions become 0-based; header
    lines are left out.

    Spark reads a folder's files by size, so a line's number is its place in its block and the lines of the blocks before, by file and place.
    """
    f = F.split("value", "\t")
    fields = [F.get(f, F.lit(i)).cast(kind).alias(name) if name != "pos" else (F.get(f, F.lit(i)).cast("int") - 1).alias("pos") for i, (name, kind) in enumerate(SAM_FIELDS)]
    tags = parse_tags(F.slice(f, F.lit(12), F.greatest(F.size(f) - 11, F.lit(0))))
    lines, blocks = _numbered_lines(spark, path)
    earlier = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("_shift"))
    rows = lines.join(F.broadcast(blocks), ["file", "block"]).withColumn("line_no", F.col("id") + F.col("_shift"))
    return rows.where(~F.col("value").startswith("@") & (F.col("value") != "")).select(*fields, tags.alias("tags"), "line_no")


def read_sam_headers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.col("value").startswith("@")).withColumnRenamed("value", "line")


def ml_values(text: Column | str) -> Column:
    """The integers of ``C,24,125,33``."""
    return F.transform(F.filter(F.slice(F.split(text, ","), F.lit(2), F.greatest(F.size(F.split(text, ",")) - 1, F.lit(0))), lambda x: x != ""), lambda x: x.cast("int"))


def program_headers(headers: list[str], program: str, line: str) -> list[str]:
    """Header lines with the program's own line replaced, or added and chained to the last program."""
    own = [h for h in headers if not (h.startswith("@PG") and f"\tID:{program}" in h)]
    programs = [p.removeprefix("ID:") for h in own if h.startswith("@PG") for p in h.split("\t") if p.startswith("ID:")]
    return [*own, f"@PG\tID:{program}\t{line}" + (f"\tPP:{programs[-1]}" if programs else "")]


def sam_lines(df: DataFrame) -> DataFrame:
    """One text line for each alignment.

    Tags keep their types and order.  ``mm`` and ``ml`` (array), where given, take the places of the tags MM and ML, or come last; a row whose ``mm`` is null
    keeps its own.
    """
    fields = [(F.col("pos") + 1).cast("string") if name == "pos" else F.col(name).cast("string") for name, _ in SAM_FIELDS]
    tags = F.coalesce(F.col("tags"), F.map_from_entries(F.array().cast("array<struct<key:string,value:struct<type:string,value:string>>>"))) if "tags" in df.columns else F.create_map().cast(TAGS)
    if "mm" in df.columns:
        ml = F.concat(F.lit("C"), F.when(F.size("ml") > 0, F.concat(F.lit(","), F.array_join(F.col("ml").cast("array<string>"), ","))).otherwise(F.lit("")))
        own = F.create_map(F.lit("MM"), F.struct(F.lit("Z").alias("type"), F.col("mm").alias("value")), F.lit("ML"), F.struct(F.lit("B").alias("type"), ml.alias("value")))
        kept = F.transform_values(tags, lambda k, v: F.coalesce(F.try_element_at(own, k), v))
        last = F.map_filter(own, lambda k, _: ~F.map_contains_key(tags, k))
        tags = F.when(F.col("mm").isNull(), tags).otherwise(F.map_concat(kept, last))
    return df.select(F.concat_ws("\t", *fields, tag_text(tags)).alias("line"), *(["line_no"] if "line_no" in df.columns else []))


def write_sam_tagged(df: DataFrame, headers: list[str], path: str, program: str, line: str) -> None:
    """Header lines, then alignments in the order of ``line_no`` where given, else in the order of the rows.

    A folder of text files: rows are ranged over parts, whose names ascend with the lines, and the header, a bounded list, is first in the first part.
    """
    head = df.sparkSession.createDataFrame([(i, h) for i, h in enumerate(program_headers(headers, program, line))], "line_no long, line string").withColumn("part", F.lit(0))
    body = sam_lines(df)
    body = body if "line_no" in df.columns else body.withColumn("line_no", F.monotonically_increasing_id())
    head.unionByName(body.withColumn("part", F.lit(1))).orderBy("part", "line_no").select("line").write.text(path)


def read_annotation(spark: SparkSession, path: str, fmt: str = "gtf", features: tuple[str, ...] = ("exon", "CDS")) -> DataFrame:
    """tx_id, gene_id, chr, strand, start, end, ord of exons; CDS rows stand in for transcripts without an exon.

    GTF: the transcript id gets ``.version``, or ``.1`` if it has no dot.  GFF3: the id (else the parent) after its first colon;
    a gene id missing on an exon comes from its transcript's row.
    """
    if fmt not in ("gtf", "gff3"):
        raise ValueError(f"no annotation format {fmt!r}")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != "")).select(F.monotonically_increasing_id().alias("line"), F.split("value", "\t").alias("f"))
    rows = rows.select("line", F.regexp_replace(F.get("f", F.lit(0)), "^[Cc]hr", "").alias("chr"), F.get("f", F.lit(2)).alias("type"), F.get("f", F.lit(3)).cast("long").alias("start"), F.get("f", F.lit(4)).cast("long").alias("end"), F.get("f", F.lit(6)).alias("strand"), F.get("f", F.lit(8)).alias("attributes"))
    if fmt == "gtf":
        get = lambda k: F.nullif(F.regexp_extract("attributes", rf'(?:^|;)\s*{k} "?([^";]*)"?', 1), F.lit(""))
        tx = get("transcript_id")
        version = F.when(F.contains(tx, F.lit(".")), tx).otherwise(F.concat(tx, F.lit("."), F.coalesce(get("transcript_version"), F.lit("1"))))
        rows = rows.where(F.col("type").isin(*features)).select("*", version.alias("tx_id"), get("gene_id").alias("gene_id"))
    else:
        get = lambda k: F.nullif(F.regexp_extract("attributes", rf"(?:^|;)\s*{k}=([^;]*)", 1), F.lit(""))
        plain = lambda c: F.regexp_replace(c, "^[^:]*:", "")
        parents = rows.where(~F.col("type").isin(*features)).select(plain(get("ID")).alias("tx_id"), F.coalesce(get("gene_id"), plain(get("Parent"))).alias("_gene")).where("tx_id IS NOT NULL").dropDuplicates(["tx_id"])
        rows = rows.where(F.col("type").isin(*features)).select("*", F.coalesce(plain(get("Parent")), plain(get("ID"))).alias("tx_id"), get("gene_id").alias("gene_id"))
        rows = rows.join(parents, "tx_id", "left").withColumn("gene_id", F.coalesce("gene_id", "_gene")).drop("_gene")
    # both windows have one order, so a task sorts its rows once
    own = Window.partitionBy("tx_id").orderBy("line")
    rows = rows.withColumn("_exons", F.count_if(F.col("type") == "exon").over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).where("type = 'exon' OR _exons = 0")
    return rows.select("tx_id", "gene_id", "chr", "strand", "start", "end", F.row_number().over(own).cast("long").alias("ord"))


def read_sites(spark: SparkSession, path: str, flavor: str, status: bool | None = None) -> DataFrame:
    """contig, s, e, status of a CSV of sites.

    yeast: rows at distance 0 of their peak; human: without null and unplaced contigs; at: without null contigs.  ``status``
    keeps the rows over, or under, one half.
    """
    rows = spark.read.csv(path, header=True)
    if flavor == "yeast":
        own = {k: F.col(f"`{c}`") for k, c in YEAST_COLUMNS.items()}
        rows = rows.where(own["distance"].cast("double") == 0).select(own["contig"].alias("contig"), own["peak"].cast("long").alias("s"), F.lit(1.0).alias("status"))
    elif flavor in ("human", "at"):
        rows = rows.where("chr IS NOT NULL")
        if flavor == "human":
            rows = rows.where("chr <> 'chr22_KI270734v1_random'")
        rows = rows.select(F.col("chr").alias("contig"), F.col("genomic_position").cast("long").alias("s"), F.col("modification_status").cast("double").alias("status"))
    else:
        raise ValueError(f"no flavor of sites {flavor!r}")
    rows = rows.select("contig", "s", F.col("s").alias("e"), "status")
    return rows if status is None else rows.where(F.col("status") > 0.5 if status else F.col("status") < 0.5)


def read_pore_model(spark: SparkSession, path: str, colon: bool = False) -> DataFrame:
    """kmer, level_mean and what else the table has; or ``KMER: mean`` lines."""
    if colon:
        return spark.read.text(path).where(F.contains("value", F.lit(":"))).select(F.trim(F.get(F.split("value", ":"), F.lit(0))).alias("kmer"), F.trim(F.get(F.split("value", ":"), F.lit(1))).cast("double").alias("level_mean"))
    rows = spark.read.csv(path, sep="\t", header=True)
    return rows.select("kmer", *(F.col(c).cast("double").alias(c) for c in rows.columns if c != "kmer"))


def write_pore_model(df: DataFrame, path: str, colon: bool = False) -> None:
    """At most 5**k rows, sorted."""
    if colon:
        df.orderBy("kmer").select(F.concat(F.col("kmer"), F.lit(": "), F.format_string("%.2f", "level_mean")).alias("value")).write.text(path)
    else:
        df.orderBy("kmer").write.csv(path, sep="\t", header=True)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_dataset(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def read_read_index(spark: SparkSession, path: str, replace_prefix: tuple[str, str] | None = None) -> DataFrame:
    """read_id, file of a TSV; the prefix of the paths may be rewritten."""
    rows = spark.read.csv(path, sep="\t", header=True).select("read_id", "file")
    if replace_prefix:
        old, new = replace_prefix
        rows = rows.withColumn("file", F.when(F.col("file").startswith(old), F.concat(F.lit(new), F.substring("file", F.lit(len(old) + 1), F.length("file")))).otherwise(F.col("file")))
    return rows


def write_pileup_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """contig first; sorted by contig and refpos over all parts; one header, at the start of the first part.

    Rows are ranged by their places, so a large contig is many tasks.
    """
    columns = ["contig", *(c for c in df.columns if c != "contig")]
    line = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    rows = df.select(F.lit(1).alias("part"), F.col("contig").cast("string").alias("contig"), F.col("refpos").cast("long").alias("refpos"), line.alias("line"))
    head = df.sparkSession.createDataFrame([(0, None, None, "\t".join(columns))], "part int, contig string, refpos long, line string")
    head.unionByName(rows).orderBy("part", "contig", "refpos").select("line").write.mode(mode).text(path)


def read_pileup_tsv(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_pileup_tsv`` wrote, as text columns; the header may stand in any part."""
    rows = spark.read.text(path)
    head = rows.where(F.col("value").startswith("contig\t")).first()
    columns = head["value"].split("\t") if head else ["contig", "refpos"]
    f = F.split("value", "\t", -1)
    return rows.where(F.col("value") != "\t".join(columns)).select(*(F.get(f, F.lit(i)).alias(c) for i, c in enumerate(columns)))
