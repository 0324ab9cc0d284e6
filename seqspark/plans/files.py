"""Queries that write tables in the field's text formats below the shared folder and read them back."""

from pyspark.sql import functions as F

from seqspark.functions.sequence import evaluated
from seqspark.functions.tags import mm_from_seq, mm_text, parse_mm
from seqspark.operators import joins as J
from seqspark.operators.ranks import numbered
from seqspark.plans.catalog import query
from seqspark.plans.reads import _DUCK_A, _DUCK_MODEL, _Q, _DUCK_BASES, model, quality
from seqspark.shared import shared_path as _folder
from seqspark.sources import text as X


@query("fasta_roundtrip", "fx_ref", sql="SELECT CAST(contig AS VARCHAR) AS contig, seq, length FROM fx_ref WHERE seq <> ''")
def fasta_roundtrip(ref):
    path = _folder(ref.sparkSession, "fasta")
    X.write_fasta(ref.where("seq <> ''").select(F.concat(F.col("contig").cast("string"), F.lit(" a reference")).alias("contig"), "seq"), path)
    return X.read_fasta(ref.sparkSession, path)


@query("fasta_lines", "fx_ref", sql="""WITH r AS (SELECT CAST(contig AS VARCHAR) AS contig, seq, length, unnest(range(0, (length + 63) // 64)) AS n FROM fx_ref WHERE seq <> '')
SELECT contig, n * 64 AS start, seq[n * 64 + 1 : n * 64 + 64] AS seq FROM r""")
def fasta_lines(ref):
    path = _folder(ref.sparkSession, "fasta")
    X.write_fasta(ref.where("seq <> ''").select(F.col("contig").cast("string").alias("contig"), "seq"), path, wrap=64)
    return X.read_fasta_lines(ref.sparkSession, path)


@query("fasta_slices", "fx_ref", sql="""WITH r AS (SELECT CAST(contig AS VARCHAR) AS contig, seq, length, unnest(range(0, (length + 255) // 256)) AS bin FROM fx_ref WHERE seq <> '')
SELECT contig, bin, greatest(bin * 256 - 5, 0) AS slice_start, seq[greatest(bin * 256 - 5, 0) + 1 : (bin + 1) * 256 + 7] AS slice FROM r""")
def fasta_slices(ref):
    path = _folder(ref.sparkSession, "fasta")
    X.write_fasta(ref.where("seq <> ''").select(F.col("contig").cast("string").alias("contig"), "seq"), path, wrap=70)
    return J.reference_slices(X.read_fasta_lines(ref.sparkSession, path), 5, 7)


@query("fastq_roundtrip", "fx_reads", sql=f"WITH {_DUCK_BASES} SELECT CAST(read_id AS VARCHAR) AS name, any_value(seq) AS sequence, string_agg(chr(CAST(33 + {_Q} AS INTEGER)), '' ORDER BY k) AS quality FROM b GROUP BY read_id")
def fastq_roundtrip(reads):
    path = _folder(reads.sparkSession, "fastq")
    X.write_fastq(quality(reads.where("seq <> ''")).select(F.col("read_id").cast("string").alias("name"), F.col("seq").alias("sequence"), "quality"), path)
    return X.read_fastq(reads.sparkSession, path)


@query("sam_roundtrip", "fx_reads", sql=f"""WITH {_DUCK_A}, m AS (SELECT read_id, count(*) FILTER (c = 'M') AS n, CAST(coalesce(sum(v), 0) AS BIGINT) AS total FROM a GROUP BY read_id)
SELECT CAST(r.read_id AS VARCHAR) AS read_id, 0 AS pos, replace(r.seq, 'M', 'A') AS seq, length(r.seq) || 'M' AS cigar, coalesce(m.n, 0) AS n_mods, coalesce(m.total, 0) AS total,
       'NM:i:' || r.read_id % 7 || CASE WHEN r.read_id % 2 = 0 THEN '' ELSE ' de:f:0.25' END || ' mv:B:c,5,1,0,' || r.read_id % 2 || ' RG:Z:a:b' || CASE WHEN r.read_id % 3 = 0 THEN '' ELSE ' tp:A:P' END AS others, CAST(r.read_id % 7 AS INTEGER) AS nm, CAST(1 + r.read_id % 2 AS BIGINT) AS moves,
       row_number() OVER (ORDER BY r.read_id DESC) AS place
FROM fx_reads r LEFT JOIN m ON m.read_id = r.read_id WHERE r.seq <> ''""")
def sam_roundtrip(reads):
    path = _folder(reads.sparkSession, "sam")
    own = evaluated(quality(reads.where("seq <> ''")), "t", mm_from_seq("seq", "quality"))
    even, third = F.col("read_id") % 2 == 0, F.col("read_id") % 3 == 0
    # an old MM tag in the middle gives way to the new one
    other = F.concat_ws(" ", F.concat(F.lit("NM:i:"), (F.col("read_id") % 7).cast("string")), F.when(~even, F.lit("de:f:0.25")), F.lit("MM:Z:A+a?,9;"), F.concat(F.lit("mv:B:c,5,1,0,"), (F.col("read_id") % 2).cast("string")), F.lit("RG:Z:a:b"), F.when(~third, F.lit("tp:A:P")))
    rows = own.select(F.col("read_id").cast("string").alias("read_id"), F.lit(0).alias("flag"), F.col("read_id").cast("string").alias("contig"), F.lit(0).alias("pos"), F.lit(60).alias("mapq"), F.concat(F.length("seq"), F.lit("M")).alias("cigar"), F.lit("*").alias("rnext"), F.lit(0).alias("pnext"), F.lit(0).alias("tlen"), F.col("t.seq").alias("plain"), "quality", mm_text("t.gaps").alias("mm"), F.col("t.likelihoods").alias("ml"), X.parse_tags(F.split(other, " ")).alias("tags"), (-F.col("read_id")).alias("line_no"))
    rows = rows.withColumnRenamed("plain", "seq")
    X.write_sam_tagged(rows, ["@HD\tVN:1.6", "@PG\tID:caller\tVN:1"], path, "seqspark", "VN:1")
    back = X.read_sam(reads.sparkSession, path)
    others = F.array_join(X.tag_text(F.map_filter("tags", lambda k, _: ~k.isin("MM", "ML"))), " ")
    moves = F.aggregate(X.tag_value("tags", "mv", "array<int>"), F.lit(-5).cast("long"), lambda a, x: a + x)
    groups = evaluated(numbered(back, "line_no", name="place"), "g", F.try_element_at(parse_mm(X.tag_value("tags", "MM"), X.tag_value("tags", "ML", "array<int>")), F.lit("A+a")))
    return groups.select("read_id", "pos", "seq", "cigar", F.size("g.gaps").cast("long").alias("n_mods"), F.aggregate("g.likelihoods", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), others.alias("others"), X.tag_value("tags", "NM", "int").alias("nm"), moves.alias("moves"), F.col("place").cast("long").alias("place"))


@query("annotation_roundtrip", "fx_exons", sql="SELECT 't' || tx_id || '.2' AS tx_id, 'g' || CAST(tx_id // 3 AS BIGINT) AS gene_id, '1' AS chr, strand, g_start AS start, g_end AS \"end\", ord FROM fx_exons")
def annotation_roundtrip(exons):
    path = _folder(exons.sparkSession, "gtf")
    gene = F.floor(F.col("tx_id") / 3).cast("string")
    attributes = F.concat(F.lit('gene_id "g'), gene, F.lit('"; transcript_id "t'), F.col("tx_id").cast("string"), F.lit('"; transcript_version "2";'))
    kind = F.when(F.col("tx_id") % 5 == 0, "CDS").otherwise("exon")
    line = F.concat_ws("\t", F.lit("chr1"), F.lit("made"), kind, F.col("g_start").cast("string"), F.col("g_end").cast("string"), F.lit("."), "strand", F.lit("."), attributes)
    exons.repartitionByRange("tx_id").sortWithinPartitions("tx_id", "ord").select(line.alias("value")).write.text(path)
    return X.read_annotation(exons.sparkSession, path)


@query("sites_csv", "fx_mod_sites", sql="SELECT 'chr' || (contig % 20) AS contig, pos AS s, pos AS e, CAST(status AS DOUBLE) AS status FROM fx_mod_sites WHERE contig % 20 > 0 AND status > 0.5")
def sites_csv(sites):
    path = _folder(sites.sparkSession, "sites")
    chrom = F.when(F.col("contig") % 20 > 0, F.concat(F.lit("chr"), (F.col("contig") % 20).cast("string")))
    sites.select(chrom.alias("chr"), F.col("pos").alias("genomic_position"), F.col("status").alias("modification_status")).write.csv(path, header=True)
    return X.read_sites(sites.sparkSession, path, "human", status=True)


@query("pore_model_io", "fx_reads", sql=f"WITH {_DUCK_MODEL} SELECT kmer, level_mean, round(level_mean, 2) AS short_mean FROM m")
def pore_model_io(reads):
    own, spark = model(reads), reads.sparkSession
    table, lines = _folder(spark, "model"), _folder(spark, "model")
    X.write_pore_model(own, table)
    X.write_pore_model(own, lines, colon=True)
    return X.read_pore_model(spark, table).join(X.read_pore_model(spark, lines, colon=True).withColumnRenamed("level_mean", "short_mean"), "kmer")


@query("dataset_io", "fx_chunks", sql="SELECT chunk_id, duration, CAST(len(signal) AS INTEGER) AS n FROM fx_chunks")
def dataset_io(chunks):
    path = _folder(chunks.sparkSession, "dataset")
    X.write_dataset(chunks, path)
    return X.read_dataset(chunks.sparkSession, path).select("chunk_id", "duration", F.size("signal").alias("n"))


@query("index_io", "fx_reads", sql="SELECT CAST(read_id AS VARCHAR) AS read_id, '/new/' || contig || '.fast5' AS file FROM fx_reads")
def index_io(reads):
    path = _folder(reads.sparkSession, "index")
    reads.select("read_id", F.concat(F.lit("/old/"), "contig", F.lit(".fast5")).alias("file")).write.csv(path, sep="\t", header=True)
    return X.read_read_index(reads.sparkSession, path, ("/old/", "/new/"))


@query("pileup_tsv", "fx_aln", sql="SELECT CAST(contig AS VARCHAR) AS contig, CAST(r_start AS VARCHAR) AS refpos, read_id FROM fx_aln WHERE modified")
def pileup_tsv(aln):
    path = _folder(aln.sparkSession, "pileup")
    X.write_pileup_tsv(aln.where("modified").select(F.col("r_start").alias("refpos"), "contig", "read_id"), path)
    return X.read_pileup_tsv(aln.sparkSession, path)
