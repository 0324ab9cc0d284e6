"""Queries over read sequences: scalar functions, k-mers, tags, alignments and pileups."""

from pyspark.sql import DataFrame, functions as F

from seqspark.functions import sequence as S, tags as T
from seqspark.operators import aggregates as A, filters as P, joins as J, pileup as L
from seqspark.plans.catalog import query

# Quality of the k-th base (from 1) of a read, the same in both engines.
_Q = "(read_id * 31 + k * 17) % 40"
_DUCK_BASES = "b AS (SELECT read_id, seq, unnest(string_split(seq, '')) AS c, generate_subscripts(string_split(seq, ''), 1) AS k FROM fx_reads WHERE seq <> '')"
_DUCK_A = f"""{_DUCK_BASES},
a AS (SELECT read_id, k, c, row_number() OVER (PARTITION BY read_id ORDER BY k) - 1 AS i,
      CASE WHEN c = 'M' THEN CAST(floor(256 * pow(10.0::DOUBLE, -({_Q}) / 10.0::DOUBLE)) AS INTEGER) ELSE 0 END AS v FROM b WHERE c IN ('A', 'M'))"""


def quality(reads: DataFrame) -> DataFrame:
    """Reads with a made-up quality string."""
    return reads.withColumn("quality", F.expr("array_join(transform(if(length(seq) > 0, sequence(1, length(seq)), cast(array() AS array<int>)), k -> chr(33 + (read_id * 31 + k * 17) % 40)), '')"))


@query("m6a_ratio", "fx_reads", sql="SELECT CAST(sum(length(regexp_replace(seq, '[^M]', '', 'g'))) AS BIGINT) AS n_m, CAST(sum(length(regexp_replace(seq, '[^AM]', '', 'g'))) AS BIGINT) AS n_am, round(sum(length(regexp_replace(seq, '[^M]', '', 'g'))) / sum(length(regexp_replace(seq, '[^AM]', '', 'g'))), 6) AS ratio FROM fx_reads")
def m6a_ratio(reads):
    return A.m6a_ratio(reads).select("n_m", "n_am", F.round("ratio", 6).alias("ratio"))


@query("m6a_ratio_per_read", "fx_reads", sql="SELECT read_id, CASE WHEN length(regexp_replace(seq, '[^AM]', '', 'g')) = 0 THEN 'NaN'::DOUBLE ELSE round(length(regexp_replace(seq, '[^M]', '', 'g')) / length(regexp_replace(seq, '[^AM]', '', 'g')), 6) END AS ratio FROM fx_reads")
def m6a_ratio_per_read(reads):
    return A.m6a_ratio(reads, per_read=True).select("read_id", F.round("ratio", 6).alias("ratio"))


@query("revcomp", "fx_reads", sql="""WITH b AS (SELECT read_id, unnest(string_split(seq, '')) AS c, generate_subscripts(string_split(seq, ''), 1) AS k FROM fx_reads)
SELECT read_id, string_agg(CASE c WHEN 'A' THEN 'T' WHEN 'C' THEN 'G' WHEN 'G' THEN 'C' WHEN 'T' THEN 'A' ELSE c END, '' ORDER BY k DESC) AS dna,
       string_agg(CASE c WHEN 'A' THEN 'U' WHEN 'C' THEN 'G' WHEN 'G' THEN 'C' WHEN 'T' THEN 'A' ELSE c END, '' ORDER BY k DESC) AS rna FROM b GROUP BY read_id""")
def revcomp(reads):
    return reads.select("read_id", S.reverse_complement("seq").alias("dna"), S.reverse_complement("seq", rna=True).alias("rna"))


@query("clean_bases", "fx_reads", sql="SELECT read_id, replace(replace(seq, 'M', 'A'), 'U', 'T') AS clean, replace(seq, 'A', 'M') AS all_m, replace(seq, 'M', 'A') AS all_a FROM fx_reads")
def clean_bases(reads):
    return reads.select("read_id", S.clean_repr("seq").alias("clean"), S.a_to_m("seq").alias("all_m"), S.m_to_a("seq").alias("all_a"))


_DUCK_KMERS = "k AS (SELECT read_id, seq[i : i + 4] AS kmer, i FROM (SELECT read_id, seq, unnest(range(1, length(seq) - 3)) AS i FROM fx_reads WHERE length(seq) >= 5))"


@query("kmer_counts", "fx_reads", sql=f"WITH {_DUCK_KMERS} SELECT kmer, count(*) AS n FROM k GROUP BY kmer")
def kmer_counts(reads):
    return reads.select(F.explode(S.kmers("seq", 5)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


@query("kmer_codes", "fx_reads", sql=f"""WITH {_DUCK_KMERS}, c AS (SELECT kmer, CAST(count(*) AS BIGINT) AS n FROM k GROUP BY kmer)
SELECT kmer, CAST((instr('ACGTM', kmer[1]) - 1) * 625 + (instr('ACGTM', kmer[2]) - 1) * 125 + (instr('ACGTM', kmer[3]) - 1) * 25 + (instr('ACGTM', kmer[4]) - 1) * 5 + instr('ACGTM', kmer[5]) - 1 AS BIGINT) AS code, n FROM c
UNION ALL SELECT '', -1, count(*) FROM fx_reads WHERE length(seq) < 5""")
def kmer_codes(reads):
    codes = reads.select(F.explode(S.kmer_codes("seq", 5)).alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    return codes.select(F.when(F.col("code") < 0, "").otherwise(S.index_kmer("code", 5)).alias("kmer"), "code", "n")


@query("m_kmer_counts", "fx_reads", sql=f"WITH {_DUCK_KMERS} SELECT kmer, count(*) AS n FROM k WHERE kmer LIKE 'M%' GROUP BY kmer")
def m_kmer_counts(reads):
    return A.m_kmer_counts(reads, 5)


@query("encode_bases", "fx_reads", sql=f"WITH {_DUCK_BASES} SELECT read_id, CAST(sum(instr('ACGTM', c)) AS BIGINT) AS code_sum, CAST(sum(instr('ACGTM', c) * k) AS BIGINT) AS weighted, any_value(seq) AS seq FROM b GROUP BY read_id")
def encode_bases(reads):
    codes = reads.where("seq <> ''").select("read_id", S.encode_bases("seq").alias("codes"))
    return codes.select("read_id", F.expr("CAST(aggregate(codes, 0L, (a, x) -> a + x) AS BIGINT)").alias("code_sum"), F.expr("aggregate(transform(codes, (x, i) -> CAST(x AS BIGINT) * (i + 1)), 0L, (a, x) -> a + x)").alias("weighted"), S.decode_bases("codes").alias("seq"))


@query("find_m", "fx_reads", sql=f"WITH {_DUCK_BASES} SELECT read_id, CAST(k - 1 AS BIGINT) AS pos FROM b WHERE c = 'M'")
def find_m(reads):
    return reads.select("read_id", F.explode(S.find_all("seq", "M")).alias("pos")).select("read_id", F.col("pos").cast("long").alias("pos"))


@query("kmer_alternatives", "fx_reads", sql=f"""WITH {_DUCK_KMERS}, d AS (SELECT DISTINCT kmer FROM k WHERE kmer NOT LIKE '%M%' AND kmer LIKE '__A%'),
p AS (SELECT a.c || b.c || e.c || f.c || g.c AS alt FROM (VALUES ('A'),('C'),('G'),('T'),('M')) a(c), (VALUES ('A'),('C'),('G'),('T'),('M')) b(c), (VALUES ('A'),('C'),('G'),('T'),('M')) e(c), (VALUES ('A'),('C'),('G'),('T'),('M')) f(c), (VALUES ('A'),('C'),('G'),('T'),('M')) g(c))
SELECT d.kmer, p.alt FROM d JOIN p ON replace(p.alt, 'M', 'A') = d.kmer""")
def kmer_alternatives(reads):
    kmers = reads.select(F.explode(S.kmers("seq", 5)).alias("kmer")).distinct().where("kmer NOT LIKE '%M%' AND kmer LIKE '__A%'")
    return kmers.select("kmer", F.explode(S.kmer_alternatives("kmer")).alias("alt"))


_DUCK_MODEL = f"{_DUCK_KMERS}, d AS (SELECT DISTINCT kmer FROM k), m AS (SELECT kmer, round((instr('ACGTM', kmer[1]) * 7 + instr('ACGTM', kmer[3]) * 11 + instr('ACGTM', kmer[5])) / 3.0::DOUBLE, 6) AS level_mean FROM d)"


def model(reads: DataFrame) -> DataFrame:
    """A made-up pore model: the reads' 5-mers with a level that follows their letters."""
    return reads.select(F.explode(S.kmers("seq", 5)).alias("kmer")).distinct().selectExpr("kmer", "round((instr('ACGTM', substring(kmer, 1, 1)) * 7 + instr('ACGTM', substring(kmer, 3, 1)) * 11 + instr('ACGTM', substring(kmer, 5, 1))) / 3.0D, 6) AS level_mean")


@query("select_kmers", "fx_reads", sql=f"WITH {_DUCK_MODEL} SELECT kmer, level_mean FROM m WHERE contains(kmer, 'A') AND contains(kmer, 'C') AND NOT contains(kmer, 'M')")
def select_kmers(reads):
    return model(reads).where(P.select_kmers("kmer", "AC!M"))


@query("shifted_model", "fx_reads", sql=f"WITH {_DUCK_MODEL} SELECT m.kmer, CASE WHEN contains(m.kmer, 'M') THEN round(c.level_mean + 2.5, 6) ELSE m.level_mean END AS level_mean FROM m LEFT JOIN m c ON c.kmer = replace(m.kmer, 'M', 'A')")
def shifted_model(reads):
    return J.shifted_model(model(reads), 2.5).select("kmer", F.round("level_mean", 6).alias("level_mean"))


@query("compare_models", "fx_reads", sql=f"WITH {_DUCK_MODEL} SELECT m.kmer, m.level_mean AS left_mean, round(m.level_mean * 2, 6) AS right_mean FROM m WHERE contains(m.kmer, 'A') AND NOT contains(m.kmer, 'M')")
def compare_models(reads):
    own = model(reads)
    return J.compare_pore_models(own, own.select("kmer", (F.col("level_mean") * 2).alias("level_mean")), "A!M").select("kmer", "left_mean", F.round("right_mean", 6).alias("right_mean"))


def _encoded(reads: DataFrame) -> DataFrame:
    return S.evaluated(quality(reads.where("seq <> ''")), "x", T.mm_from_seq("seq", "quality")).select("read_id", "x.*")


@query("mm_encode", "fx_reads", sql=f"""WITH {_DUCK_A}, m AS (SELECT read_id, i - coalesce(lag(i) OVER (PARTITION BY read_id ORDER BY i), -1) - 1 AS gap, i, v FROM a WHERE c = 'M')
SELECT r.read_id, replace(r.seq, 'M', 'A') AS seq, 'A+a?' || coalesce(string_agg(',' || gap, '' ORDER BY i), '') || ';' AS mm, coalesce(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i), '') AS ml
FROM fx_reads r LEFT JOIN m ON m.read_id = r.read_id WHERE r.seq <> '' GROUP BY r.read_id, r.seq""")
def mm_encode(reads):
    return _encoded(reads).select("read_id", "seq", T.mm_text("gaps").alias("mm"), F.array_join(F.col("likelihoods").cast("array<string>"), ",").alias("ml"))


@query("mm_parse", "fx_reads", sql=f"""WITH {_DUCK_A}, m AS (SELECT read_id, i - coalesce(lag(i) OVER (PARTITION BY read_id ORDER BY i), -1) - 1 AS gap, i, v FROM a WHERE c = 'M')
SELECT read_id, 'A+a' AS code, count(*) AS n, CAST(sum(gap) AS BIGINT) AS gaps, CAST(sum(v) AS BIGINT) AS likelihoods FROM m GROUP BY read_id
UNION ALL SELECT read_id, 'C+m', 1, 4, 7 FROM m GROUP BY read_id""")
def mm_parse(reads):
    # a second group after the first: likelihoods are dealt out in order
    own = _encoded(reads).where("size(gaps) > 0").select("read_id", F.concat(T.mm_text("gaps"), F.lit("C+m.,4;")).alias("mm"), F.array_append("likelihoods", F.lit(7)).alias("ml"))
    groups = own.select("read_id", F.explode(T.parse_mm("mm", "ml")).alias("code", "g"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return groups.select("read_id", "code", F.size("g.gaps").cast("long").alias("n"), total(F.col("g.gaps")).alias("gaps"), total(F.col("g.likelihoods")).alias("likelihoods"))


@query("mm_expand", "fx_reads", sql=f"WITH {_DUCK_A} SELECT read_id, CAST(i AS BIGINT) AS base_no, v AS likelihood FROM a")
def mm_expand(reads):
    own = _encoded(reads).select("read_id", T.pad_ml(T.expand_mm("gaps", "likelihoods"), F.length("seq") - F.length(F.translate("seq", "A", ""))).alias("v"))
    return own.select("read_id", F.posexplode("v").alias("base_no", "likelihood")).select("read_id", F.col("base_no").cast("long").alias("base_no"), "likelihood")


@query("mm_flat", "fx_reads", sql=f"""WITH {_DUCK_A}, z AS (SELECT read_id, i, v, i - coalesce(lag(i) OVER (PARTITION BY read_id ORDER BY i), -1) - 1 AS gap FROM a WHERE v <> 0),
f AS (SELECT read_id, count(*) AS flat FROM a GROUP BY read_id)
SELECT f.read_id, f.flat, coalesce(string_agg(CAST(gap AS VARCHAR), ',' ORDER BY i), '') AS gaps, coalesce(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i), '') AS likelihoods FROM f LEFT JOIN z ON z.read_id = f.read_id GROUP BY f.read_id, f.flat""")
def mm_flat(reads):
    own = _encoded(reads).select("read_id", T.pad_ml(T.expand_mm("gaps", "likelihoods"), F.length("seq") - F.length(F.translate("seq", "A", ""))).alias("v")).where("size(v) > 0")
    own = own.select("read_id", T.encode_mm("v").alias("m"), T.encode_mm("v", merged=False).alias("f"))
    return own.select("read_id", F.size("f.gaps").cast("long").alias("flat"), F.array_join(F.col("m.gaps").cast("array<string>"), ",").alias("gaps"), F.array_join(F.col("m.likelihoods").cast("array<string>"), ",").alias("likelihoods"))


@query("int8", "fx_scores", sql="SELECT code, count(*) AS n FROM (SELECT CASE WHEN score >= 1 THEN 255 ELSE CAST(floor(score * 256) AS INTEGER) END AS code FROM fx_scores WHERE score BETWEEN 0 AND 1) GROUP BY code")
def int8(scores):
    return scores.where("score BETWEEN 0 AND 1").select(T.int8_encode("score").alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query("phred", "fx_reads", sql=f"WITH {_DUCK_BASES} SELECT read_id, string_agg(chr(CAST(33 + {_Q} AS INTEGER)), '' ORDER BY k) AS text, CAST(sum({_Q}) AS BIGINT) AS total FROM b GROUP BY read_id")
def phred(reads):
    q = quality(reads.where("seq <> ''")).select("read_id", T.phred_ints("quality").alias("q"))
    return q.select("read_id", T.phred_string("q").alias("text"), F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


# One of five alignments for each read: clips, insertions, deletions of one and three bases; reads too short for them match as a whole.
_CIGARS = ("concat(length(seq), 'M')", "concat('5H', length(seq), 'M3H')", "concat('2S', length(seq) - 2, 'M')", "concat('4M1D', length(seq) - 4, 'M')", "concat('3M2I', length(seq) - 9, 'M3D4M')")
_FORM = "CASE WHEN length(seq) < 20 THEN 0 ELSE read_id % 5 END"
_ALIGNED = f"SELECT read_id, seq, {_FORM} AS k, CASE {_FORM} WHEN 1 THEN 5 ELSE 0 END AS lead, CASE {_FORM} WHEN 1 THEN 3 ELSE 0 END AS trail FROM fx_reads WHERE seq <> ''"


def aligned(reads: DataFrame) -> DataFrame:
    """Reads with a CIGAR that follows their id; a read without bases has no alignment."""
    return reads.where("seq <> ''").selectExpr("read_id", "contig", "seq", f"CASE {_FORM} {' '.join(f'WHEN {i} THEN {c}' for i, c in enumerate(_CIGARS))} END AS cigar")


@query("cigar_stats", "fx_reads", sql=f"""SELECT read_id, lead AS leading, trail AS trailing,
CAST(length(seq) - CASE k WHEN 2 THEN 2 WHEN 4 THEN 2 ELSE 0 END AS INTEGER) AS n_match, CASE k WHEN 3 THEN 1 WHEN 4 THEN 3 ELSE 0 END AS n_delete FROM ({_ALIGNED})""")
def cigar_stats(reads):
    return aligned(reads).select("read_id", S.hard_clips("cigar").alias("h"), S.count_cigar("cigar", "M").alias("n_match"), S.count_cigar("cigar", "D").alias("n_delete")).select("read_id", "h.*", "n_match", "n_delete")


@query("aligned_pairs", "fx_reads", sql=f"""WITH a AS ({_ALIGNED}), q AS (SELECT read_id, k, length(seq) AS n, unnest(range(0, length(seq))) AS qpos FROM a)
SELECT read_id, CAST(qpos AS INTEGER) AS qpos, CAST(7 + CASE k WHEN 2 THEN CASE WHEN qpos < 2 THEN NULL ELSE qpos - 2 END WHEN 3 THEN CASE WHEN qpos < 4 THEN qpos ELSE qpos + 1 END
    WHEN 4 THEN CASE WHEN qpos < 3 THEN qpos WHEN qpos < 5 THEN NULL WHEN qpos < n - 4 THEN qpos - 2 ELSE qpos + 1 END ELSE qpos END AS INTEGER) AS refpos FROM q
UNION ALL SELECT read_id, NULL, 7 + 4 FROM a WHERE k = 3
UNION ALL SELECT read_id, NULL, CAST(7 + length(seq) - 6 + d AS INTEGER) FROM a, (VALUES (0), (1), (2)) v(d) WHERE k = 4""")
def aligned_pairs(reads):
    return aligned(reads).select("read_id", F.explode(S.aligned_pairs(F.lit(7), "cigar")).alias("p")).select("read_id", "p.qpos", "p.refpos")


@query("ref_index", "fx_reads", sql=f"""WITH a AS ({_ALIGNED}), n AS (SELECT read_id, length(seq) + CASE k WHEN 2 THEN -2 WHEN 3 THEN 1 WHEN 4 THEN 1 ELSE 0 END AS n, k FROM a),
r AS (SELECT read_id, n, k, unnest(range(0, n)) AS i FROM n)
SELECT read_id, CAST(i AS INTEGER) AS ref_no, CAST(CASE k WHEN 2 THEN i + 2 WHEN 3 THEN CASE WHEN i <= 4 THEN i ELSE i - 1 END
  WHEN 4 THEN CASE WHEN i < 3 THEN i WHEN i < n - 7 THEN i + 2 WHEN i = n - 7 THEN n - 7 + 1 WHEN i < n - 4 THEN n - 7 + 2 ELSE i - 1 END ELSE i END AS INTEGER) AS idx,
  CASE WHEN (k = 3 AND i = 4) OR (k = 4 AND i >= n - 7 AND i < n - 4) THEN 0 ELSE 1 END AS quality FROM r""")
def ref_index(reads):
    return aligned(reads).select("read_id", F.posexplode(S.ref_index("cigar")).alias("ref_no", "x")).select("read_id", "ref_no", "x.idx", "x.quality")


@query("identity", "fx_reads", sql=f"SELECT read_id, round((length(seq) - CASE k WHEN 2 THEN 2 WHEN 4 THEN 2 ELSE 0 END - read_id % 7) / length(seq), 6) AS score FROM ({_ALIGNED})")
def identity(reads):
    return aligned(reads).select("read_id", F.round(A.identity_score("cigar", F.col("read_id") % 7, F.length("seq")), 6).alias("score"))


@query("identity_weighted", "fx_reads", sql=f"""WITH s AS (SELECT round((length(seq) - CASE k WHEN 2 THEN 2 WHEN 4 THEN 2 ELSE 0 END - read_id % 7) / length(seq), 6) AS score, greatest(length(seq) - 50, 0) AS w FROM ({_ALIGNED}))
SELECT round(sum(score * w) / sum(w), 6) AS identity FROM s""")
def identity_weighted(reads):
    rows = aligned(reads).select(F.round(A.identity_score("cigar", F.col("read_id") % 7, F.length("seq")), 6).alias("score"), F.length("seq").alias("n"))
    return A.weighted_identity(rows, "score", "n", 50).select(F.round("identity", 6).alias("identity"))


def _pileup_reads(reads: DataFrame) -> DataFrame:
    """Gapless alignments of reads to themselves, with tags; every third read is reverse: its tag speaks of T in the shown strand."""
    own = quality(reads.where("seq <> ''"))
    own = S.evaluated(own, "t", T.mm_from_seq(F.when(F.col("read_id") % 3 == 0, S.reverse_complement(F.translate("seq", "M", "A"))).otherwise(F.col("seq")), "quality"))
    own = own.select("read_id", F.col("read_id").alias("contig"), F.when(F.col("read_id") % 3 == 0, 16).otherwise(0).alias("flag"), F.lit(0).alias("pos"), F.concat(F.length("seq"), F.lit("M")).alias("cigar"), F.translate("seq", "M", "A").alias("plain"), "t.gaps", "t.likelihoods")
    return own.select("read_id", "contig", "flag", "pos", "cigar", F.col("plain").alias("seq"), T.mm_text("gaps").alias("mm"), F.col("likelihoods").alias("ml"))


_DUCK_PILE = f"""{_DUCK_BASES}, p AS (SELECT read_id, CAST(k - 1 AS INTEGER) AS refpos, seq, CASE WHEN c = 'M' AND read_id % 3 <> 0 THEN CAST(floor(256 * pow(10.0::DOUBLE, -({_Q}) / 10.0::DOUBLE)) AS INTEGER) ELSE 0 END AS likelihood FROM b
  WHERE CASE WHEN read_id % 3 = 0 THEN c = 'T' ELSE c IN ('A', 'M') END),
w AS (SELECT read_id AS contig, refpos, refpos AS qpos, replace(seq, 'M', 'A')[refpos + 1] AS refbase, CASE WHEN read_id % 3 = 0 THEN 'T' ELSE 'A' END AS qbase, read_id, likelihood, CASE WHEN read_id % 3 = 0 THEN '-' ELSE '+' END AS direction, replace(seq, 'M', 'A') AS seq FROM p)"""
_COLUMNS = "contig, refpos, qpos, refbase, qbase, read_id, likelihood, direction"


@query("pileup", "fx_reads", "fx_ref", sql=f"WITH {_DUCK_PILE} SELECT {_COLUMNS}, seq[greatest(refpos - 4, 1) : refpos + 6] AS refseq FROM w")
def pileup(reads, ref):
    return L.meth_pileup(_pileup_reads(reads), ref).drop("motif")


@query("pileup_motif", "fx_reads", "fx_ref", sql=f"WITH {_DUCK_PILE} SELECT {_COLUMNS}, seq[greatest(refpos - 1, 1) : refpos + 3] AS refseq, 'DRACH' AS motif FROM w WHERE likelihood >= 1 AND regexp_matches(seq[greatest(refpos - 1, 1) : refpos + 3], '^[AGT][AG]A[C][ACT]')")
def pileup_motif(reads, ref):
    return L.meth_pileup(_pileup_reads(reads), ref, motif="DRACH", reach=2, threshold=1)


@query("pileup_report", "fx_reads", sql="SELECT 'Passed' AS reason, count(*) AS n FROM fx_reads WHERE seq <> '' AND read_id % 4 <> 1 UNION ALL SELECT 'Corrupted_MM', count(*) FROM fx_reads WHERE seq <> '' AND read_id % 4 = 1")
def pileup_report(reads):
    broken = _pileup_reads(reads).withColumn("mm", F.when(F.col("read_id") % 4 == 1, F.lit("C+m?;")).otherwise(F.col("mm"))).withColumn("ml", F.when(F.col("read_id") % 4 == 1, F.array().cast("array<int>")).otherwise(F.col("ml")))
    return L.pileup_report(broken)


@query("ref_window", "fx_ref", "fx_mod_sites", sql="SELECT s.contig, CAST(s.pos AS BIGINT) AS pos, r.seq[greatest(s.pos - 3, 0) + 1 : least(s.pos + 3, r.length)] AS refseq FROM fx_mod_sites s JOIN fx_ref r ON r.contig = s.contig")
def ref_window(ref, sites):
    return J.ref_window(sites, ref, 3, 3, pos="pos").select("contig", "pos", "refseq")


@query("site_segment", "fx_reads", sql="WITH s AS (SELECT read_id, CASE WHEN read_id % 2 = 0 THEN seq[greatest(length(seq) - 8 - 3, 0) + 1 : greatest(length(seq) - 8 + 4, 0)] ELSE seq[5 : 11] END AS segment FROM fx_reads) SELECT read_id, segment, contains(segment, 'M') AS modified FROM s")
def site_segment(reads):
    rows = reads.select("read_id", S.site_segment("seq", F.lit(7), F.col("read_id") % 2 == 0, 3).alias("segment"))
    return rows.select("read_id", "segment", S.modified("segment").alias("modified"))


@query("qr_index", "fx_reads", sql="SELECT read_id, '0:' || length(seq) || ':7|' || read_id || ':5' AS text, CAST(length(seq) + 7 AS BIGINT) AS q_sum, CAST(read_id + 5 AS BIGINT) AS r_sum FROM fx_reads")
def qr_index(reads):
    rows = reads.select("read_id", S.format_qr_index(F.array(F.lit(0), F.length("seq"), F.lit(7)), F.array(F.col("read_id"), F.lit(5))).alias("text")).withColumn("x", S.parse_qr_index("text"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("read_id", "text", total("x.query").alias("q_sum"), total("x.reference").alias("r_sum"))


@query("motif_pfm", "fx_reads", sql=f"""WITH {_DUCK_BASES}, w AS (SELECT read_id, seq[k - 2 : k + 2] AS w FROM b WHERE c = 'M' AND k >= 3), l AS (SELECT w, unnest(range(1, 6)) AS i FROM w WHERE length(w) = 5)
SELECT CAST(i - 1 AS INTEGER) AS "offset", count(*) FILTER (w[i] = 'A') AS "A", count(*) FILTER (w[i] = 'C') AS "C", count(*) FILTER (w[i] = 'G') AS "G", count(*) FILTER (w[i] = 'T') AS "T", count(*) FILTER (w[i] = 'M') AS "M" FROM l GROUP BY i""")
def motif_pfm(reads):
    places = reads.select("seq", F.explode(S.find_all("seq", "M")).alias("i")).where("i >= 2")
    return A.position_frequency(places.select(S.site_segment("seq", "i", F.lit(False), 2).alias("segment")), 2)


@query("path_to_seq", "fx_reads", sql=f"WITH {_DUCK_KMERS}, o AS (SELECT read_id, kmer, i, lag(kmer) OVER (PARTITION BY read_id ORDER BY i) AS p FROM k) SELECT read_id, string_agg(kmer[1], '' ORDER BY i) FILTER (p IS NULL OR p <> kmer) || arg_max(kmer, i)[2:] AS seq FROM o GROUP BY read_id")
def path_to_seq(reads):
    return reads.where("length(seq) >= 5").select("read_id", S.path_to_seq(S.kmers("seq", 5)).alias("seq"))


@query("path_from_alignment", "fx_reads", sql=f"WITH {_DUCK_KMERS}, p AS (SELECT read_id, kmer, CASE WHEN i % 3 = 0 THEN 1 ELSE 2 END AS d FROM k) SELECT kmer, CAST(sum(d) AS BIGINT) AS points FROM p GROUP BY kmer")
def path_from_alignment(reads):
    # dwells of 2, 2 and 1 points by turns
    starts = F.transform(S.span(F.length("seq") + 1), lambda i: F.floor(i / 3).cast("int") * 5 + (i % 3) * 2)
    own = reads.where("length(seq) >= 5").select(F.explode(S.path_from_alignment("seq", starts, F.lit(0), 5)).alias("kmer"))
    return own.groupBy("kmer").agg(F.count("*").alias("points"))


@query("max_loop", "fx_reads", sql="""WITH s AS (SELECT read_id, replace(seq, 'M', 'A') AS s FROM fx_reads), b AS (SELECT read_id, s[k] AS c, k - 1 AS i FROM (SELECT read_id, s, unnest(range(1, length(s) + 1)) AS k FROM s)),
l AS (SELECT read_id, z.l, i % z.l AS m, i, c, lag(c) OVER (PARTITION BY read_id, z.l, i % z.l ORDER BY i) AS p FROM b, (SELECT unnest(range(2, 10)) AS l) z),
g AS (SELECT read_id, l, m, sum(CASE WHEN p = c THEN 0 ELSE 1 END) OVER (PARTITION BY read_id, l, m ORDER BY i) AS g FROM l),
n AS (SELECT read_id, l, m, g, count(*) AS n FROM g GROUP BY read_id, l, m, g), x AS (SELECT read_id, l, m, max(n) AS n FROM n GROUP BY read_id, l, m), y AS (SELECT read_id, l, min(n) AS n FROM x GROUP BY read_id, l),
z AS (SELECT read_id, max(n) AS n FROM y JOIN (SELECT read_id, length(seq) AS len FROM fx_reads) USING (read_id) WHERE l <= len GROUP BY read_id) SELECT r.read_id, CAST(coalesce(z.n, 0) AS INTEGER) AS loop FROM fx_reads r LEFT JOIN z ON z.read_id = r.read_id""")
def max_loop(reads):
    return reads.select("read_id", S.max_loop("seq").alias("loop"))


@query("edit_error", "fx_reads", sql="""WITH p AS (SELECT replace(seq, 'M', 'A') AS p, replace(reverse(seq), 'M', 'A') AS r FROM fx_reads WHERE seq <> '') SELECT count(*) AS n, round(avg(levenshtein(p, r) / length(r)), 6) AS error FROM p""")
def edit_error(reads):
    pairs = reads.where("seq <> ''").select(F.col("seq").alias("pred"), F.reverse("seq").alias("ref"))
    return A.edit_error(pairs, reduction={"M": "A"}).select("n", F.round("error", 6).alias("error"))


@query("permute_error", "fx_reads", sql="""WITH p AS (SELECT translate(replace(seq, 'M', 'A'), 'ACGT', 'GTAC') AS p, replace(seq, 'M', 'A') AS r FROM fx_reads WHERE seq <> ''),
l AS (SELECT * FROM (VALUES ('A'), ('C'), ('G'), ('T')) v(c)), o AS (SELECT a.c || b.c || c.c || d.c AS o FROM l a, l b, l c, l d WHERE a.c <> b.c AND a.c <> c.c AND a.c <> d.c AND b.c <> c.c AND b.c <> d.c AND c.c <> d.c),
e AS (SELECT o, round(avg(levenshtein(translate(p, 'ACGT', o), r) / length(r)), 6) AS error FROM p, o GROUP BY o) SELECT o AS permutation, error FROM e ORDER BY error, o LIMIT 1""")
def permute_error(reads):
    own = F.translate("seq", "M", "A")
    pairs = reads.where("seq <> ''").select(F.translate(own, "ACGT", "GTAC").alias("pred"), own.alias("ref"))
    return A.permute_error(pairs).select("permutation", F.round("error", 6).alias("error"))


@query("record_filter", "fx_reads", sql="""WITH c AS (SELECT read_id, seq, length(seq) AS n, greatest(length(regexp_replace(seq, '[^A]', '', 'g')), length(regexp_replace(seq, '[^C]', '', 'g')), length(regexp_replace(seq, '[^G]', '', 'g')), length(regexp_replace(seq, '[^T]', '', 'g')), length(regexp_replace(seq, '[^M]', '', 'g'))) AS top FROM fx_reads)
SELECT read_id FROM c WHERE n >= 3 AND top / n <= 0.5 AND 9000 / n BETWEEN 4096 / 260.0 AND 4096 / 65.0""")
def record_filter(reads):
    rules = [lambda df: P.min_length("seq"), lambda df: P.mono_filter("seq", 0.5), lambda df: P.rate_filter("seq", F.lit(9000)), lambda df: P.known_bases("seq")]
    return P.and_filters(rules)(reads.where("seq <> ''")).select("read_id")


@query("chunk_filter", "fx_reads", sql="""WITH r AS (SELECT read_id, CASE read_id % 20 WHEN 0 THEN 'X' WHEN 1 THEN 'Y' WHEN 2 THEN 'P' ELSE seq END AS seq FROM fx_reads), n AS (SELECT seq, length(seq) AS n, greatest(length(regexp_replace(seq, '[^A]', '', 'g')), length(regexp_replace(seq, '[^C]', '', 'g')), length(regexp_replace(seq, '[^G]', '', 'g')), length(regexp_replace(seq, '[^T]', '', 'g')), length(regexp_replace(seq, '[^M]', '', 'g'))) AS top FROM r)
SELECT CASE WHEN seq = 'X' THEN 'quality' WHEN seq = 'Y' THEN 'tail' WHEN seq = 'P' THEN 'gap' WHEN n <= 3 THEN 'short' WHEN n >= 400 THEN 'long' WHEN top / n >= 0.6 THEN 'mono' WHEN regexp_matches(seq, '[^ACGT]') THEN 'letters' ELSE 'passed' END AS reason, count(*) AS n FROM n GROUP BY 1""")
def chunk_filter(reads):
    marked = reads.withColumn("seq", F.when(F.col("read_id") % 20 == 0, "X").when(F.col("read_id") % 20 == 1, "Y").when(F.col("read_id") % 20 == 2, "P").otherwise(F.col("seq")))
    return P.chunk_report(marked, "seq", 10_000)


@query("label_length", "fx_reads", sql="SELECT read_id, length(seq) AS n FROM fx_reads WHERE length(seq) > 5 AND length(seq) < 200")
def label_length(reads):
    return P.filter_by_label_length(reads.select("read_id", F.length("seq").cast("long").alias("n")), "n", 2000)


@query("bounds_filter", "fx_reads", sql="SELECT read_id FROM fx_reads WHERE read_id % 11 >= 1 AND length(seq) - read_id % 7 <= length(seq) - 3 + 4 AND abs((length(seq) - read_id % 7) - (5 - 4 - 4 + read_id % 11) - (length(seq) - read_id % 30)) <= 10")
def bounds_filter(reads):
    own = reads.select("read_id", F.lit(5).alias("a"), (F.length("seq") - 3).alias("b"), (F.length("seq") - F.col("read_id") % 30).alias("n"), (F.col("read_id") % 11 - 3).alias("s"), (F.length("seq") - F.col("read_id") % 7).alias("e"))
    own = own.withColumn("s", F.col("s"))
    return P.filter_bounds(own.withColumn("a", F.lit(2)), "a", "b", "n", "s", "e").select("read_id")


@query("dataset_stats", "fx_reads", sql="SELECT count(*) FILTER (contains(seq, 'A') AND NOT contains(seq, 'M')) AS n_a, count(*) FILTER (contains(seq, 'M') AND NOT contains(seq, 'A')) AS n_m, count(*) FILTER (NOT contains(seq, 'A') AND NOT contains(seq, 'M')) AS n_none, count(*) FILTER (contains(seq, 'A') AND contains(seq, 'M')) AS n_both FROM fx_reads")
def dataset_stats(reads):
    return A.sequence_kinds(reads)


@query("length_histogram", "fx_reads", sql="SELECT CAST(length(seq) // 100 * 100 AS BIGINT) AS lo, count(*) AS n FROM fx_reads GROUP BY 1")
def length_histogram(reads):
    return A.length_histogram(reads)


@query("annotate_mods", "fx_ref", "fx_mod_sites", sql="""SELECT r.contig AS seg_id, CASE WHEN m.pos IS NOT NULL AND r.seq[m.pos + 1] = 'A' THEN r.seq[1 : m.pos] || 'M' || r.seq[m.pos + 2 :] ELSE r.seq END AS seq
FROM fx_ref r LEFT JOIN (SELECT DISTINCT contig, pos FROM fx_mod_sites WHERE status > 0) m ON m.contig = r.contig AND m.pos < r.length""")
def annotate_mods(ref, sites):
    segments = ref.select(F.col("contig").alias("seg_id"), "contig", F.lit(0).cast("long").alias("ref_start"), "seq")
    return J.annotate_modifications(segments, sites).select("seg_id", "seq")


@query("unmatched_reads", "fx_reads")
def unmatched_reads(reads):
    own = reads.where("seq <> ''").select("read_id", F.col("seq").alias("query"), (F.col("read_id") % 2 == 0).alias("reverse"))
    call = F.when(F.col("reverse"), S.reverse_complement("query")).otherwise(F.col("query"))
    own = own.withColumn("basecall", F.when(F.col("read_id") % 5 == 0, F.reverse(call)).otherwise(call))
    return P.exclude_unmatched_reads(own, "query", "basecall", "reverse").select("read_id", "distance")
