"""Queries over frames, calls and training datasets."""

from pyspark.sql import DataFrame, Window, functions as F

from seqspark.functions import sequence as S
from seqspark.operators import aggregates as A, datasets as D, filters as P, segments as G
from seqspark.plans.catalog import query

_BEST = "bf AS (SELECT chunk_id, t, arg_max(cls, {'v': logit, 'c': -cls}) AS cls FROM fx_frames GROUP BY chunk_id, t)"
_KEYS = ("chunk_id",)


@query("argmax_call", "fx_frames", sql=f"WITH {_BEST} SELECT chunk_id, t, cls FROM bf")
def argmax_call(frames):
    return D.argmax_call(frames, ("chunk_id", "t"))


def _paths(frames: DataFrame) -> DataFrame:
    best = D.argmax_call(frames, ("chunk_id", "t"))
    return best.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "cls"))), lambda x: x["cls"]).alias("path"))


@query("ctc_collapse", "fx_frames", sql=f"""WITH {_BEST}, m AS (SELECT chunk_id, t, cls, CASE WHEN cls <> 0 AND (lag(cls) OVER (PARTITION BY chunk_id ORDER BY t) IS NULL OR lag(cls) OVER (PARTITION BY chunk_id ORDER BY t) <> cls) THEN 1 ELSE 0 END AS move FROM bf)
SELECT chunk_id, coalesce(string_agg('ACGTM'[cls : cls], '' ORDER BY t) FILTER (move = 1), '') AS seq, string_agg(CAST(move AS VARCHAR), '' ORDER BY t) AS moves FROM m GROUP BY chunk_id""")
def ctc_collapse(frames):
    rows = S.evaluated(_paths(frames), "x", S.ctc_collapse("path"))
    return rows.select("chunk_id", "x.seq", F.array_join(F.col("x.moves").cast("array<string>"), "").alias("moves"))


@query("softmax", "fx_frames", sql="WITH e AS (SELECT *, exp(logit) AS e FROM fx_frames) SELECT chunk_id, t, cls, round(e / sum(e) OVER (PARTITION BY chunk_id, t), 6) AS p FROM e")
def softmax(frames):
    rows = frames.groupBy("chunk_id", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("cls", "logit"))), lambda x: x["logit"]).alias("v"))
    rows = rows.select("chunk_id", "t", F.posexplode(S.softmax("v")).alias("cls", "p"))
    return rows.select("chunk_id", "t", F.col("cls").cast("long").alias("cls"), F.round("p", 6).alias("p"))


_POST = f"""{_BEST}, mv AS (SELECT chunk_id, t, cls, CASE WHEN cls <> 0 AND (lag(cls) OVER w IS NULL OR lag(cls) OVER w <> cls) THEN 1 ELSE 0 END AS move FROM bf WINDOW w AS (PARTITION BY chunk_id ORDER BY t)),
bi AS (SELECT chunk_id, t, CAST(sum(move) OVER (PARTITION BY chunk_id ORDER BY t) - 1 AS BIGINT) AS base_index FROM mv)"""


@query("mod_posterior", "fx_frames", sql=f"""WITH {_POST}, p AS (SELECT f.chunk_id, f.t, f.cls, bi.base_index, exp(logit) / sum(exp(logit)) OVER (PARTITION BY f.chunk_id, f.t) AS p FROM fx_frames f JOIN bi ON bi.chunk_id = f.chunk_id AND bi.t = f.t WHERE base_index >= 0),
k AS (SELECT *, row_number() OVER (PARTITION BY chunk_id, base_index, cls ORDER BY p DESC) AS r FROM p WHERE cls IN (1, 5)), bad AS (SELECT chunk_id FROM bi GROUP BY chunk_id HAVING max(base_index) >= 9 - chunk_id % 3)
SELECT chunk_id, base_index, round(sum(CASE WHEN cls = 5 THEN p ELSE 0 END) / sum(p), 6) AS p FROM k WHERE r <= 3 AND chunk_id NOT IN (SELECT chunk_id FROM bad) GROUP BY chunk_id, base_index""")
def mod_posterior(frames):
    moves = _paths(frames).select("chunk_id", F.posexplode(S.ctc_collapse("path")["moves"]).alias("t", "move")).withColumn("t", F.col("t").cast("long"))
    index = G.base_positions(moves, 1, key="chunk_id").select("chunk_id", F.col("pos").alias("t"), "base_index")
    lengths = frames.select("chunk_id").distinct().select("chunk_id", (9 - F.col("chunk_id") % 3).alias("seq_len"))
    out = D.modified_posterior(frames.join(index, ["chunk_id", "t"]), lengths, key=_KEYS)
    return out.select("chunk_id", "base_index", F.round("p", 6).alias("p"))


_KMERS = ("CAC", "CMC", "CGC", "GAT", "GMT", "TTT")


@query("am_ratio", "fx_frames", sql=f"""WITH p AS (SELECT chunk_id, t, CASE cls {' '.join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KMERS))} END AS kmer, exp(logit) AS p FROM fx_frames),
b AS (SELECT chunk_id, t, arg_max(kmer, {{'p': p, 'k': kmer}}) AS best FROM p GROUP BY chunk_id, t), m AS (SELECT * FROM b WHERE best[2] IN ('A', 'M')),
r AS (SELECT m.chunk_id, m.t, ln(a.p / o.p) AS r FROM m JOIN p a ON a.chunk_id = m.chunk_id AND a.t = m.t AND a.kmer = m.best[1] || 'A' || m.best[3] JOIN p o ON o.chunk_id = m.chunk_id AND o.t = m.t AND o.kmer = m.best[1] || 'M' || m.best[3])
SELECT chunk_id, threshold, round(avg(CASE WHEN r < threshold THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS share FROM r, (VALUES (-0.5::DOUBLE), (0.0::DOUBLE), (0.5::DOUBLE)) v(threshold) GROUP BY chunk_id, threshold""")
def am_ratio(frames):
    names = F.array(*[F.lit(k) for k in _KMERS])
    rows = frames.select("chunk_id", "t", F.get(names, F.col("cls").cast("int")).alias("kmer"), F.exp("logit").alias("p"))
    return A.am_ratio_decode(rows, (-0.5, 0.0, 0.5), _KEYS).select("chunk_id", "threshold", F.round("share", 6).alias("share"))


def _calls(frames: DataFrame) -> DataFrame:
    """One call for each chunk; chunks of one label are one read."""
    rows = S.evaluated(_paths(frames), "x", S.ctc_collapse("path")).select(F.col("chunk_id").alias("chunk_no"), "x.seq")
    return rows.join(frames.select(F.col("chunk_id").alias("chunk_no"), "read_id").distinct(), "chunk_no")


_CALLS = f"""{_BEST}, mv AS (SELECT chunk_id, t, cls, CASE WHEN cls <> 0 AND (lag(cls) OVER w IS NULL OR lag(cls) OVER w <> cls) THEN 1 ELSE 0 END AS move FROM bf WINDOW w AS (PARTITION BY chunk_id ORDER BY t)),
ca AS (SELECT m.chunk_id, f.read_id, coalesce(string_agg('ACGTM'[cls : cls], '' ORDER BY t) FILTER (move = 1), '') AS seq FROM mv m JOIN (SELECT DISTINCT chunk_id, read_id FROM fx_frames) f ON f.chunk_id = m.chunk_id GROUP BY m.chunk_id, f.read_id)"""


@query("stitch", "fx_frames", sql=f"WITH {_CALLS} SELECT read_id, chunk_id AS chunk_no, CAST(coalesce(sum(length(seq)) OVER (PARTITION BY read_id ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM ca")
def stitch(frames):
    return G.stitch(_calls(frames), "stick").select("read_id", "chunk_no", "offset")


@query("stitch_glue", "fx_reads", sql="""WITH c AS (SELECT read_id, n AS chunk_no, seq[n * 180 + 1 : n * 180 + 200] AS s FROM (SELECT read_id, seq, unnest(range(0, (length(seq) + 179) // 180)) AS n FROM fx_reads)),
p AS (SELECT *, lag(s) OVER (PARTITION BY read_id ORDER BY chunk_no) AS b FROM c), o AS (SELECT read_id, chunk_no, s, b, unnest(range(1, CAST(least(floor(length(b) * 0.1), length(s)) AS BIGINT))) AS i FROM p WHERE b IS NOT NULL),
g AS (SELECT read_id, chunk_no, i, sum(CASE WHEN b[length(b) - i + j] = s[j] THEN 2 ELSE 0 END) - i AS gain FROM (SELECT *, unnest(range(1, i + 1)) AS j FROM o) GROUP BY read_id, chunk_no, i),
x AS (SELECT read_id, chunk_no, arg_max(i, {'g': gain, 'i': -i}) AS i, max(gain) AS gain FROM g GROUP BY read_id, chunk_no), st AS (SELECT p.read_id, p.chunk_no, CASE WHEN p.b IS NULL THEN 0 ELSE length(p.b) - CASE WHEN x.gain > 0 THEN x.i ELSE 0 END END AS step FROM p LEFT JOIN x ON x.read_id = p.read_id AND x.chunk_no = p.chunk_no)
SELECT read_id, chunk_no, CAST(sum(step) OVER (PARTITION BY read_id ORDER BY chunk_no) AS BIGINT) AS "offset" FROM st""")
def stitch_glue(reads):
    rows = reads.select("read_id", "seq", F.explode(S.span(F.ceil(F.length("seq") / 180))).alias("n"))
    calls = rows.select("read_id", F.col("n").cast("long").alias("chunk_no"), F.substring("seq", F.col("n") * 180 + 1, F.lit(200)).alias("seq"))
    return G.stitch(calls, "glue").select("read_id", "chunk_no", "offset")


def fixed_overlap(calls: DataFrame) -> DataFrame:
    """A stitching kernel of the caller's: each call overlaps the one before by two bases, or by as many as that has."""
    before = Window.partitionBy("read_id").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)
    return calls.withColumn("offset", F.coalesce(F.sum(F.greatest(F.length("seq") - 2, F.lit(0))).over(before), F.lit(0)).cast("long"))


@query("user_stitch", "fx_frames", sql=f"WITH {_CALLS} SELECT read_id, chunk_id AS chunk_no, CAST(coalesce(sum(greatest(length(seq) - 2, 0)) OVER (PARTITION BY read_id ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM ca")
def user_stitch(frames):
    G.STITCH["fixed_overlap"] = fixed_overlap
    return G.stitch(_calls(frames), "fixed_overlap").select("read_id", "chunk_no", "offset")


@query("user_filter", "fx_reads", sql="SELECT read_id FROM fx_reads WHERE length(seq) >= 3 AND regexp_matches(seq, '^[ACGT]*$') AND seq[1] = seq[length(seq)] AND read_id % 3 > 0")
def user_filter(reads):
    """Rules of the library and of the caller's own, all of which a record must pass."""
    rules = [lambda df: P.min_length("seq"), lambda df: ~S.modified("seq"), lambda df: F.left("seq", F.lit(1)) == F.right("seq", F.lit(1)), lambda df: df["read_id"] % 3 > 0]
    return P.and_filters(rules)(reads).select("read_id")


@query("consensus", "fx_frames", sql=f"""WITH c AS (SELECT read_id, t AS pos, cls AS base, -logit * logit AS logp FROM fx_frames WHERE cls > 0 AND chunk_id % 3 + 1 <> cls), v AS (SELECT read_id, pos, base, count(*) AS votes, sum(logp) AS logp FROM c GROUP BY ALL),
w AS (SELECT read_id, pos, arg_max(base, {{'v': votes, 'b': -base}}) AS base FROM v GROUP BY read_id, pos), q AS (SELECT v.*, least(CAST(trunc(-10 * logp / votes / ln(10.0::DOUBLE)) AS INTEGER), 93) AS q FROM v JOIN w USING (read_id, pos, base))
SELECT read_id, string_agg('ACGTM'[base : base], '' ORDER BY pos) AS seq, string_agg(chr(q + 33), '' ORDER BY pos) AS quality FROM q GROUP BY read_id""")
def consensus(frames):
    calls = frames.where("cls > 0 AND chunk_id % 3 + 1 <> cls").select("read_id", F.col("t").alias("pos"), F.col("cls").alias("base"), (-F.col("logit") * F.col("logit")).alias("logp"))
    return A.consensus(calls)


@query("training_filter", "fx_chunks", "fx_reads", sql="""WITH c AS (SELECT c.chunk_id, CASE WHEN c.chunk_id % 11 = 0 THEN true ELSE false END AS bad, c.chunk_id % 13 = 0 AS zero, r.seq FROM fx_chunks c JOIN fx_reads r ON r.read_id = c.chunk_id)
SELECT count(*) AS n, count(*) FILTER (bad) AS n_nan, count(*) FILTER (zero AND NOT bad) AS n_zero, count(*) FILTER (regexp_matches(seq, '[^ACGT]')) AS n_letters FROM c""")
def training_filter(chunks, reads):
    return P.check_batch(_marked(chunks, reads), "signal", "seq")


def _marked(chunks: DataFrame, reads: DataFrame) -> DataFrame:
    signal = F.when(F.col("chunk_id") % 11 == 0, F.array(F.lit(float("nan")).cast("float"))).when(F.col("chunk_id") % 13 == 0, F.transform("signal", lambda x: F.lit(0).cast("float"))).otherwise(F.col("signal"))
    return chunks.withColumn("signal", signal).join(reads.select(F.col("read_id").alias("chunk_id"), "seq"), "chunk_id")


@query("training_kept", "fx_chunks", "fx_reads", sql="SELECT c.chunk_id FROM fx_chunks c JOIN fx_reads r ON r.read_id = c.chunk_id WHERE c.chunk_id % 11 <> 0 AND NOT regexp_matches(r.seq, '[^ACGT]')")
def training_kept(chunks, reads):
    return P.filter_training(_marked(chunks, reads), "signal", "seq").select("chunk_id")


def _halves(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    return chunks.where("read_id % 2 = 0"), chunks.where("read_id % 2 = 1")


@query("merge_datasets", "fx_chunks", sql="SELECT chunk_id, duration, CAST(read_id % 2 AS INTEGER) AS source FROM (SELECT *, row_number() OVER (PARTITION BY read_id % 2 ORDER BY chunk_id) AS n FROM fx_chunks) WHERE n <= 100")
def merge_datasets(chunks):
    even, odd = _halves(chunks)
    return D.merge_datasets([even.drop("signal"), odd], ["chunk_id", "duration", "signal"], "chunk_id", 100)


@query("merge_equal", "fx_chunks", sql="WITH r AS (SELECT chunk_id, read_id % 2 AS source, row_number() OVER (PARTITION BY read_id % 2 ORDER BY chunk_id) AS n FROM fx_chunks), c AS (SELECT min(k) AS k FROM (SELECT count(*) AS k FROM r GROUP BY source)) SELECT chunk_id, CAST(source AS INTEGER) AS source FROM r, c WHERE n <= k")
def merge_equal(chunks):
    even, odd = _halves(chunks)
    return D.merge_equal([even.select("chunk_id"), None, odd.select("chunk_id")], "chunk_id")


@query("mix_methylation", "fx_chunks", "fx_reads", sql="""WITH r AS (SELECT c.chunk_id, c.read_id % 2 = 0 AS is_control, s.seq, list_transform(c.signal, lambda v: v::DOUBLE) AS v, c.duration AS d FROM fx_chunks c JOIN fx_reads s ON s.read_id = c.chunk_id),
n AS (SELECT count(*) FILTER (is_control) AS nc, count(*) FILTER (NOT is_control) AS nm, avg(d) FILTER (is_control) - avg(d) FILTER (NOT is_control) AS move FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY is_control ORDER BY chunk_id) AS i FROM r)
SELECT chunk_id, is_control, CASE WHEN is_control THEN seq ELSE replace(seq, 'A', 'M') END AS seq, round(list_sum(list_transform(v, lambda y: CASE WHEN is_control THEN y ELSE y + move / 2 END)), 3) AS x FROM k, n WHERE i <= CASE WHEN is_control THEN floor(nm * 0.5) ELSE floor(nc / 0.5) END""")
def mix_methylation(chunks, reads):
    rows = chunks.select("chunk_id", "read_id", F.transform("signal", lambda x: x.cast("double")).alias("signal"), F.col("duration").alias("med"), F.lit(2.0).alias("mad")).join(reads.select(F.col("read_id").alias("chunk_id"), "seq"), "chunk_id")
    control, meth = (df.drop("read_id") for df in _halves(rows))
    out = D.mix_methylation(control, meth, 0.5, "chunk_id", shift="med")
    return out.select("chunk_id", "is_control", "seq", F.round(F.aggregate("signal", F.lit(0.0), lambda a, x: a + x), 3).alias("x"))


@query("meta_semi", "fx_chunks", "fx_reads", sql="SELECT m.read_id, n.n AS n_chunks FROM (SELECT DISTINCT read_id FROM fx_chunks WHERE read_id % 3 > 0) m JOIN (SELECT read_id, count(*) AS n FROM fx_chunks GROUP BY read_id) n ON n.read_id = m.read_id")
def meta_semi(chunks, reads):
    mm = chunks.select("read_id").distinct().where("read_id % 3 > 0")
    return D.filter_meta_ids(mm, chunks.select("read_id")).groupBy("read_id").agg(F.count("*").alias("n_chunks"))


@query("dataset_means", "fx_chunks", sql="SELECT read_id % 10 AS part, round(avg(CASE WHEN chunk_id % 7 > 0 THEN duration END), 6) AS mean FROM fx_chunks GROUP BY 1")
def dataset_means(chunks):
    rows = chunks.select((F.col("read_id") % 10).alias("part"), F.when(F.col("chunk_id") % 7 > 0, F.col("duration").cast("double")).otherwise(F.lit(float("nan"))).alias("med"))
    return rows.groupBy("part").agg(F.round(A.mean_ignoring_nan("med"), 6).alias("mean"))
