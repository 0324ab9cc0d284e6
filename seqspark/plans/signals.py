"""Queries over signals and state paths."""

from pyspark.sql import DataFrame, functions as F

from seqspark.operators import aggregates as A, segments as G, signal as N
from seqspark.plans.catalog import query

_MED = "md AS (SELECT read_id, median(value) AS med FROM {src} GROUP BY read_id), ma AS (SELECT s.read_id, md.med, 1.4826 * median(abs(s.value - md.med)) AS mad FROM {src} s JOIN md ON md.read_id = s.read_id GROUP BY s.read_id, md.med)"
_RUNS = "r0 AS (SELECT read_id, pos, state, value, CASE WHEN lag(state) OVER w = state THEN 0 ELSE 1 END AS new FROM fx_path WINDOW w AS (PARTITION BY read_id ORDER BY pos)), r1 AS (SELECT *, sum(new) OVER (PARTITION BY read_id ORDER BY pos) AS g FROM r0)"
_RUN = f"{_RUNS}, ru AS (SELECT read_id, g, state, min(pos) AS start, max(pos) AS \"end\", count(*) AS length, avg(value) AS m, var_pop(value) AS v, median(value) AS med FROM r1 GROUP BY read_id, g, state)"
_NOISE = """n0 AS (SELECT read_id, stddev_pop(value) / 6 AS lim, count(*) AS n FROM fx_signal GROUP BY read_id), n1 AS (SELECT read_id, pos // 8 AS w, stddev_pop(value) AS std FROM fx_signal GROUP BY 1, 2),
n2 AS (SELECT s.read_id, s.pos, (s.pos // 8 >= n0.n // 8 OR n1.std > n0.lim) AND s.pos > 0 AND s.pos < n0.n - 1 AS noisy FROM fx_signal s JOIN n0 ON n0.read_id = s.read_id JOIN n1 ON n1.read_id = s.read_id AND n1.w = s.pos // 8),
n3 AS (SELECT read_id, pos, noisy, pos - row_number() OVER (PARTITION BY read_id, noisy ORDER BY pos) AS g FROM n2), n4 AS (SELECT read_id, min(pos) - 1 AS lo, max(pos) AS hi, count(*) AS k FROM n3 WHERE noisy GROUP BY read_id, g),
n5 AS (SELECT read_id, lo, hi FROM n4 QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY k DESC, lo) = 1),
n6 AS (SELECT s.read_id, s.value FROM fx_signal s LEFT JOIN n5 ON n5.read_id = s.read_id WHERE n5.lo IS NULL OR s.pos BETWEEN n5.lo AND n5.hi), """ + _MED.format(src="n6")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if c in names else c for c in df.columns))


@query("norm_med_mad", "fx_signal", sql=f"WITH {_MED.format(src='fx_signal')} SELECT s.read_id, s.pos, round((s.value - med) / nullif(mad, 0), 6) AS norm FROM fx_signal s JOIN ma ON ma.read_id = s.read_id")
def norm_med_mad(signal):
    return _rounded(N.norm_med_mad(signal).select("read_id", "pos", "norm"), "norm")


@query("norm_noisiest", "fx_signal", sql=f"WITH {_NOISE} SELECT s.read_id, s.pos, round((s.value - med + 0.5) / nullif(mad, 0), 6) AS norm FROM fx_signal s JOIN ma ON ma.read_id = s.read_id")
def norm_noisiest(signal):
    return _rounded(N.norm_noisiest(signal, samples=8, offset=0.5).select("read_id", "pos", "norm"), "norm")


@query("diff_norm", "fx_signal", sql=f"WITH {_NOISE}, d AS (SELECT read_id, pos, value - lag(value) OVER (PARTITION BY read_id ORDER BY pos) AS d FROM fx_signal) SELECT d.read_id, d.pos, round(d / nullif(mad, 0), 6) AS norm FROM d JOIN ma ON ma.read_id = d.read_id WHERE d IS NOT NULL")
def diff_norm(signal):
    return _rounded(N.diff_norm_noisiest(signal, samples=8), "norm")


@query("diff_norm_fixed", "fx_signal", sql="WITH d AS (SELECT read_id, pos, value - lag(value) OVER (PARTITION BY read_id ORDER BY pos) AS d FROM fx_signal) SELECT read_id, pos, round(d / 100, 6) AS norm FROM d WHERE d IS NOT NULL")
def diff_norm_fixed(signal):
    return _rounded(N.diff_norm_fixed(signal), "norm")


@query("norm_combine", "fx_path", sql=f"WITH {_RUN}, c AS (SELECT read_id, avg(m) AS centre, sqrt(avg(v) + var_pop(m)) AS scale FROM ru GROUP BY read_id) SELECT p.read_id, p.pos, round((p.value - centre) / nullif(scale, 0), 6) AS norm FROM fx_path p JOIN c ON c.read_id = p.read_id")
def norm_combine(path):
    return _rounded(N.norm_combine(path).select("read_id", "pos", "norm"), "norm")


@query("norm_dwell", "fx_path", sql=f"WITH {_RUN}, c AS (SELECT read_id, avg(m) AS centre, sqrt(avg(v)) AS scale FROM ru WHERE length > 1 GROUP BY read_id) SELECT p.read_id, p.pos, round((p.value - centre) / nullif(scale, 0), 6) AS norm FROM fx_path p LEFT JOIN c ON c.read_id = p.read_id")
def norm_dwell(path):
    return _rounded(N.norm_dwell(path).select("read_id", "pos", "norm"), "norm")


_LEVELS = "lv AS (SELECT state AS kmer, round(avg(value), 3) AS level_mean FROM fx_path GROUP BY state)"


def _levels(path: DataFrame) -> DataFrame:
    return path.groupBy(F.col("state").alias("kmer")).agg(F.round(F.avg("value"), 3).alias("level_mean"))


@query("rescale_dwell", "fx_path", sql=f"""WITH {_RUN}, {_LEVELS}, f AS (SELECT read_id, regr_slope(level_mean, med) AS a, avg(level_mean) AS mr, avg(med) AS ms, count(*) AS n FROM ru JOIN lv ON lv.kmer = ru.state WHERE length >= 2 GROUP BY read_id),
g AS (SELECT read_id, CASE WHEN n >= 2 AND isfinite(a) THEN a END AS a, mr - a * ms AS b FROM f)
SELECT p.read_id, p.pos, round(CASE WHEN g.a IS NULL THEN p.value ELSE g.a * p.value + g.b END, 6) AS rescaled, g.a IS NOT NULL AS fitted FROM fx_path p LEFT JOIN g ON g.read_id = p.read_id""")
def rescale_dwell(path):
    return _rounded(N.rescale_dwell(path, _levels(path), min_dwell=2).select("read_id", "pos", "rescaled", "fitted"), "rescaled")


@query("user_statistic", "fx_path", sql=f"""WITH {_RUN.replace('median(value)', 'max(value)')}, {_LEVELS}, f AS (SELECT read_id, regr_slope(level_mean, med) AS a, avg(level_mean) AS mr, avg(med) AS ms, count(*) AS n FROM ru JOIN lv ON lv.kmer = ru.state WHERE length >= 2 GROUP BY read_id),
g AS (SELECT read_id, CASE WHEN n >= 2 AND isfinite(a) THEN a END AS a, mr - a * ms AS b FROM f)
SELECT p.read_id, p.pos, round(CASE WHEN g.a IS NULL THEN p.value ELSE g.a * p.value + g.b END, 6) AS rescaled, g.a IS NOT NULL AS fitted FROM fx_path p LEFT JOIN g ON g.read_id = p.read_id""")
def user_statistic(path):
    """Rescaling by a statistic of the caller's: each run's largest value in place of its median."""
    return _rounded(N.rescale_dwell(path, _levels(path), min_dwell=2, statistic=F.max).select("read_id", "pos", "rescaled", "fitted"), "rescaled")


@query("runs", "fx_path", sql=f"WITH {_RUN} SELECT read_id, state, start, \"end\", length FROM ru")
def runs(path):
    return G.runs(path)


@query("kmer_profile", "fx_path", sql="SELECT state, count(*) AS n, round(avg(value), 6) AS level_mean, round(stddev_pop(value), 6) AS level_stdv FROM fx_path GROUP BY state")
def kmer_profile(path):
    return _rounded(A.kmer_profile(path), "level_mean", "level_stdv")


@query("kmer_dwell", "fx_path", sql=f"WITH {_RUN} SELECT state, length, count(*) AS n FROM ru GROUP BY state, length")
def kmer_dwell(path):
    return A.kmer_dwell(path)


@query("transition_weights", "fx_path", sql=f"WITH {_RUN}, t AS (SELECT state, length, lead(state) OVER (PARTITION BY read_id ORDER BY start) AS nx FROM ru) SELECT state, right(nx, 1) AS next_base, count(*) AS n_runs, round(count(*) / (sum(length) + 1e-6), 6) AS weight FROM t WHERE nx IS NOT NULL GROUP BY state, right(nx, 1)")
def transition_weights(path):
    return _rounded(A.transition_weights(path), "weight")


_BASES = "bm AS (SELECT read_id, t, CAST(sum(move) OVER (PARTITION BY read_id ORDER BY t) - 1 AS BIGINT) AS base_index FROM fx_moves)"


@query("base_positions", "fx_moves", sql=f"WITH {_BASES} SELECT read_id, t * 5 + d AS pos, base_index FROM bm, (SELECT unnest(range(0, 5)) AS d) WHERE base_index >= 0")
def base_positions(moves):
    return G.base_positions(moves, 5)


@query("signal_extent", "fx_moves", sql=f"""WITH {_BASES}, e AS (SELECT read_id, base_index, min(t) * 5 + 3 AS a, (max(t) + 1) * 5 + 3 AS b FROM bm WHERE base_index >= 0 GROUP BY read_id, base_index), l AS (SELECT read_id, count(*) * 5 + 10 AS sig_len, read_id % 2 = 1 AS rev FROM fx_moves GROUP BY read_id)
SELECT e.read_id, CASE WHEN rev THEN max(base_index) OVER (PARTITION BY e.read_id) - base_index ELSE base_index END AS base_index, CASE WHEN rev THEN sig_len - b ELSE a END AS sig_start, CASE WHEN rev THEN sig_len - a ELSE b END AS sig_end FROM e JOIN l ON l.read_id = e.read_id""")
def signal_extent(moves):
    lengths = moves.groupBy("read_id").agg((F.count("*") * 5 + 10).alias("sig_len")).select("read_id", "sig_len", F.lit(3).alias("trim"), (F.col("read_id") % 2 == 1).alias("is_reverse"))
    return G.signal_extent(moves, lengths, 5)


@query("chunk_fixed", "fx_signal", sql="WITH c AS (SELECT read_id, pos // 20 AS chunk_no, count(*) AS duration, sum(value) AS total FROM fx_signal GROUP BY 1, 2) SELECT read_id, CAST(chunk_no AS INTEGER) AS chunk_no, CAST(duration AS INTEGER) AS duration, 20 AS n, round(total, 6) AS total FROM c")
def chunk_fixed(signal):
    rows = signal.groupBy("read_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("v"))
    rows = rows.select("read_id", F.explode(G.chunk_fixed("v", 20)).alias("c"))
    return rows.select("read_id", "c.chunk_no", "c.duration", F.size("c.values").alias("n"), F.round(F.aggregate("c.values", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("chunk_overlap", "fx_signal", sql="""WITH n AS (SELECT read_id, count(*) AS n FROM fx_signal GROUP BY read_id), s AS (SELECT read_id, n, unnest(CASE WHEN n <= 5 THEN [0] ELSE range(0, n - 5, 15) END) AS s FROM n)
SELECT s.read_id, CAST(s.s // 15 AS INTEGER) AS chunk_no, CAST(count(*) AS INTEGER) AS duration, round(sum(f.value), 6) AS total FROM s JOIN fx_signal f ON f.read_id = s.read_id AND f.pos >= s.s AND f.pos < s.s + 20 GROUP BY s.read_id, s.s""")
def chunk_overlap(signal):
    rows = signal.groupBy("read_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("v"))
    rows = rows.select("read_id", F.explode(G.chunk_overlap("v", 20, 5)).alias("c"))
    return rows.select("read_id", "c.chunk_no", "c.duration", F.round(F.aggregate("c.values", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("chunk_label", "fx_moves", sql=f"""WITH {_BASES}, p AS (SELECT read_id, t // 12 AS chunk_no, base_index, count(*) AS k FROM bm WHERE base_index >= 0 GROUP BY 1, 2, 3), c AS (SELECT read_id, chunk_no, min(base_index) AS a, max(base_index) AS b, max(k) AS longest FROM p GROUP BY 1, 2),
s AS (SELECT DISTINCT read_id, base_index, CASE base_index % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'G' ELSE 'T' END AS base, CASE WHEN base_index % 9 = 0 THEN 0 ELSE 1 END AS quality FROM bm WHERE base_index % 6 <> 5 AND base_index >= 0),
h AS (SELECT c.read_id, c.chunk_no, c.longest, avg(s.quality) AS q, string_agg(s.base, '' ORDER BY s.base_index) AS bases FROM c LEFT JOIN s ON s.read_id = c.read_id AND s.base_index BETWEEN c.a AND c.b GROUP BY 1, 2, 3)
SELECT read_id, chunk_no, CASE WHEN chunk_no >= 5 THEN 'Y' WHEN q IS NULL THEN '' WHEN q <= 0.7 THEN 'X' WHEN longest > 7 THEN 'P' ELSE bases END AS label FROM h""")
def chunk_label(moves):
    index = G.base_positions(moves, 1)
    chunks = index.groupBy("read_id", F.floor(F.col("pos") / 12).alias("chunk_no"), "base_index").agg(F.count("*").alias("k")).groupBy("read_id", "chunk_no").agg(F.min("base_index").alias("first_base"), F.max("base_index").alias("last_base"), F.max("k").alias("longest_base"))
    bases = index.select("read_id", "base_index").distinct().where("base_index % 6 <> 5").select("read_id", F.col("base_index").alias("ord"), "base_index", F.substring(F.lit("ACGT"), (F.col("base_index") % 4 + 1).cast("int"), F.lit(1)).alias("base"), (F.col("base_index") % 9 != 0).cast("int").alias("quality"))
    return G.label_chunks(chunks, bases, 0.7, 7, F.col("chunk_no") >= 5)


@query("emission_update", "fx_path", sql="""WITH g AS (SELECT state, sum(w) AS w, sum(w * value) AS wx, sum(w * value * value) AS wxx FROM (SELECT *, (pos % 4) / 4.0::DOUBLE AS w FROM fx_path) GROUP BY state), m AS (SELECT *, wx / (w + 1e-6) AS mu FROM g)
SELECT state, round(CASE WHEN state LIKE '%e%' THEN mu ELSE 1.0 END, 6) AS mean, round(CASE WHEN state LIKE '%e%' THEN (wxx - 2 * mu * wx + mu * mu * w) / (w + 1e-6) ELSE 2.0 END, 4) AS variance FROM m""")
def emission_update(path):
    weights = path.select("state", "value", (F.col("pos") % 4 / 4.0).alias("weight"))
    means = path.select("state").distinct().select("state", F.lit(1.0).alias("mean"), F.lit(2.0).alias("variance"))
    out = A.emission_update(weights, means, F.contains("state", F.lit("e")))
    return out.select("state", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"))


@query("segment_mse", "fx_path", sql=f"WITH {_LEVELS} SELECT read_id, round(avg((value - level_mean) * (value - level_mean)), 6) AS mse FROM fx_path p JOIN lv ON lv.kmer = p.state GROUP BY read_id")
def segment_mse(path):
    return _rounded(A.segment_mse(path, _levels(path)), "mse")


@query("path_difference", "fx_path", sql="SELECT read_id, round(avg(CASE WHEN state = 'click' AND pos % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS different FROM fx_path GROUP BY read_id")
def path_difference(path):
    other = path.withColumn("state", F.when((F.col("state") == "click") & (F.col("pos") % 2 == 0), "view2").otherwise(F.col("state")))
    return _rounded(A.path_difference(path, other), "different")


@query("training_curve", "fx_errors", sql="""WITH e AS (SELECT step, avg(error) AS m, stddev_pop(error) AS s FROM fx_errors GROUP BY step),
r AS (SELECT a.step, sum(b.m * pow(0.9::DOUBLE, a.step - b.step) * CASE WHEN b.step = 1 THEN 1 ELSE 0.1::DOUBLE END) AS smooth FROM e a JOIN e b ON b.step BETWEEN a.step - 400 AND a.step GROUP BY a.step)
SELECT e.step, round(m, 6) AS mean, round(s, 6) AS std, round(smooth, 6) AS smooth FROM e JOIN r ON r.step = e.step""")
def training_curve(errors):
    return _rounded(A.training_curve(errors, 0.9), "mean", "std", "smooth")


@query("roc_sweep", "fx_scores", sql="WITH t AS (SELECT unnest(range(0, 501)) / 500.0::DOUBLE AS threshold) SELECT threshold, round(count(*) FILTER (positive AND score > threshold) / count(*) FILTER (positive), 6) AS tp, round(count(*) FILTER (NOT positive AND score > threshold) / count(*) FILTER (NOT positive), 6) AS fp FROM t, fx_scores GROUP BY threshold")
def roc_sweep(scores):
    return _rounded(A.roc_sweep(scores), "tp", "fp")


_ROC = "t AS (SELECT unnest(range(0, 501)) / 500.0::DOUBLE AS threshold), c AS (SELECT threshold, count(*) FILTER (positive AND score > threshold) / count(*) FILTER (positive) AS tp, count(*) FILTER (NOT positive AND score > threshold) / count(*) FILTER (NOT positive) AS fp FROM t, fx_scores GROUP BY threshold)"


@query("auc", "fx_scores", sql=f"WITH {_ROC}, p AS (SELECT tp, fp FROM c UNION ALL SELECT 0, 0 UNION ALL SELECT 1, 1), l AS (SELECT tp, fp, lag(tp) OVER (ORDER BY fp, tp) AS tp0, lag(fp) OVER (ORDER BY fp, tp) AS fp0 FROM p) SELECT round(sum((fp - fp0) * (tp + tp0) / 2), 6) AS auc FROM l")
def auc(scores):
    return _rounded(A.auc(A.roc_sweep(scores)), "auc")


@query("consensus_test", "fx_scores", sql=f"WITH {_ROC} SELECT threshold, round(10 * tp**3 * (1 - tp)**2 + 5 * tp**4 * (1 - tp) + tp**5, 6) AS tp, round(10 * fp**3 * (1 - fp)**2 + 5 * fp**4 * (1 - fp) + fp**5, 6) AS fp FROM c")
def consensus_test(scores):
    return _rounded(A.consensus_test(A.roc_sweep(scores), 5), "tp", "fp")


@query("invariant_segments", "fx_path", sql=f"""WITH RECURSIVE {_RUNS}, cu AS (SELECT read_id, state, min(pos) AS p FROM r1 GROUP BY read_id, g, state HAVING NOT contains(state, 'a')),
nx AS (SELECT c.read_id, c.p, c.state, min(d.p) AS q FROM cu c LEFT JOIN cu d ON d.read_id = c.read_id AND d.p >= c.p + 10 GROUP BY ALL),
w AS (SELECT read_id, p, state, q FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY p) AS n FROM nx) WHERE n = 1 UNION ALL SELECT n.read_id, n.p, n.state, n.q FROM w JOIN nx n ON n.read_id = w.read_id AND n.p = w.q)
SELECT w.read_id, w.p AS start, w.q AS "end", w.state AS first, c.state AS last FROM w JOIN cu c ON c.read_id = w.read_id AND c.p = w.q""")
def invariant_segments(path):
    return G.invariant_segments(path, lambda s: ~s.contains("a"), 10)


@query("distill", "fx_moves", sql="""WITH RECURSIVE f AS (SELECT read_id, t, CAST(sum(move) OVER (PARTITION BY read_id ORDER BY t) - 1 AS BIGINT) AS i FROM fx_moves),
b AS (SELECT read_id, i, min(t) * 5 AS s, (max(t) + 1) * 5 AS e, i % 7 <> 3 AS mapped FROM f WHERE i >= 0 GROUP BY read_id, i),
n AS (SELECT a.read_id, a.i, a.s, max(z.i) AS j, a.mapped AND max(z.i) >= a.i + 2 AS good FROM b a LEFT JOIN b z ON z.read_id = a.read_id AND z.mapped AND z.e <= a.s + 60 AND z.i > a.i GROUP BY a.read_id, a.i, a.s, a.mapped),
w AS (SELECT read_id, i, s, j, coalesce(good, false) AS good FROM n WHERE i = 0 UNION ALL SELECT n.read_id, n.i, n.s, n.j, coalesce(n.good, false) FROM w JOIN n ON n.read_id = w.read_id AND n.i = CASE WHEN w.good THEN w.j + 1 ELSE w.i + 5 END)
SELECT w.read_id, w.i AS first_base, w.j AS last_base, w.i + 100 AS ref_start, w.j + 100 AS ref_end, w.s AS sig_start, z.e AS sig_end, array_to_string(list_transform(range(w.i, w.j + 1), lambda x: 'ACGT'[x % 4 + 1]), '') AS seq
FROM w JOIN b z ON z.read_id = w.read_id AND z.i = w.j WHERE w.good""")
def distill(moves):
    lengths = moves.groupBy("read_id").agg((F.count("*") * 5).alias("sig_len")).select("read_id", "sig_len", F.lit(0).alias("trim"), F.lit(False).alias("is_reverse"))
    bases = G.signal_extent(moves, lengths, 5).select("read_id", "base_index", F.substring(F.lit("ACGT"), (F.col("base_index") % 4 + 1).cast("int"), F.lit(1)).alias("base"), "sig_start", "sig_end", F.when(F.col("base_index") % 7 != 3, F.col("base_index") + 100).alias("ref_pos"))
    return G.distill(bases, 60)
