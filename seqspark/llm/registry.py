"""Queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqspark.llm import decontaminate, line_dedup, minhash, packing, periodic, pii, quality, secret_scan, simhash, substring_dedup, suffix_dedup, token_alignment, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.drop_repeats(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes", "n_passages")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(_table(spark, sf_dir, "documents")))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(_table(spark, sf_dir, "documents")))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives hold, read back from them."""
    return warc.read_bundles(warc.write_bundles(_table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each benchmark item found in a document."""
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.drop_boilerplate(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("kept_md5"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train_quality_model(docs, _table(spark, sf_dir, "labels")))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.drop_repeats(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.corpus_alignment(_table(spark, sf_dir, "documents"))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.find_runs(periodic.planted(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = minhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


LINE_SQL = f"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
totals AS (SELECT source, count(*) AS total FROM d WHERE text IS NOT NULL GROUP BY source),
l AS (SELECT source, unnest(list_distinct(list_transform(lines, lambda x: trim(x, ' ')))) AS line FROM d),
c AS (SELECT source, line, count(*) AS n FROM l WHERE line <> '' GROUP BY source, line),
b AS (SELECT c.source, list(c.line) AS ls FROM c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
      WHERE c.n > 1 AND c.n * 100 > t.total * {line_dedup.RATIO_PERCENT} GROUP BY c.source),
k AS (SELECT d.doc_id, d.text, d.lines, list_filter(d.lines, lambda x: NOT coalesce(list_contains(b.ls, trim(x, ' ')), false)) AS kept
      FROM d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(lines) - len(kept), 0) AS BIGINT) AS n_dropped,
       CASE WHEN text IS NOT NULL THEN md5(array_to_string(kept, chr(10))) END AS kept_md5
FROM k
"""


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT p.page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(1 + ((CAST('0x' || substr(p.h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN p.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id <> f.first THEN f.first END AS refers_to
FROM p JOIN f ON p.h = f.h
"""


SUBSTRING_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT rid, doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13),
v AS (SELECT rid, doc_id, p, array_to_string(w[p : p + 12], ' ') AS v FROM s),
f AS (SELECT v, min(doc_id) AS first FROM v GROUP BY v),
g AS (SELECT rid, list(DISTINCT i) AS gone FROM (SELECT rid, unnest(range(p, p + 13)) AS i FROM v JOIN f USING (v) WHERE f.first < doc_id) GROUP BY rid),
k AS (SELECT doc_id, w, list_filter(w, lambda x, i: NOT coalesce(list_contains(gone, i), false)) AS kept FROM d LEFT JOIN g USING (rid))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - len(kept) AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""


# the CRC-32 of the decimal id, byte by byte and bit by bit; then equal words q apart, their stretches, and those without a smaller period
PERIODIC_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
           xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)),
               lambda crc, c: list_reduce(range(0, 8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, c)), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM documents),
g AS (SELECT rid, doc_id, w, len(w) AS n, h // 10 AS g, coalesce(h % 10 = 0 AND len(w) > 0, false) AS turned FROM d),
q AS (SELECT rid, doc_id, w, n, CASE WHEN turned THEN g % n ELSE n END AS a, CASE WHEN turned THEN 1 + (n - g % n) // (3 + g % 8) ELSE 1 END AS p FROM g),
t AS MATERIALIZED (SELECT rid, doc_id, n, list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) AS w FROM q),
x AS MATERIALIZED (SELECT rid, n, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS i FROM t),
e AS (SELECT a.rid, b.i - a.i AS q, a.i FROM x a JOIN x b ON a.rid = b.rid AND a.w = b.w AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
s AS MATERIALIZED (SELECT rid, q, min(i) AS s, count(*) + q AS n FROM (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS k FROM e) GROUP BY rid, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
u AS MATERIALIZED (SELECT * FROM s r WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.rid = r.rid AND o.q < r.q AND r.q % o.q = 0 AND o.s <= r.s AND o.s + o.n >= r.s + r.n)),
v AS (SELECT rid, count(*) AS n_runs, arg_min({'s': s, 'n': n, 'q': q}, {'e': -n::DOUBLE / q, 's': s, 'q': q}) AS b, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM u GROUP BY rid),
o AS (SELECT DISTINCT rid, unnest(range(s + q, s + n)) AS i FROM u),
k AS (SELECT x.rid, string_agg(x.w, ' ' ORDER BY x.i) AS kept FROM x LEFT JOIN o ON o.rid = x.rid AND o.i = x.i WHERE o.i IS NULL GROUP BY x.rid)
SELECT t.doc_id, CAST(coalesce(v.n_runs, 0) AS BIGINT) AS n_runs, CAST(v.b.s AS BIGINT) AS start, CAST(v.b.n AS BIGINT) AS length, CAST(v.b.q AS BIGINT) AS period, CAST(1000 * v.b.n // v.b.q AS BIGINT) AS exponent_milli,
       sha256(coalesce(v.lines, '')) AS runs_sha256, sha256(coalesce(k.kept, '')) AS collapsed_sha256
FROM t LEFT JOIN v ON v.rid = t.rid LEFT JOIN k ON k.rid = t.rid
"""


MINHASH_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT rid, array_to_string(w[p : p + 4], ' ') AS s FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT rid, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS h FROM s GROUP BY rid),
c AS MATERIALIZED (SELECT h, min(rid) AS rid, any_value(n) AS n FROM n GROUP BY h),
t AS MATERIALIZED (SELECT s.rid, s.s FROM s JOIN c USING (rid)),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS m FROM t a JOIN t b ON a.s = b.s AND a.rid <> b.rid GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN c x ON x.rid = a JOIN c y ON y.rid = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
r AS (SELECT rid AS a, rid AS b FROM c UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
k AS (SELECT r.a AS rid, min(d.doc_id) AS least FROM r JOIN c ON c.rid = r.b JOIN n ON n.h = c.h JOIN d ON d.rid = n.rid GROUP BY r.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(k.least, d.doc_id) AS component_id, d.doc_id IS NOT DISTINCT FROM coalesce(k.least, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.rid = d.rid LEFT JOIN c ON c.h = n.h LEFT JOIN k ON k.rid = c.rid
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_secrets, op3_pii, op4_warc, op5_decontaminate, op6_packing, op7_simhash, op8_line_dedup, op9_quality, op10_substring_dedup, op11_token_alignment, op12_periodic, op13_minhash)}


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": WARC_SQL, "op8_line_dedup": LINE_SQL, "op10_substring_dedup": SUBSTRING_SQL, "op12_periodic": PERIODIC_SQL, "op13_minhash": MINHASH_SQL}
