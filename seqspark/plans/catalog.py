"""The register of queries, and the views they run on, in Spark's and DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seqspark.functions.sequence import evaluated

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# fx_frames: 64 values and two more make eleven frames of six classes
_BOTH = {
    "fx_ref": "SELECT read_id AS contig, replace(seq, 'M', 'A') AS seq, CAST(length(seq) AS BIGINT) AS length FROM fx_reads",
    "fx_signal": "SELECT user_id AS read_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS pos, value FROM events",
    "fx_path": "SELECT user_id AS read_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS pos, event_type AS state, value FROM events",
    "fx_moves": "SELECT read_id, pos AS t, CASE WHEN pos = 0 OR state IN ('click', 'purchase') THEN 1 ELSE 0 END AS move FROM fx_path",
    "fx_chunks": "SELECT vec_id AS chunk_id, label AS read_id, embedding AS signal, CAST(40 + vec_id % 25 AS BIGINT) AS duration FROM embeddings",
    "fx_aln": "SELECT l_suppkey % 100 AS contig, l_partkey AS r_start, CAST(l_partkey + l_quantity AS BIGINT) AS r_end, concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(20)), '-', CAST(l_partkey AS VARCHAR(20)), '-', CAST(l_suppkey AS VARCHAR(20))) AS read_id, l_linestatus = 'F' AS is_reverse, l_returnflag = 'A' AS modified FROM lineitem",
    "fx_sites": "SELECT o_custkey % 100 AS contig, o_orderkey % 2000 AS s, o_orderkey % 2000 AS e, CASE WHEN o_orderstatus = 'F' THEN 1.0E0 ELSE 0.0E0 END AS status FROM orders",
    "fx_exons": "SELECT l_orderkey AS tx_id, CASE WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS BIGINT) AS ord, l_partkey * 100 AS g_start, CAST(l_partkey * 100 + l_quantity - 1 AS BIGINT) AS g_end FROM lineitem",
    "fx_mod_sites": "SELECT doc_id AS contig, doc_id % 40 AS pos, quality AS status FROM labels",
    "fx_scores": "SELECT event_type IN ('purchase', 'signup') AS positive, value / 500.0E0 AS score FROM events",
    "fx_errors": "SELECT event_type AS run, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS BIGINT) AS step, value / 500.0E0 AS error FROM events",
}
SPARK_VIEWS = _BOTH | {
    "fx_reads": "SELECT doc_id AS read_id, source AS contig, regexp_replace(upper(text), '[^ACGTM]', '') AS seq FROM documents",
    "fx_frames": "SELECT label AS read_id, vec_id AS chunk_id, CAST(i DIV 6 AS BIGINT) AS t, CAST(i % 6 AS BIGINT) AS cls, CAST(v AS DOUBLE) AS logit FROM embeddings LATERAL VIEW posexplode(concat(embedding, array(CAST(-1 AS FLOAT), CAST(-2 AS FLOAT)))) e AS i, v",
}
DUCK_VIEWS = _BOTH | {
    "fx_reads": "SELECT doc_id AS read_id, source AS contig, regexp_replace(upper(text), '[^ACGTM]', '', 'g') AS seq FROM documents",
    "fx_frames": "SELECT read_id, chunk_id, CAST(i // 6 AS BIGINT) AS t, CAST(i % 6 AS BIGINT) AS cls, CAST(v AS DOUBLE) AS logit FROM (SELECT label AS read_id, vec_id AS chunk_id, unnest(list_concat(embedding, [-1::FLOAT, -2::FLOAT])) AS v, generate_subscripts(list_concat(embedding, [-1::FLOAT, -2::FLOAT]), 1) - 1 AS i FROM embeddings)",
}

#: Columns of views that scan whole texts: read by later columns and filters, not repeated in each.
EVALUATED = {"fx_reads": "seq"}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``, or a view over such tables."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = SPARK_VIEWS[name]
    needed = {t: view(spark, sf_dir, t) for t in (*TABLES, *SPARK_VIEWS) if f"FROM {t}" in f"{text} " and t != name and f"FROM {t}_" not in text}
    for t in needed:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    df = spark.sql(text, **needed)
    return evaluated(df, EVALUATED[name], df[EVALUATED[name]]) if name in EVALUATED else df


def duck(sql: str) -> str:
    """DuckDB SQL with the views it names in front."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in DUCK_VIEWS:
            if name in text and name not in order:
                need(DUCK_VIEWS[name])
                order.append(name)

    need(sql)
    views = ", ".join(f"{n} AS ({DUCK_VIEWS[n]})" for n in order)
    sql = sql.strip()
    if not views:
        return sql
    if sql.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views}, {sql[15:]}"
    return f"WITH {views}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {views} {sql}"


def query(name: str, *views: str, sql: str | None = None) -> Callable:
    """Register ``f(*frames)`` as a query over the given tables and views."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(*(view(spark, sf_dir, v) for v in views))
        if sql is not None:
            SQL[name] = duck(sql)
        return f

    return add
