"""Queries that read a table as a stream, run it to its end, and return what the sink holds."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqspark.plans.catalog import QUERIES, SQL, duck
from seqspark.shared import shared_path as _folder
from seqspark.streaming import reads as R


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    # a pattern stands for a file as well as for a folder of files
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[t]")


def _finished(out: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """The rows of a stream that was run over all that there is."""
    spark, path, state = out.sparkSession, _folder(out.sparkSession, name), _folder(out.sparkSession, f"{name}-state")
    if mode == "append":
        run = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    else:
        run = out.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(path)


def stream_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as chunks of a read; a gap of 12 hours ends the read."""
    calls = _stream(spark, sf_dir, "events").select(F.col("user_id").alias("read_id"), F.struct(F.col("ts").alias("at"), "event_id").alias("chunk_no"), F.substring("event_type", 1, 1).alias("seq"), F.col("ts").cast("timestamp").alias("ts"))
    return _finished(R.stream_assemble(calls, gap="12 hours", delay="1 hour"), "assembled")


def stream_to_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as records; every seventh lacks its signal and is left out."""
    rows = _stream(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("record_id"), F.when(F.col("vec_id") % 7 > 0, F.col("embedding")).alias("signal"), F.lit("ACGT").alias("seq"), F.lit(4).alias("seq_len"), F.size("embedding").alias("signal_len"))
    path = _folder(spark, "records")
    R.stream_to_dataset(rows, path, _folder(spark, "records-state")).awaitTermination()
    return spark.read.parquet(path).select("record_id", "seq_len", "signal_len")


def stream_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments while their bin has room, counted by bin."""
    rows = _stream(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("read_id"), (F.col("l_suppkey") % 100).alias("contig"), F.col("l_partkey").alias("r_start"))
    return _finished(R.stream_balance(rows, 40, 500), "balanced").groupBy("contig", "bin").agg(F.count("*").alias("n"))


def stream_site_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage and modified share of each place, kept up to date."""
    rows = _stream(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 100).alias("contig"), F.col("l_partkey").alias("refpos"), (F.col("l_returnflag") == "A").alias("modified"))
    out = _finished(R.stream_site_coverage(rows), "coverage", "complete")
    return out.select("contig", "refpos", "coverage", F.round("modified_prob", 6).alias("modified_prob"))


QUERIES |= {f.__name__: f for f in (stream_assemble, stream_to_dataset, stream_balance, stream_site_coverage)}
SQL |= {
    "stream_assemble": duck("""WITH e AS (SELECT user_id, ts, event_id, event_type, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM e), m AS (SELECT max(ts) - INTERVAL 1 HOUR AS w FROM events)
SELECT user_id AS read_id, string_agg(event_type[1], '' ORDER BY ts, event_id) AS seq, count(*) AS n_chunks FROM s, m GROUP BY user_id, g, m.w HAVING max(ts) + INTERVAL 12 HOUR <= m.w"""),
    "stream_to_dataset": "SELECT vec_id AS record_id, 4 AS seq_len, CAST(len(embedding) AS INTEGER) AS signal_len FROM embeddings WHERE vec_id % 7 > 0",
    "stream_balance": "SELECT l_suppkey % 100 AS contig, CAST(l_partkey // 500 AS BIGINT) AS bin, least(count(*), 40) AS n FROM lineitem GROUP BY 1, 2",
    "stream_site_coverage": "SELECT l_suppkey % 100 AS contig, l_partkey AS refpos, count(*) AS coverage, round(avg(CASE WHEN l_returnflag = 'A' THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS modified_prob FROM lineitem GROUP BY 1, 2",
}
