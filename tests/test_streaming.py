"""Streams against their batch forms."""

from pyspark.sql import functions as F

from seqspark.operators.aggregates import site_summary
from seqspark.streaming import reads as R


def _run(out, path, mode="append"):
    out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return out.sparkSession.read.parquet(f"{path}/out")


def test_reads_are_assembled_once(spark, tmp_path):
    data = spark.sql("SELECT CAST(id DIV 4 AS INT) AS read_id, CAST(3 - id % 4 AS INT) AS chunk_no, substring('ACGT', CAST(4 - id % 4 AS INT), 1) AS seq, timestamp_seconds(id DIV 4 * 3600 + 3 - id % 4) AS ts FROM range(40)")
    data.write.parquet(f"{tmp_path}/in")
    got = _run(R.stream_assemble(spark.readStream.schema(data.schema).parquet(f"{tmp_path}/in")), tmp_path)
    assert sorted((r.read_id, r.seq, r.n_chunks) for r in got.collect()) == [(i, "ACGT", 4) for i in range(9)]


def test_records_are_appended_once(spark, tmp_path):
    data = spark.sql("SELECT id, CASE WHEN id % 3 > 0 THEN array(1.0D) END AS signal, 'A' AS seq, 1 AS seq_len, 1 AS signal_len FROM range(9)")
    for _ in range(2):
        data.write.mode("append").parquet(f"{tmp_path}/in")
        R.stream_to_dataset(spark.readStream.schema(data.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").groupBy("id").count().where("count = 2").count() == 6


def test_balance_over_batches(spark, tmp_path):
    data = spark.sql("SELECT id AS read_id, 'c' AS contig, id % 2 * 100 AS r_start FROM range(20)")
    data.write.parquet(f"{tmp_path}/in")
    got = _run(R.stream_balance(spark.readStream.schema(data.schema).parquet(f"{tmp_path}/in"), 3, 50), tmp_path)
    assert sorted((r.bin, r["count"]) for r in got.groupBy("bin").count().collect()) == [(0, 3), (2, 3)]


def test_coverage_follows_the_batch_form(spark, tmp_path):
    data = spark.sql("SELECT 'c' AS contig, id % 5 AS refpos, id % 3 = 0 AS modified, 0.5D AS prob FROM range(50)")
    data.write.parquet(f"{tmp_path}/in")
    stream = R.stream_site_coverage(spark.readStream.schema(data.schema).parquet(f"{tmp_path}/in"))
    stream.writeStream.foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/state").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("refpos", "coverage", F.round("modified_prob", 6)).collect()}
    assert got == {tuple(r) for r in site_summary(data).select("refpos", "coverage", F.round("modified_prob", 6)).collect()}
