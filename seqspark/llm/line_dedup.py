"""Line dedup by site-relative frequency.

Pages are grouped by host.  For each line, the number of the host's pages that contain it is
divided by the host's page total; lines over ``percent`` are boilerplate and go, from every page
of that host.  A line on a single page repeats nothing and stays, however few pages its host has.
With ``distinct``, exact copies of a page count as one page, above and below the fraction, so
that a page which is copied often is not taken for boilerplate.

Lines are compared by the 64-bit hash of their text without surrounding blanks; blank lines stay.
Defined results: a null host is a host of its own; a null text has no lines, stays null and is no
page; repeated rows are pages each and are cleaned alike; a page of boilerplate alone becomes the
empty text; further columns pass through, but for columns named n_lines and n_dropped, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seqspark.llm.components import stored

RATIO_PERCENT = 8
#: Boilerplate lines up to this number are broadcast (8 bytes each); more are joined by host.
BROADCAST_ROWS = 1_000_000


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", percent: int = RATIO_PERCENT, distinct: bool = False) -> DataFrame:
    """(host, line): per host, the hashes of the lines over the ratio.  At most 100 / percent times the mean lines of a page for each host."""
    pages = pages.select(F.col(host).alias("host"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    lines = pages.selectExpr("host", "xxhash64(text) AS page", "explode(array_distinct(transform(filter(transform(split(text, '\n', -1), x -> trim(x)), x -> x <> ''), x -> xxhash64(x)))) AS line")
    count = F.count_distinct("page") if distinct else F.count("*")
    total = F.count_distinct(F.xxhash64("text")) if distinct else F.count("*")
    lines = lines.groupBy("host", "line").agg(count.alias("n")).where("n > 1")
    totals = pages.groupBy("host").agg(total.alias("total"))
    over = lines.join(totals, lines["host"].eqNullSafe(totals["host"])).where(F.col("n") * 100 > F.col("total") * percent)
    return over.select(lines["host"].alias("host"), "line")


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", percent: int = RATIO_PERCENT, distinct: bool = False) -> DataFrame:
    """``pages`` with their boilerplate lines removed, and two columns more: n_lines and n_dropped."""
    over = stored(boilerplate(pages, host, text, percent, distinct), "boilerplate")
    found = over.groupBy(F.col("host").alias("_seqspark_host")).agg(F.collect_list("line").alias("_seqspark_lines"))
    if over.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    rows = pages.join(found, pages[host].eqNullSafe(found["_seqspark_host"]), "left")
    lines = F.split(F.col(text), "\n", -1)
    # pages of hosts without boilerplate are not taken apart
    kept = F.when(F.col("_seqspark_lines").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains("_seqspark_lines", F.xxhash64(F.trim(x)))))
    rows = rows.withColumn("_seqspark_kept", kept).withColumn("n_lines", F.greatest(F.size(lines), F.lit(0)).cast("long"))
    rows = rows.withColumn("n_dropped", F.when(F.col("_seqspark_kept").isNull(), 0).otherwise(F.col("n_lines") - F.size("_seqspark_kept")).cast("long"))
    return rows.withColumn(text, F.when(F.col("n_dropped") > 0, F.array_join("_seqspark_kept", "\n")).otherwise(F.col(text))).drop("_seqspark_host", "_seqspark_lines", "_seqspark_kept")
