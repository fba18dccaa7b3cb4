"""Streams end where the batch ends."""

import glob
import uuid

from conftest import SF
from pyspark.sql import functions as F

from ledgerlark.plans import queries_streaming
from ledgerlark.schemas import MATCHES
from ledgerlark.session import shared_dir
from ledgerlark.streaming import feeds

def test_late_rows_do_not_win(spark, tmp_path):
    src, base = f"{tmp_path}/in", f"{tmp_path}/table"
    batches = [[(1, "new", 9), (2, "b", 3)], [(1, "old", 4), (3, "c", 5)], [(2, "b2", 7)]]
    for rows in batches:
        df = spark.createDataFrame(rows, "match_id long, league string, d int")
        df = df.withColumn("sync_time", F.to_timestamp(F.concat(F.lit("2024-01-0"), "d")))
        df.drop("d").coalesce(1).write.mode("append").parquet(src)
        stream = feeds.read_feed(spark, src, df.drop("d").schema)
        table = feeds.VersionedTable(spark, base, MATCHES)
        feeds.upsert_matches_stream(stream, table, f"{tmp_path}/cp").awaitTermination()
    got = {r.match_id: r.league for r in table.current().collect()}
    assert got == {1: "new", 2: "b2", 3: "c"}


def test_reviews_expire_at_kickoff(spark, tmp_path):
    src = f"{tmp_path}/reviews"
    schema = "run_id long, status string, kickoff timestamp, event_at timestamp"
    def put(rows):
        df = spark.createDataFrame(rows, "run_id long, status string, k string, e string")
        df.select("run_id", "status", F.to_timestamp("k").alias("kickoff"), F.to_timestamp("e").alias("event_at")).coalesce(1).write.mode("append").parquet(src)
    put([(1, "pending", "2024-01-01 12:00:00", "2024-01-01 10:00:00"), (2, "pending", "2024-01-01 12:00:00", "2024-01-01 10:00:00")])
    name = "expired_" + uuid.uuid4().hex[:8]
    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        feeds.expire_reviews_stream(stream, "1 second").writeStream.format("parquet").outputMode("append").option(
            "checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/{name}").awaitTermination(90)
    run()
    put([(2, "resolved", "2024-01-01 12:00:00", "2024-01-01 11:00:00")])
    run()
    put([(9, "pending", "2024-02-01 12:00:00", "2024-01-01 13:00:00")])
    run()
    put([(8, "pending", "2024-02-01 12:00:00", "2024-01-01 14:00:00")])
    run()
    rows = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/{name}").collect()]
    assert rows == [(1, "expired")]


def test_feed_is_written_by_many_tasks_in_few_batches(spark):
    before = set(glob.glob(f"{shared_dir(spark)}/feed-*"))
    assert queries_streaming.streamed_match_feed(spark, SF).count() > 0
    (base,) = set(glob.glob(f"{shared_dir(spark)}/feed-*")) - before
    assert len(glob.glob(f"{base}/in/*.parquet")) > 3 and len(glob.glob(f"{base}/checkpoint/commits/[0-9]*")) == queries_streaming.BATCHES
