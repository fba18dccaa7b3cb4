"""Streaming queries: the stream's end state as a DataFrame."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..schemas import MATCHES
from ..session import shared_dir
from ..streaming import feeds
from . import adapters
from .oracle import with_ctes
from .registry import query

#: Micro-batches of the replay; the files of the feed grow in number with the input, the batches do not.
BATCHES = 3
_FEED = """SELECT l_orderkey AS match_id, CAST(l_linenumber AS {string}) AS league, l_shipdate AS sync_time, CAST(l_partkey AS {string}) AS match_no FROM {lineitem}"""


@query("streamed_match_feed", with_ctes(
    """SELECT match_id, max(sync_time) AS sync_time FROM feed GROUP BY 1""", f"feed AS ({adapters.plain(_FEED)})"))
def streamed_match_feed(spark, sf_dir):
    """The line items replayed as a fixture feed in several micro-batches."""
    base = f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}"
    rows = adapters.view(spark, sf_dir, _FEED)
    files = adapters.tasks_for(adapters.table(spark, sf_dir, "lineitem"))
    rows.repartition(files).write.parquet(f"{base}/in")
    stream = feeds.read_feed(spark, f"{base}/in", rows.schema, files_per_batch=-(-files // BATCHES))
    table = feeds.VersionedTable(spark, f"{base}/matches", MATCHES)
    stream = stream.withColumn("sync_time", F.col("sync_time").cast("timestamp"))
    feeds.upsert_matches_stream(stream, table, f"{base}/checkpoint").awaitTermination()
    return table.current().select("match_id", "sync_time")
