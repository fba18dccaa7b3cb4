"""Session helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ledgerlark")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Wide projections compile to methods the JIT refuses above 8000 bytecodes; past that
        # size Spark's per-operator path, which splits expressions, is the faster one.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        # Capturing a call site per Column call doubles the time to build a plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def bounded_methods(spark: SparkSession) -> None:
    """Keep the generated code of wide projections within what the JIT compiles.

    Spark's own limit lets methods through that the JVM then interprets row by row.  A session that names a limit keeps it.
    """
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    A local session (tests) that names none gets a new temporary folder, remembered
    in the session so later callers share it; a cluster without one is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", "")
    if not configured:
        configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not configured:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="ledgerlark-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured
