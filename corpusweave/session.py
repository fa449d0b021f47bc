"""Session helpers.

Library code never creates its own session: every operator takes the
caller's ``SparkSession``.  ``local_session`` is for tests and the bench.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # the embed batch of the reference is 300 texts; Arrow batches are the unit here
    "spark.sql.execution.arrow.maxRecordsPerBatch": "300",
    "spark.ui.enabled": "false",
    # checkpoint files of DataFrames that went out of scope are removed
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "corpusweave", extra: dict | None = None) -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "16g")
               # local runs only: a scratch checkpoint folder (clusters name a shared one)
               .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="corpusweave-ckpt-")))
    for k, v in {**DEFAULT_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per SparkContext (the
    same as ``--py-files``), so queries run from any working directory."""
    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="corpusweave-pyfiles-"), "corpusweave.zip")
    with zipfile.ZipFile(path, "w") as z:
        for root, _, files in os.walk(top):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    _SHIPPED.add(key)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting points at shared storage and is used as is; without
    it this raises, as executors could not see each other's files.  Only on a
    local master (tests, local runs) a scratch folder is made.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="corpusweave-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base.rstrip("/"), name)


def spread(df):
    """``df`` as a side of a join that no side of is broadcast. Spark takes a scan's size from its files or its cached columns;
    source text and ids are many times as large as rows, all of which a broadcast puts into the driver's memory."""
    return df.hint("merge")


def materialize(df, reliable: bool = True):
    """Compute ``df`` once so later plans read it instead of re-running it.

    Default: a reliable checkpoint in the shared checkpoint folder.  The
    result's plan is a leaf, which also keeps later planning cheap (a
    persisted DataFrame keeps its whole plan, and every later query pays to
    match it against the cache), and survives the loss of executors.
    ``reliable=False`` only persists (memory, spilling to disk)."""
    from pyspark import StorageLevel
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    if not reliable:
        cached.count()
        return cached
    ensure_checkpoint_dir(df.sparkSession)
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out
