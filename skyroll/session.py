"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on. AQE re-plans shuffles at run time (partition
# coalescing for the small aggregate stages, skew splitting for joins), and
# the session time zone is pinned so date parts never depend on the host.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(master: str | None = None, app_name: str = "skyroll",
                  shuffle_partitions: int | None = None,
                  split_bytes: str | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Create (or reuse) a session with the engine defaults applied.

    On a cluster leave ``master`` unset so spark-submit decides. The heavy
    stage is the raw scan; its task count is input bytes / ``split_bytes``
    (``spark.sql.files.maxPartitionBytes``, default 128m). For tens of TB of
    raw CSV use 512m-1g: every task still emits only a few hundred partial
    aggregate rows, and fewer tasks mean fewer shuffle blocks and map
    statuses on the driver. ``shuffle_partitions`` can stay modest: the
    aggregate stages after the scan are tiny and AQE coalesces them.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if split_bytes:
        conf["spark.sql.files.maxPartitionBytes"] = split_bytes
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    # getOrCreate may hand back a running session; runtime SQL conf still
    # applies, so pin the settings the results depend on.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``; that setting is read
    from the session. Only a local-mode session without it (tests) gets a
    private temporary folder; a cluster session without it is an error,
    since a machine-local folder would not survive executor loss.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master or ""
        if not master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a shared folder "
                "(HDFS/object store) visible to every executor")
        root = tempfile.mkdtemp(prefix="skyroll-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def checkpointed(df):
    """Materialise a small result reliably and cut its lineage.

    ``checkpoint()`` writes the rows to the shared checkpoint folder, so
    every later use reads those files instead of re-running the plan, and a
    lost executor does not send anyone back to the source scan. Use it only
    for results whose size is bounded by the number of groups (e.g. the
    grain table), never for fact-sized data.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)
