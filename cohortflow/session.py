"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "cohortflow", extra: dict | None = None) -> SparkSession:
    """Session for tests and the bench; clusters pass their own settings."""
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.driver.memory", "16g"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, taken from the session.

    On a cluster ``spark.checkpoint.dir`` must name a shared folder. Only a
    local-mode session (tests, bench) without that setting gets a fresh
    folder of its own under /tmp.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cohortflow-ckpt-", dir="/tmp"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    return sc.getCheckpointDir()


def tables_folder(spark: SparkSession) -> str:
    """The folder, below the shared checkpoint folder, of the tables this application writes."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables-{spark.sparkContext.applicationId}"


def clear_tables(spark: SparkSession) -> None:
    """Remove the tables this application has written; frames that still read them can no longer be used."""
    path = spark._jvm.org.apache.hadoop.fs.Path(tables_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _HELD.clear()


def input_state(spark: SparkSession, paths: list[str]) -> tuple:
    """Name, size and time of change of the files below ``paths``: equal as long as the input is the same."""
    seen = []
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
        while files.hasNext():
            f = files.next()
            seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(seen))


_HELD: dict[tuple, str] = {}


def held_table(spark: SparkSession, name: str, paths: list[str], make) -> DataFrame:
    """The table ``make()`` gives, written once per application and state of the input files."""
    key = (spark.sparkContext.applicationId, name, input_state(spark, paths))
    if key not in _HELD:
        path = f"{tables_folder(spark)}/{name}-{uuid.uuid4().hex}"
        make().write.parquet(path)
        _HELD[key] = path
    return spark.read.parquet(_HELD[key])


def write_once(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it again.

    Everything that reads the result sees the same rows, however often and by
    whatever plan, and a lost executor costs a re-read. ``clear_tables`` removes what was written.
    """
    spark = df.sparkSession
    path = f"{tables_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession | None = None) -> None:
    """Make this package importable in Python workers (once per application).

    Pandas UDFs and ``mapInPandas`` functions defined here are pickled by
    reference, so executors must be able to import ``cohortflow``; the
    package is zipped on the driver and distributed with ``addPyFile``.
    """
    import os
    import shutil

    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="cohortflow-code-")
    archive = shutil.make_archive(os.path.join(out, "cohortflow"), "zip",
                                  root_dir=os.path.dirname(pkg_dir), base_dir="cohortflow")
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)
