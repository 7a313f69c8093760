"""Session settings, and the shared folder that intermediate tables are written to."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FOLDERS: dict[str, str] = {}
_SHIPPED: set[str] = set()


def build_session(app: str = "samplelake", cores: str | int = "*", **conf) -> SparkSession:
    """A local session for tests and the bench; on a cluster the submitter sets these."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        **conf,
    }
    builder = SparkSession.builder.appName(app).master(f"local[{cores}]")
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application, for sessions that were not
    started with it on their path."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="samplelake-zip-")) / "samplelake"
        spark.sparkContext.addPyFile(shutil.make_archive(str(target), "zip", root, "samplelake"))
        _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary folder; on a cluster an unset
    value is an error, since executors could not read each other's local folders.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor reaches")
    app = context.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="samplelake-")
        atexit.register(shutil.rmtree, _LOCAL_FOLDERS[app], ignore_errors=True)
    return _LOCAL_FOLDERS[app]


def spread(df: DataFrame) -> DataFrame:
    """Spread a frame that has fewer partitions than the session has cores, such as one read
    from a single small or unsplittable file, before costly row-local work. Large inputs have
    more partitions than that and are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/samplelake/{spark.sparkContext.applicationId}"


def new_table_path(spark: SparkSession, label: str) -> str:
    return f"{_tables(spark)}/{label}-{uuid.uuid4().hex}"


def drop_tables(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application, once its results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there, an
    executor that is lost later costs no recomputation, and the plan behind runs once."""
    spark = df.sparkSession
    path = new_table_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
