"""Session helpers shared by every subpackage: settings, package shipping, shared folder."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_LOCAL_DIRS: dict[str, str] = {}


def local_session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Bytes of an Arrow batch on its way to Python, where the session has Spark's default of 64 MB:
#: a task holds a few batches at once, outside the heap, and two chained operators twice as many.
_BATCH_BYTES, _DEFAULT_BYTES = "8m", ("67108864b", "64m", "64MB", "67108864")


def ship_package(spark: SparkSession) -> None:
    """Get ready for Python operators: small Arrow batches, and this package on the executors.

    The package is sent once per application, since executors may not have it installed.
    """
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(bound, None) in _DEFAULT_BYTES:
        spark.conf.set(bound, _BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(n for n in names if n.endswith((".py", ".toml"))):
                full = os.path.join(folder, name)
                archive.write(full, os.path.relpath(full, os.path.dirname(root)))
    path = os.path.join(tempfile.mkdtemp(prefix="tidemark-pkg-"), f"tidemark-{uuid.uuid4().hex[:8]}.zip")
    with open(path, "wb") as out:
        out.write(buffer.getvalue())
    spark.sparkContext.addPyFile(path)
    # stateful streaming operators also start a worker beside the driver, which added files don't reach
    environment = spark.sparkContext.environment
    environment["PYTHONPATH"] = os.pathsep.join(p for p in (os.path.dirname(root), environment.get("PYTHONPATH")) if p)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by ``spark.checkpoint.dir``.

    Only where that is unset (local tests) is a temporary folder of this machine used, and
    then only under a local master, where driver and executors are one process.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = sc.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="tidemark-shared-")
        sc.setCheckpointDir(_LOCAL_DIRS[app])
    return _LOCAL_DIRS[app]


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder (never an executor-local copy)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tables_dir(spark: SparkSession) -> str:
    """Where this application's intermediate tables are."""
    return f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"


def clean_up(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; results that were not written are lost."""
    drop_written(spark, tables_dir(spark))


def written(df: DataFrame, name: str, reader: SparkSession | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, in the session ``reader`` if it is not to be its own.

    For tables too wide for ``checkpoint``; columnar and compressed, survives lost executors.
    """
    spark = df.sparkSession
    path = f"{tables_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return (reader or spark).read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system layer, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
