"""Session helpers shared by queries, tests and the benchmark."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tallyloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")  # small tables, all cores
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoint() at the shared folder named in spark.checkpoint.dir.

    Only a local master may lack that setting: it gets a temporary folder. On a
    cluster such a folder would be another one on every machine, and whoever
    reads it would miss rows without notice, so there the setting is required.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not shared and not is_local(context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tallyloom-checkpoint-"))


def is_local(master: str) -> bool:
    """Whether driver and executors are one process, hence share its disk ('local-cluster' is not)."""
    return master == "local" or master.startswith("local[")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, once per application.

    Spark serves the archive from the driver to every executor, also to those
    that join later.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, str(Path(root.name) / path.relative_to(root)))
    folder = tempfile.mkdtemp(prefix="tallyloom-")
    target = Path(folder, f"{root.name}.zip")
    target.write_bytes(data.getvalue())
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)


def materialise(df: DataFrame) -> DataFrame:
    """The rows of df as a table written once to the shared checkpoint folder.

    What is read later no longer depends on any executor, and the columns can be
    pruned by each reader. The folder goes when the session's JVM ends.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


_STORED: dict[tuple, DataFrame] = {}


def _state_of(spark: SparkSession, path: str) -> tuple:
    """Sizes and times of the files at a path: what a table derived from them depends on."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(hadoop)))


#: Part of the name of a kept table; to be raised when what is stored changes.
STORE_VERSION = 1


def stored(spark: SparkSession, sf_dir: str, name: str, sources: Sequence[str], build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table - a cleaned table, an index - written once and read by all later queries.

    It is built anew when one of its source tables has changed. Filters on what
    is read reach its files, which `build` should leave sorted by what is
    searched. It lies in the shared checkpoint folder as long as the application,
    or, if `spark.tallyloom.store` names a folder, there for later ones as well.
    """
    state = tuple(_state_of(spark, f"{sf_dir}/{s}.parquet") for s in sources)
    key = (spark.sparkContext.applicationId, sf_dir, name, state)
    if key not in _STORED:
        for old in [k for k in _STORED if k[:3] == key[:3] or k[0] != key[0]]:
            del _STORED[old]
        root = spark.conf.get("spark.tallyloom.store", None)
        _STORED[key] = _kept(spark, root, (STORE_VERSION, *key[1:]), build) if root else materialise(build())
    return _STORED[key]


def _kept(spark: SparkSession, root: str, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """The table of a key in a folder that outlives the application; one that was not written to its end is written again."""
    path = f"{root}/{key[2]}-{hashlib.sha256(repr(key).encode()).hexdigest()[:24]}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables; columns are pruned by whatever is selected."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
