"""Session helpers: reading tables, the shared work folder, written intermediate tables, shipping code."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_OWN_FOLDER: dict[str, str] = {}
_SWEPT: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One parquet table, pruned to ``columns`` where given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows of a scan with fewer splits than half the cores, hashed over all cores: a single small file would else keep
    one core busy with all its texts. A scan with enough splits, as every large one has, is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df._jdf.queryExecution().toRdd().getNumPartitions() * 2 <= cores else df


def workdir(spark: SparkSession) -> str:
    """The folder that every executor can reach. The session's spark.checkpoint.dir names it; only where that is
    unset on one machine (tests) a folder of our own is made and set. On a cluster an unset folder is an error."""
    app = spark.sparkContext.applicationId
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _OWN_FOLDER:
        _OWN_FOLDER[app] = tempfile.mkdtemp(prefix="skein-")
        spark.sparkContext.setCheckpointDir(_OWN_FOLDER[app])
        atexit.register(shutil.rmtree, _OWN_FOLDER[app], True)
    return _OWN_FOLDER[app]


def tables(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{workdir(spark)}/skein/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stash(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage, survives executor loss and
    lets several readers prune columns. The schema is kept, so nothing is inferred. The table stays until ``release`` or
    ``sweep``, and at most until the program ends where the folder is a plain one."""
    spark = df.sparkSession
    folder = tables(spark)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    local = folder.removeprefix("file://").removeprefix("file:")
    if "://" not in local and local not in _SWEPT:
        _SWEPT.add(local)
        atexit.register(shutil.rmtree, local, True)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash = path
    return out


def release(*stashed: DataFrame | None) -> None:
    """Delete stashed tables that nothing reads any more, as the rounds of an iteration once the next one is written."""
    for df in stashed:
        path = getattr(df, "_stash", None)
        if path:
            _delete(df.sparkSession, path)


def sweep(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; frames that read them can't be used any more."""
    _delete(spark, tables(spark))


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers on other machines. Once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    folder = workdir(spark)
    local = folder.removeprefix("file://").removeprefix("file:")
    if "://" in local:  # a remote store: the workers get the code from their own PYTHONPATH
        _SHIPPED.add(app)
        return
    os.makedirs(f"{local}/skein", exist_ok=True)
    target = f"{local}/skein/code-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(home):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.join("skein", os.path.relpath(full, home)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
