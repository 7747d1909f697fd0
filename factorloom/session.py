"""Session, the shared folder, and cutting of lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes up to which a table may be sent to every executor; checked against a count before use.
BROADCAST_BYTES = 64 << 20


def session(name: str = "factorloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution; sizes of partitions follow the data, not a fixed count."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.ui.enabled": "false",
    }
    for key, value in {**base, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where that is unset, one is made if all executors run on this machine (tests); anywhere else it is an error."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: intermediate tables need a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="factorloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Tables written by this process.
_written: set[str] = set()


def work_path(spark: SparkSession, hint: str) -> str:
    """A new path below the shared folder. It is deleted by ``forget``, or else with the end of the session's JVM."""
    path = f"{shared_dir(spark)}/{hint}-{uuid.uuid4().hex}"
    _written.add(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p)  # what doesn't exist can't be marked
    fs.deleteOnExit(p)
    return path


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes the given written tables, or all written so far. Results that still have to be read from them must have been taken before."""
    from .sources.store import Store

    store = Store(spark)
    gone = {t._factorloom_path for t in tables} if tables else set(_written)
    for path in gone:
        store.delete(path, recursive=True)
    _written.difference_update(gone)


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    df = spark.read.schema(schema).parquet(path)
    df._factorloom_path = path
    return df


def write_table(df: DataFrame, hint: str = "cut") -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = work_path(df.sparkSession, hint)
    df.write.mode("overwrite").parquet(path)
    return read_table(df.sparkSession, path, df.schema)


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python this package, once a session; they need no installed copy."""
    sc = spark.sparkContext
    if getattr(sc, "_factorloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="factorloom-code-")) / "factorloom.zip"  # read by the driver, which serves it
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"factorloom/{f.relative_to(root)}")
    sc.addPyFile(str(path))
    sc._factorloom_shipped = True
