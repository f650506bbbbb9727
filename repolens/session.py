"""Session helpers: building a session, shipping this package to executors, shared folders."""

from __future__ import annotations

import atexit
import logging
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "repolens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans here assume (AQE, UTC, Arrow transfer)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per session, so that Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_repolens_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="repolens-")
    target = os.path.join(folder, "repolens_src.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*")):
            if path.is_file() and path.suffix != ".pyc":
                archive.write(path, Path("repolens") / path.relative_to(root))
    context.addPyFile(target)
    context._repolens_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it (``spark.checkpoint.dir``).

    Where it is unset a session on one machine gets a local one; on a cluster that would scatter tables over the
    executors' own disks, so it is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = found.get() if found.isDefined() else None
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        folder = "file://" + tempfile.mkdtemp(prefix="repolens-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Tables that this process has written and not dropped, and the sessions that wrote them.
_written: dict[str, SparkSession] = {}


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that is dropped at the end of this process, if not before."""
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.unregister(drop_tables)
        atexit.register(drop_tables)
    _written[path] = spark
    return path


def drop_tables(*paths: str) -> None:
    """Delete these tables, or all that this process has written and not dropped yet."""
    for path in paths or list(_written):
        spark = _written.pop(path, None)
        try:
            if spark is not None and spark.sparkContext._jsc is not None:
                target = spark._jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception as failure:  # the session may be gone; what is left is in the shared folder alone
            logging.getLogger(__name__).debug("not dropped: %s (%s)", path, failure)


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write df to a table in the shared folder and read it back: cuts the lineage, survives lost executors.

    ``forget`` drops the table once nothing reads it any more; the others go at the end of the process.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    schema = df.schema
    df.write.mode("errorifexists").parquet(path)
    table = spark.read.schema(schema).parquet(path)
    table._repolens_path = path
    return table


def by_shuffle(df: DataFrame) -> DataFrame:
    """df, marked so that the join it takes part in is no broadcast.

    Spark judges a written table by its files. Paths, symbols and patterns compress so well, and exploded lists hold so much
    more than their file says, that it would send tables of many times its threshold through the driver.
    """
    return df.hint("merge")


#: Bytes of rows that broadcast_if_small sends to all executors at most.
BROADCAST_BYTES = 32 << 20


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast where its measured size allows it, and else against one; it should be cheap to read twice, as a written table is."""
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns), F.lit(0))
    n, chars = df.agg(F.count(F.lit(1)), F.sum(size)).first()
    return F.broadcast(df) if 40 * n + (chars or 0) <= BROADCAST_BYTES else by_shuffle(df)


def forget(*tables: DataFrame) -> None:
    """Drop tables of ``materialize`` that no plan reads any more."""
    for table in tables:
        if path := getattr(table, "_repolens_path", None):
            drop_tables(path)
