"""Session and table helpers shared by every plan."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app: str = "tidemark", cpus: int | str = "*", partitions: int | None = None) -> SparkSession:
    """A session with the settings the plans assume: UTC, AQE, Arrow."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a local session, whose executors are this process, may go without a configured one."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="tidemark_ckpt_")
        spark.conf.set("spark.checkpoint.dir", d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: survives the loss of executors, and is computed once."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: one computation, columnar reads afterwards."""
    path = os.path.join(shared_dir(df.sparkSession), f"{label}_{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the Python workers this package, whatever their path holds; once per application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="tidemark_")) / "tidemark.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(target))
        _SHIPPED.add(app)


def is_small(df: DataFrame, most_bytes: int = 16_000_000) -> bool:
    """Whether df (computed already: a checkpoint or a staged table) holds `most_bytes` at the most, as text."""
    size = F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
    return (df.agg(size).first()[0] or 0) <= most_bytes


def checked_broadcast(df: DataFrame, most_bytes: int = 16_000_000) -> DataFrame:
    """df computed once and, if it has `most_bytes` at the most, marked for broadcast; beyond that the join is shuffled. Rows are the same either way."""
    df = cut_lineage(df)
    return F.broadcast(df) if is_small(df, most_bytes) else df
