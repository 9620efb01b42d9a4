"""Session helpers: shared checkpoint folder, lineage cuts, one row a key."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir. Where none is set a local master (tests) gets its own
    folder; on a cluster that is an error, as other machines can't read this machine's folders."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="vellumq-cp-"))


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once a context, so that Python stages find it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_vellumq_shipped", False):
        return
    sc._vellumq_shipped = True
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="vellumq-")) / "vellumq.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent).as_posix())
    sc.addPyFile(str(path))


def saved(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table below the shared checkpoint folder: the plan is computed once, its lineage ends, lost
    executors don't matter, and later reads take only the columns they need. Removed by `dropped`, at the end of a
    `scratch` block, or when the driver ends."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables[path] = df.sparkSession
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._vellumq_path = path
    return out


cut = saved
_tables: dict[str, SparkSession] = {}
_kept: dict[str, SparkSession] = {}


def kept(df: DataFrame) -> DataFrame:
    """Exempts a saved table from the removal at the end of a `scratch` block; it stays until the driver ends."""
    path = getattr(df, "_vellumq_path", "")
    if path in _tables:
        _kept[path] = _tables.pop(path)
    return df


def still_there(df: DataFrame) -> bool:
    """Whether the table of a frame that `saved` returned can still be read by the running context."""
    spark = SparkSession.getActiveSession()
    if spark is None or df.sparkSession.sparkContext is not spark.sparkContext:
        return False
    at = spark._jvm.org.apache.hadoop.fs.Path(getattr(df, "_vellumq_path", "/"))
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def modified(spark: SparkSession, path: str) -> int:
    """When a file or folder was last written, 0 if that can't be told."""
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).getModificationTime()
    except Exception:
        return 0


def _remove(path: str) -> None:
    spark = _tables.pop(path, None) or _kept.pop(path, None)
    if spark is not None:
        with contextlib.suppress(Exception):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def dropped(df: DataFrame) -> None:
    """Removes the table of a frame that `saved` returned; nothing may read it afterwards."""
    _remove(getattr(df, "_vellumq_path", ""))


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Removes at its end the tables saved within, so that they don't pile up on the shared folder of a long-lived
    driver. Results must be written within the block."""
    before = set(_tables)
    try:
        yield
    finally:
        for path in set(_tables) - before:
            _remove(path)


@atexit.register
def _remove_all() -> None:
    for path in [*_tables, *_kept]:
        _remove(path)


def one_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the one that is largest by `order` (nulls lose), ties by a hash of the other columns; rows
    with a null key are kept out."""
    rest = [c for c in df.columns if c not in keys]
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    best = F.max_by(F.struct(*rest), F.struct(*[F.col(c) for c in order], F.xxhash64(*rest))).alias("__b")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("__b")[c].alias(c) for c in rest])
