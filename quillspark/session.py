"""Sessions, shared folders and tables that cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import functools
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def local_session(cores: str = "*", app: str = "quillspark", shared: str | None = None) -> SparkSession:
    """A session for tests and benchmarks on one machine, with ``shared`` (or QUILL_SHARED_DIR, or a folder of its own
    that is deleted at the end) as spark.checkpoint.dir."""
    partitions = os.cpu_count() if cores == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(max(4, partitions or 4)))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUILL_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.checkpoint.dir", shared or os.environ.get("QUILL_SHARED_DIR") or _own_dir())
        .getOrCreate()
    )


def _own_dir() -> str:
    global _own
    if _own is None:
        _own = tempfile.mkdtemp(prefix="quillspark-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return _own


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir. A local session that hasn't set it gets a folder of
    its own, as there all executors are this machine; on a cluster the setting is required."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_dir()


#: Paths of written tables, of the scopes that are open and of those that results still read.
_scopes: list[list[str]] = []
_kept: list[str] = []


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: it survives the loss of any executor, and its
    lineage starts at the files. Use it where a frame is read more than once or a loop would grow its plan. The table
    is deleted when the scope it is made in ends, or with the session if the scope's result reads it."""
    spark = df.sparkSession
    path = folder(spark, name)
    with _shuffles_deleted(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quill_path = path
    return out


@contextlib.contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Have Spark delete the shuffle files of what is run inside when it ends. What is written is not computed again, so
    nothing needs them; otherwise they would hold disk until the driver happens to collect its garbage."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)


def folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the shared one, deleted like the tables of :func:`cut`."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (_scopes[-1] if _scopes else _kept).append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    for held in (*_scopes, _kept):
        if path in held:
            held.remove(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the files behind a frame made by :func:`cut` that nothing reads any more."""
    path = getattr(df, "_quill_path", None)
    if path:
        _delete(df.sparkSession, path)


def _read_by(df: DataFrame) -> str:
    """The folders of the files that a frame's plan reads, one per line."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    roots = []
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            paths = leaf.relation().location().rootPaths()
            roots += [str(paths.apply(n)) for n in range(paths.size())]
    return "\n".join(roots)


def scoped(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``build``, a function of a session and more that gives a frame: of the tables that it cuts, only those that its
    result reads outlive it, until :func:`clean` or the end of the program."""

    @functools.wraps(build)
    def run(spark: SparkSession, *args, **kwargs) -> DataFrame:
        _scopes.append([])
        read = ""
        try:
            out = build(spark, *args, **kwargs)
            read = _read_by(out)
        finally:
            outer = _scopes[-2] if len(_scopes) > 1 else _kept
            for path in list(_scopes[-1]):
                if path.rsplit("/", 1)[1] in read:
                    outer.append(path)
                else:
                    _delete(spark, path)
            _scopes.pop()
        return out

    return run


def clean(spark: SparkSession) -> None:
    """Delete every table that was cut and is still there. Frames that read them can't be evaluated afterwards."""
    for path in list(_kept):
        _delete(spark, path)


def _clean_at_exit() -> None:
    spark = SparkSession.getActiveSession() if _kept else None
    if spark is not None:
        try:
            clean(spark)
        except Exception:  # noqa: BLE001, S110 - the session may be gone
            pass


atexit.register(_clean_at_exit)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` for work that outweighs reading: if it comes from fewer files than there are cores, its rows are dealt to all
    of these first, as a file of one row group is read by a single task. Tables of more files stay as they are."""
    cores, files = df.sparkSession.sparkContext.defaultParallelism, len(df._jdf.inputFiles())
    return df.repartition(cores) if 0 < files < cores else df


def mapped(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow`` with this package at hand on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors, once per application, so that they need no installation of it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    here = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="quillspark-ship-")) / f"{here.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    context.addPyFile(str(archive))
