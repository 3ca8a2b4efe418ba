"""Tables in the folder that driver and executors share: stage boundaries, indexes kept for a session."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

ROWS_A_FILE = 500_000
_RUN = uuid.uuid4().hex[:12]
_made: set[str] = set()
_tables: list[str] = []
_kept: dict[tuple, DataFrame] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary one of this machine if the master is local, else an error: executors couldn't see it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = getattr(shared_dir, "own", None)
        if base is None:
            base = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="quillstack-")
    path = f"{base.rstrip('/')}/quillstack-{_RUN}"
    if path not in _made:
        _made.add(path)
        atexit.register(_remove, spark, path)
    return path


def _file(spark: SparkSession, path: str):
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path, jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone by then; the folder is only scratch space
        target, system = _file(spark, path)
        system.delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target, system = _file(spark, path)
    return system.exists(target)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or nothing where there is none."""
    target, system = _file(spark, path)
    if not system.exists(target):
        return None
    stream = system.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def swap_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file beside path and renames it over path: a reader finds the old one or the new one, whole."""
    target, system = _file(spark, path)
    beside = target.suffix(f".{uuid.uuid4().hex[:8]}.tmp")
    out = system.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    gateway, fs = spark.sparkContext._gateway, spark.sparkContext._jvm.org.apache.hadoop.fs
    over = gateway.new_array(fs.Options.Rename, 1)
    over[0] = fs.Options.Rename.OVERWRITE
    fs.FileContext.getFileContext(system.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(beside, target, over)


def stored(df: DataFrame, tag: str, rows: int | None = None, narrow: bool = False, by: str | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage ends there, and a lost executor loses nothing.

    rows: about how many narrow rows there are at most; they are dealt to files by that, not one a partition.
    narrow: rows are small against what they were made of, but their number isn't known; they are dealt to two files a core.
    by: a column of few values; rows of each have a folder of their own, which a filter on it opens alone.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.repartition(max(8, -(-rows // ROWS_A_FILE)))
    elif narrow:
        df = df.repartition(max(8, 2 * spark.sparkContext.defaultParallelism))
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:8]}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    _tables.append(path)
    back = spark.read.schema(df.schema).parquet(path)
    return back.select(*df.columns) if by else back


@contextlib.contextmanager
def freed(spark: SparkSession) -> Iterator[list[str]]:
    """Tables stored inside the block are removed after it, but for the last one: for a caller that has stored its result there."""
    before = len(_tables)
    yield _tables
    for path in _tables[before:-1]:
        _remove(spark, path)
    del _tables[before:-1]


@contextlib.contextmanager
def kept() -> Iterator[None]:
    """Tables stored inside the block outlive any freed() around it."""
    before = len(_tables)
    yield
    del _tables[before:]


def version(spark: SparkSession, path: str) -> tuple[int, int]:
    """Size and time of change of a table's file or folder, so that what was derived from an older state isn't taken for the present one."""
    target, system = _file(spark, path)
    status = system.getFileStatus(target)
    return status.getLen(), status.getModificationTime()


def once(spark: SparkSession, name: str, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What build() makes of the table at path, stored when the session first asks for it: an index is made once and searched often. What build() has stored itself isn't stored again."""
    key = (spark.sparkContext.applicationId, name, path, version(spark, path))
    if key not in _kept:
        before = len(_tables)
        made = build()
        own = _tables[before:]
        _kept[key] = made if own and own[-1].rsplit("/", 1)[-1].startswith(f"{name}-") else stored(made, name)
        _tables.remove(own[-1] if _kept[key] is made else _tables[-1])  # outlives any freed() around it
    return _kept[key]
