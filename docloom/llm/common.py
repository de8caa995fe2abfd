"""What the operators share: table access, scratch tables in the shared folder, text kernels."""

from __future__ import annotations

import atexit
import ctypes
import gc
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from docloom.shipping import ship

#: Lower-cases A-Z only, as the contracts ask.
ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- scratch tables


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    One of our own is made only where none is named and all tasks run on this machine; on a cluster
    that names none this is an error, for executors would each write to a disk of their own.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_before.isDefined():
        return set_before.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="docloom-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


_owner: ContextVar[Scratch | None] = ContextVar("scratch owner", default=None)


class Scratch:
    """Owns the scratch tables made inside its `with` block, by this thread; at the block's end it deletes all but those kept, which pass to the owner outside.

    Tables made outside any block live until the process ends, for a lazy result may still come from
    them. A result that leaves a block must come from kept tables only.
    """

    def __init__(self) -> None:
        self.made: list[tuple[SparkSession, str]] = []
        self.kept: set[str] = set()

    def __enter__(self) -> Scratch:
        self._outer = _owner.get()
        self._token = _owner.set(self)
        return self

    def __exit__(self, *_) -> None:
        _owner.reset(self._token)
        stay = [x for x in self.made if x[1] in self.kept]
        (self._outer or _forever).made.extend(stay)
        self.made = [x for x in self.made if x[1] not in self.kept]
        sessions = {id(s): s for s, _ in self.made}.values()
        self.release()
        for spark in sessions:
            collect_driver(spark)

    def keep(self, *tables: DataFrame | str) -> None:
        """Tables that `save` gave, or paths of `scratch_path`."""
        self.kept.update(t if isinstance(t, str) else t._scratch_path for t in tables)

    def release(self) -> None:
        for spark, path in self.made:
            try:
                drop_scratch(spark, path)
            except Exception:  # the session has ended; the shared folder's owner removes the rest
                break
        self.made = []


def collect_driver(spark: SparkSession) -> None:
    """Let go, on the driver, of the plans, broadcasts and task results of jobs that are over.

    A stage of many short jobs makes garbage faster than the driver's heap is collected as a whole, which
    would grow to its limit; and Spark drops broadcasts and shuffles only when what named them is collected.
    """
    gc.collect()
    try:
        spark.sparkContext._jvm.System.gc()
    except Exception:  # the session has ended
        pass


def drop_scratch(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_fs(spark, path)
    fs.delete(p, True)


_forever = Scratch()
atexit.register(_forever.release)


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/docloom/{name}-{uuid.uuid4().hex[:12]}"
    (_owner.get() or _forever).made.append((spark, path))
    return path


_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Bytes of a row group of large rows: a task holds one while it writes, and what one unpacks to while it reads.
ROW_GROUP = 8 << 20


def save(df: DataFrame, name: str = "t", path: str | None = None, rows_of: int = 0) -> DataFrame:
    """Write df as a table in the shared folder and read it again: this cuts the lineage at a place that outlives executors.

    rows_of: the bytes that a row is made from. Parquet looks at what it holds after each hundred rows only,
    so for rows of megabytes it is told to look at every row, and to end row groups soon.

    The shuffle files of the writing go with its end, where Spark knows how (4.1): else they would
    stay on executors' disks until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        large = {"parquet.block.size": str(ROW_GROUP), "parquet.page.size.row.check.min": "1"} if rows_of >= 1 << 20 else {}
        df.write.options(compression="zstd", **large).parquet(path)
    finally:
        spark.conf.unset(_CLEAN_UP) if before is None else spark.conf.set(_CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def hadoop_fs(spark: SparkSession, path: str):
    """(file system, path) of the JVM for a path in any store."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def input_bytes(df: DataFrame) -> int:
    """The planner's estimate of df's size; for a scan, the size of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_for(df: DataFrame, bytes_each: int = 16 << 20) -> int:
    """A number of partitions that grows with the input, and is never below what the session shuffles into."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    size = input_bytes(df)
    return max(least, math.ceil(size / bytes_each)) if size < 1 << 60 else least


# ---------------------------------------------------------------- column names


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def actual(df: DataFrame, name: str) -> str:
    """How df spells the column that Spark takes for `name`, which has no regard to case."""
    return next((c for c in df.columns if c.lower() == name.lower()), name)


def without(df: DataFrame, *names: str) -> list[str]:
    """df's columns but those that Spark takes for one of the names."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def spare(df: DataFrame, stem: str) -> str:
    """A name like `stem` that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


# ---------------------------------------------------------------- Arrow helpers


def decoded(text: bytes | None) -> str:
    """A text as a string; null is empty, and bytes that are not UTF-8 are U+FFFD each time that a browser would show one."""
    return (text or b"").decode(errors="replace")


def text_rows(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def filter_rows(docs: DataFrame, keep: Callable[[list[bytes | None]], np.ndarray], text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose texts (as UTF-8 bytes, null as None) `keep` says yes to.

    The text is found by its place, so names that clash or differ in case do no harm.
    """
    ready(docs.sparkSession)
    at = docs.columns.index(actual(docs, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, at, 1 << 20):
            yield batch.filter(pa.array(np.asarray(keep(batch.column(at).cast(pa.binary()).to_pylist()), bool)))

    return map_rows(docs, run, docs.schema)


def map_rows(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """rows.mapInArrow(run, schema) for columns of any names, dots and repeats too: both sides go by place."""
    plain = StructType([StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema.fields)])

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, plain.names)

    return rows.toDF(*(f"c{i}" for i in range(len(rows.columns)))).mapInArrow(renamed, plain).toDF(*schema.names)


def small_batches(batches: Iterator[pa.RecordBatch], column: str | int = "text", limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts (a column's name or place) hold about `limit` bytes, one row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        at = column if isinstance(column, int) else batch.schema.get_field_index(column)
        sizes = np.array(pc.fill_null(pc.binary_length(batch.column(at)), 0), dtype=np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // limit)) + 1
        edges = [0, *cuts.tolist(), n]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b > a:
                yield batch.slice(a, b - a)
    give_back()


def give_back() -> None:
    """Return what a finished task freed to the system: its worker idles on beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library: nothing to ask
    _LIBC = None


#: Bytes of an Arrow batch between the JVM and a worker: texts differ in size, and Spark's ten thousand rows of long ones are held three times over by each task.
ARROW_BYTES = 2 << 20
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"


def ready(spark: SparkSession) -> None:
    """Ship the package to the executors, and bound the session's Arrow batches by bytes, unless they have a lower bound."""
    ship(spark)
    now = (spark.conf.get(_ARROW, None) or "").removesuffix("b")  # nothing where Spark does not know the setting
    if now and not (now.isdigit() and 0 < int(now) <= ARROW_BYTES):
        spark.conf.set(_ARROW, str(ARROW_BYTES))


def as_binary(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Only the id and the text's UTF-8 bytes; every other column is pruned from the scan."""
    ready(docs.sparkSession)
    return docs.select(quoted(id_column).cast("long").alias("doc_id"), quoted(text_column).cast("binary").alias("text"))
