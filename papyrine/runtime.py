"""Session helpers: shared storage, shipping the package to workers, Arrow maps."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()
_stashes: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session without that setting (tests in local mode) gets a temporary
    folder of this machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="papyrine-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Make this package importable on the workers; only those of a local master share the driver's path."""
    home = str(_ROOT.parent)
    places = {os.path.realpath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p}
    app = spark.sparkContext.applicationId
    if spark.sparkContext.master.startswith("local[") and os.path.realpath(home) in places or app in _shipped:
        return
    target = Path(tempfile.mkdtemp(prefix="papyrine-")) / f"{_ROOT.name}.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in _ROOT.rglob("*.py"):
            archive.write(source, source.relative_to(_ROOT.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores if its scan has fewer partitions than there are cores.

    A small file is one row group and so one task, however costly what follows is;
    a large table has more partitions than cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of it.

    Cuts the lineage: what follows survives lost executors without recomputing
    what went before.  The table is removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _stashes[path] = spark
    made = spark.read.schema(df.schema).parquet(path)
    made._stashed_at = path
    return made


def scratch(spark: SparkSession, name: str) -> str:
    """Path of a new folder in the shared folder, for files that tasks write; removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _stashes[path] = spark
    return path


def drop(*stashed: DataFrame) -> None:
    """Remove stashed tables that nothing will read again."""
    for df in stashed:
        path = getattr(df, "_stashed_at", None)
        if path in _stashes:
            _delete(_stashes.pop(path), path)


def collect_shuffles(spark: SparkSession) -> None:
    """Have the shuffle files of finished jobs removed; Spark does so only once the driver has collected its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _sweep() -> None:
    for path, spark in _stashes.items():
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  this session is gone, another may live
            continue


#: Bytes of an Arrow batch sent to Python, where the session has Spark's own default.
_BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def _small_batches(spark: SparkSession) -> None:
    if not spark.sparkContext.getConf().contains(_BATCH_KEY):
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


def prepare(spark: SparkSession) -> None:
    """What every Arrow map needs: the package on the workers, and batches of bounded bytes."""
    ship(spark)
    _small_batches(spark)


def _give_back() -> None:
    """Return freed memory to the system, since Spark keeps the worker for later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def arrow_map(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None]],
    schema: T.StructType | str,
) -> DataFrame:
    """``mapInArrow`` where ``make()`` builds one batch function for each task."""
    prepare(df.sparkSession)
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        try:
            for batch in batches:
                out = step(batch)
                if out is not None and out.num_rows:
                    yield from pa.Table.from_batches([out] if isinstance(out, pa.RecordBatch) else out.to_batches()).cast(arrow).to_batches()
        finally:
            del step
            _give_back()

    return df.mapInArrow(run, schema)


def batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
