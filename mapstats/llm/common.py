"""What the text operators share: reading, shipping code to executors, cutting lineage."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: Documents in an Arrow batch, unless the session asks for another number than Spark's default.
BATCH = 2000

_shipped: set[str] = set()
_kept: dict[str, Callable[[], None]] = {}  # folders of the tables that are still there, and what removes each


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, wherever the driver found it. Batches of
    texts are made smaller where the session leaves their size at Spark's default."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(setting) == "10000":
        spark.conf.set(setting, str(BATCH))
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    with tempfile.TemporaryDirectory() as tmp:
        target = os.path.join(tmp, f"mapstats-{uuid.uuid4().hex}.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(here):
                for n in sorted(names):
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.join("mapstats", os.path.relpath(full, here)))
        keep = os.path.join(tempfile.gettempdir(), os.path.basename(target))
        os.replace(target, keep)
    sc.addPyFile(keep)
    atexit.register(lambda: os.path.exists(keep) and os.remove(keep))
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a local one only where none is named."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all its machines share")
        found = tempfile.mkdtemp(prefix="mapstats-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Cut lineage: write to the shared folder as Parquet and read again. The files go when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/mapstats-{uuid.uuid4().hex}"
    df.write.parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # shuffle files of what is now written go with their last reference
    _kept[path] = functools.partial(discard, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._mapstats_path = path
    return out


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder that written() made, if the session still lives."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session or its gateway has ended
        return


def tables() -> set[str]:
    """Folders of the tables that written() and bucketed() made and that are still there."""
    return set(_kept)


def release(paths: Iterable[str]) -> None:
    """Remove tables whose last reader has been written; the others go when the driver ends."""
    for p in paths:
        gone = _kept.pop(p, None)
        if gone is not None:
            gone()


atexit.register(lambda: release(list(_kept)))


def buckets(spark: SparkSession) -> int:
    """How many buckets a table gets: the session's shuffle partitions, so that joins keep them."""
    return min(100_000, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bucketed(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """Write to the shared folder as a table of n buckets by keys; joins on them read it without a shuffle."""
    spark = df.sparkSession
    name = f"mapstats_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.write.format("parquet").option("path", path).bucketBy(n, *keys).saveAsTable(name)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _kept[path] = functools.partial(_drop, spark, name, path)
    return spark.table(name)


def _drop(spark: SparkSession, name: str, path: str) -> None:
    discard(spark, path)
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # the session or its gateway has ended
        return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def masked(docs: DataFrame, *used: str):
    """docs with every column but those used under a name that clashes with none of an operator's own,
    and a function that selects and names its columns as they were."""
    names = docs.columns
    short = [c if c in used else f"column{k}" for k, c in enumerate(names)]
    return docs.toDF(*short), lambda df: df.select(*short).toDF(*names)


def tidy(f):
    """A function of batches that, at its end, gives memory it no longer uses back to the system; workers
    are kept between tasks."""

    @functools.wraps(f)
    def run(*args, **kwargs):
        yield from f(*args, **kwargs)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not a glibc
            ctypes.CDLL(None).malloc_trim(0)

    return run


def sliced(batches, rows: int):
    """The same record batches in slices of so many rows, so that what is made of one stays small."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(at, rows)
