"""What the operators of this subpackage share: inputs, scratch tables, text blocks."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parents[1]
#: Spark then deletes the shuffle files of a job's plan as soon as the job has ended
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"
_MADE: list[tuple[SparkSession, str]] = []
_SHIPPED: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Ship this package to the Python workers, once for each application.

    Where the session sets no size for Arrow batches they get ARROW_BYTES: a batch
    is held several times at once, by either side and for every core, and the
    default of 64 MB of long texts would fill an executor.
    """
    if spark.conf.get(ARROW, None) is None:
        spark.conf.set(ARROW, ARROW_BYTES)
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    made = tempfile.mkdtemp(prefix="millrace-")  # on the driver, whose file server hands it to all executors
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    path = f"{made}/{PACKAGE.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(PACKAGE.parent))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share.

    Only a local session without that setting (tests) gets a local folder; on a
    cluster its absence is an error, as other machines could not read such a folder.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.conf.set("spark.checkpoint.dir", top)
    path = f"{top.rstrip('/')}/millrace/{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(_sweep)
    _MADE.append((spark, path))
    return path


def drop_dir(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def _sweep() -> None:
    """Delete what is left at the end; a folder whose session has ended stays, the others still go."""
    for spark, path in _MADE:
        try:
            drop_dir(spark, path)
        except Exception:  # noqa: BLE001
            continue


def stored(df: DataFrame) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: what follows reads files, so a lost executor costs
    a reread and not the work before.  The shuffle files of the write go with it.
    """
    spark = df.sparkSession
    path = scratch_dir(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def meet(many: DataFrame, one: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join rows to a table with one row for each key, where any key may have very many rows.

    `one` is stored first.  Then both sides of the merge join are plain shuffles,
    whose large partitions adaptive execution may split; it cannot where a side
    comes straight from an aggregation.
    """
    return many.join(stored(one).hint("merge"), on, how)


def release(spark: SparkSession, *finished: DataFrame) -> None:
    """Delete tables that stored() wrote and nothing needs any more."""
    for df in finished:
        for path in {os.path.dirname(f) for f in df.inputFiles()}:
            drop_dir(spark, path)


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on `key` and `seed` only: 32 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function for mapInArrow, whose worker gives its free memory back when a partition ends.

    Idle workers wait beside the executor's JVM for later stages; what they hold on to is missing there.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def blocks(batches: Iterator[pa.RecordBatch], max_bytes: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about `max_bytes` of text; a longer single text stays whole."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if held and held + n > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)
