"""Steps of long jobs, written as tables so that a lost executor costs a reread."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import working_folder

PACKAGE = Path(__file__).resolve().parents[1]
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once for each application; jobs whose functions call others of it need that."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    made = tempfile.mkdtemp(prefix="millrace-")  # on the driver, whose file server hands it to all executors
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    path = f"{made}/{PACKAGE.name}-base.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(PACKAGE.parent))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def stored(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read back: what follows reads files."""
    path = working_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
