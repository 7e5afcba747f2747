"""Session helpers: a shared checkpoint folder and shipping of this package to executors."""

from __future__ import annotations

import gc
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..plans.shared import shared_folder

_ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()
_BATCH, _BATCH_DEFAULT, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", 8 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where it is unset, one machine gets a folder of its own and a cluster an error."""
    return shared_folder(spark)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` with a reliable checkpoint, so that lost executors cost no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let go of what finished jobs left.

    Their shuffle files can be as large as the texts, and Spark removes them
    only when the driver's garbage is collected, which it rarely needs.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors, unless PYTHONPATH already does that.

    Arrow batches are bounded to 8 MB, unless the session sets another size: a
    batch of long texts would otherwise take 64 MB several times over.
    """
    if spark.conf.get(_BATCH, None) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH, str(_BATCH_BYTES))
    sc = spark.sparkContext
    paths = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(_ROOT) in paths or sc.applicationId in _shipped:
        return
    out = Path(tempfile.mkdtemp(prefix="keelson-ship-")) / "keelson.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted((_ROOT / "keelson").rglob("*.py")):
            z.write(p, p.relative_to(_ROOT))
    sc.addPyFile(str(out))
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, read through Spark (any file system it knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
