"""Session helpers."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: Bytes of a batch that goes to a Python kernel, where the session has Spark's own setting: rows may be long texts.
BATCH_BYTES = 4 << 20
_BATCHES, _SPARKS_OWN = "spark.sql.execution.arrow.maxBytesPerBatch", ("67108864", "67108864b", "64MB", "64m")


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application, so that Python kernels import it there, and bound
    the batches that they get."""
    if spark.conf.get(_BATCHES, "64MB") in _SPARKS_OWN:
        spark.conf.set(_BATCHES, str(BATCH_BYTES))
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(), f"{here.name}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, a session of one machine (tests)
    takes a temporary folder; a cluster must set it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "tidemark-checkpoints")
    return found.rstrip("/")
