"""Send this package to the executors, whose Python may not have it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
_SENT: set[str] = set()


def to_executors(spark: SparkSession, *more: str) -> None:
    """Once for each application: the package and ``more`` modules beside it, as a zip that Spark distributes."""
    sc = spark.sparkContext
    if sc.applicationId in _SENT:
        return
    path = Path(tempfile.mkdtemp(prefix="tidewright-code-")) / "tidewright_code.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted((ROOT / "tidewright").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
        for name in more:
            if (ROOT / name).exists():
                z.write(ROOT / name, name)
    sc.addPyFile(str(path))
    _SENT.add(sc.applicationId)
