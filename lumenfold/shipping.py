"""Code for the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package, and modules beside it, to the executors, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    top = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="lumenfold-code-")) / "lumenfold_code.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in [*top.rglob("*.py"), *top.parent.glob("corpus_pipeline.py")]:
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(path))
    _sent.add(sc.applicationId)
