"""Sessions: sensible settings for tests and benches, and the package on executors that do not have it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def local_session(cores: str | int = "*", partitions: int = 8, memory: str = "4g", name: str = "labelweave") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, unless their PYTHONPATH already names it."""
    if str(ROOT.parent) in os.environ.get("PYTHONPATH", "").split(":") or getattr(spark.sparkContext, "_labelweave_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="labelweave-")) / "labelweave.zip"
    with zipfile.ZipFile(path, "w") as out:
        for p in sorted(ROOT.rglob("*")):
            if p.is_file() and "__pycache__" not in p.parts:
                out.write(p, p.relative_to(ROOT.parent))
    spark.sparkContext.addPyFile(str(path))
    spark.sparkContext._labelweave_shipped = True
