"""Spark session defaults used by the tests, the bench and scripts."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", app: str = "dialoom", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session with the settings that the engine is tested with.

    On a cluster nothing here is needed: operators take whatever session they
    are given and read sizes, partitions and the checkpoint folder from it.
    """
    conf = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("DIALOOM_DRIVER_MEMORY", "8g"),
        "spark.checkpoint.dir": os.environ.get("DIALOOM_CHECKPOINT_DIR", "/tmp/checkpoints"),
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.driver.host": "127.0.0.1",
    } | extra
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    spark = builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for a context, where their Python would not find it.

    That is so when it is neither in PYTHONPATH nor in the working folder, and
    came into this process by another way. Spark serves the archive itself.
    """
    root = Path(__file__).resolve().parents[1]
    seen = {Path(p or ".").resolve() for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]}
    app = spark.sparkContext.applicationId
    if root in seen or app in _SHIPPED:
        return
    at = Path(tempfile.mkdtemp(), "dialoom_package.zip")
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted((root / "dialoom").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(at))
    _SHIPPED.add(app)
