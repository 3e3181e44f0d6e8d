"""Session settings the library relies on. All are ordinary Spark options."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    # Staging text carries UTC times.
    "spark.sql.session.timeZone": "UTC",
    # Run-time re-planning: splits skewed join partitions, coalesces small ones.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Only the partitions a write touches are replaced.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # A listing of many paths shares this many tasks; by default it takes a task a path, up to ten thousand.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
    # Landed files are small. At the default of 4 MB for opening one, a scan gets a task for every few of them, and what
    # the driver keeps of tasks and of the files they write grows with the number of landed files.
    "spark.sql.files.openCostInBytes": "256k",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python this package, once per application: functions that run there are imported by name.

    Not needed where the package is installed on every machine or given by ``--py-files``.
    """
    app, package = spark.sparkContext.applicationId, Path(__file__).parent
    if app in _SHIPPED or not package.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="orbitlake-package-")) / "orbitlake.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as files:
        for module in sorted(package.rglob("*.py")):
            files.write(module, module.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


def local_session(cpus: int | str = "*", name: str = "orbitlake", **options: str) -> SparkSession:
    """A single-machine session for tests and the bench; a cluster brings its own."""
    partitions = "8" if cpus == "*" else str(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.driver.memory", "12g")
    )
    for key, value in {**SETTINGS, **options}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
