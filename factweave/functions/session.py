"""Session helpers that any operator may use."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where that is unset, as in tests on one machine, a temporary folder takes its place."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not at:
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='factweave-')}")
        at = spark.sparkContext.getCheckpointDir()
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, computed once and written to the shared folder: lineage is cut, and later reads survive the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives executors this package once per application, so that their Python workers can import it wherever they run."""
    import pathlib
    import shutil

    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = pathlib.Path(__file__).resolve().parents[2]
        at = tempfile.mkdtemp(prefix="factweave-zip-")
        spark.sparkContext.addPyFile(shutil.make_archive(f"{at}/factweave", "zip", root, "factweave"))
        _shipped.add(app)
