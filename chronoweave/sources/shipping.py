"""Making the package known to the executors."""

from __future__ import annotations

import zipfile
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Send the package's source to all executors, once per context, so that their Python workers can import it wherever
    they were started. The archive lies in the folder that Spark keeps for such files and serves it from there."""
    context = spark.sparkContext
    if getattr(context, "_chronoweave_sent", False):
        return
    folder = Path(SparkFiles.getRootDirectory(), "chronoweave-source")
    folder.mkdir(exist_ok=True)
    archive = folder / "chronoweave.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(_PACKAGE.rglob("*.py")):
            out.write(path, path.relative_to(_PACKAGE.parent))
    context.addPyFile(str(archive))
    context._chronoweave_sent = True
