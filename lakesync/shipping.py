"""Python workers must be able to import this package."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()
ROOT = Path(__file__).resolve().parent.parent


def put_on_path() -> None:
    """Let workers that are started from here find the package; takes effect if the session is made later."""
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if str(ROOT) not in paths:
        os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), *filter(None, paths)])


def ship(spark: SparkSession) -> None:
    """Send the package to the executors of a session, once, unless the path was set before it started."""
    context = spark.sparkContext
    if context.applicationId in _sent or str(ROOT) in (context._jvm.System.getenv("PYTHONPATH") or "").split(os.pathsep):
        return
    _sent.add(context.applicationId)
    folder = tempfile.mkdtemp(prefix="lakesync-")  # the driver serves it from here to every executor, later ones too
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "lakesync.zip")
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted((ROOT / "lakesync").rglob("*.py")):
            z.write(file, file.relative_to(ROOT))
    context.addPyFile(path)
