"""A search and training-data engine on Spark DataFrames."""

from __future__ import annotations

import os
import shutil
import tempfile

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark) -> None:
    """Gives this package to the session's Python workers, unless PYTHONPATH already does or it was given before."""
    context = spark.sparkContext
    if getattr(context, "_glintdex", False) or _ROOT in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    folder = tempfile.mkdtemp()
    context.addPyFile(shutil.make_archive(os.path.join(folder, "glintdex"), "zip", _ROOT, "glintdex"))
    context._glintdex = True
