"""A PySpark-native engine for extracted document structure."""

from __future__ import annotations

import os
from pathlib import Path


def ship(spark) -> None:
    """Lets Python workers import this package from where the driver has it, wherever the driver was started.

    A cluster has the package installed on its nodes; there the path is but one more that doesn't exist."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
