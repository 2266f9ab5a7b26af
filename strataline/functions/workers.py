"""Python workers find this package even if only the driver's sys.path names it."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps

from pyspark.sql import SparkSession


def with_package(query: Callable) -> Callable:
    """query, whose workers also look for modules where this package lies. On a cluster, ship the package with --py-files."""
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

    @wraps(query)
    def run(spark: SparkSession, *args):
        env = spark.sparkContext.environment
        paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
        if home not in paths:
            env["PYTHONPATH"] = os.pathsep.join([*paths, home])
        return query(spark, *args)

    return run
