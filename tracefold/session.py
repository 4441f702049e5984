"""Session factory: UTC, adaptive execution, Arrow, partitions sized from the cores."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Most local cores used by default.
CORE_QUOTA = 4


def worker_count(quota: int = CORE_QUOTA) -> int:
    """Cores to use: the quota, or fewer where the process is bound to fewer."""
    return max(1, min(quota, len(os.sched_getaffinity(0))))


def session(app: str = "tracefold", cores: int | None = None, **conf: str) -> SparkSession:
    n = cores or worker_count()
    builder = SparkSession.builder.master(f"local[{n}]").appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": str(2 * n),
        "spark.ui.enabled": "false",
        "spark.executorEnv.OMP_NUM_THREADS": "1",
    }
    for k, v in (defaults | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
