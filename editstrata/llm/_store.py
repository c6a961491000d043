"""Values sent to tasks, and tables written to the cluster's shared folder."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import kept, scratch, shared_dir, written

__all__ = ["fresh", "kept", "scratch", "sent", "shared_dir", "written"]


def sent(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """A function that gives `value` in tasks, broadcast with its class's code. Only for values of bounded size."""
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    cache: list[Any] = []

    def get() -> Any:
        if not cache:
            cache.append(pickle.loads(held.value))
        return cache[0]

    return get


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name.lower() in taken:
        name += "_"
    return name
