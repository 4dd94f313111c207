"""Adding up tables of fixed size, one from each task."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

FAN = 8  # tables that meet at a time


def fold(tables: DataFrame, kind: type, add: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The tables of a binary column combined in a tree. With more tasks the tree gets deeper, so that about FAN
    tables at most reach the driver. None without any."""
    rows = tables.rdd.map(lambda r: np.frombuffer(r[0], kind))

    def join(left: np.ndarray | None, right: np.ndarray | None) -> np.ndarray | None:
        return right if left is None else left if right is None else add(left, right)

    depth = max(2, math.ceil(math.log(max(2, rows.getNumPartitions()), FAN)))
    return rows.treeAggregate(None, join, join, depth)
