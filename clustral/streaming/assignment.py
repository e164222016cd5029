"""Assignment of a stream of points to a fixed codebook, and a codebook that follows the stream batch by batch."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from ..operators.relational import assign
from ..plans.engine import Spark


def assign_stream(points: DataFrame, codebook: DataFrame) -> DataFrame:
    """Each arriving point (id, v, freq) with its cid and d2; stateless, so any output mode and restart will do."""
    return assign(points, codebook)


def following(codebook: np.ndarray, counts: np.ndarray, keep: Callable[[int, np.ndarray, np.ndarray], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: after each batch the centroids become the means of all points so far, handed to keep(epoch,
    codebook, counts), which should store them with the epoch so that a repeated batch can be told."""
    state = {"c": codebook.astype(np.int64), "n": counts.astype(object)}

    def update(batch: DataFrame, epoch: int) -> None:
        points = Spark(batch)
        if points.size:
            s = points.statistics(state["c"])
            for k in range(len(state["c"])):
                n = int(state["n"][k]) + int(s.n[k])
                if s.n[k]:
                    state["c"][k] = [(2 * (int(state["n"][k]) * int(a) + int(b)) + n) // (2 * n) for a, b in zip(state["c"][k], s.sums[k], strict=True)]
                state["n"][k] = n
        keep(epoch, state["c"].copy(), state["n"].copy())

    return update
