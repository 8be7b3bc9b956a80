"""A pigeonhole index of anchors: what two like anchors must nearly agree on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anchors

#: The light places of an anchor, in two parts. Its heavy places are in the block.
PARTS = ((0, 2), (3, 4))
LETTERS = len(anchors.RESIDUES) + 1
#: Room for sums of rounded weights.
SLACK = 1e-9


def losses() -> np.ndarray:
    """[place, code, code]: what a place takes from the score 1 (codes as in anchors.codes: 0 is unknown)."""
    n = len(anchors.RESIDUES)
    score = np.zeros((len(anchors.WEIGHTS), LETTERS, LETTERS))
    for k, w in enumerate(anchors.WEIGHTS):
        score[k, 1:, 1:] = w / sum(anchors.WEIGHTS) * anchors.matrix()[:n, :n]
    return np.array(anchors.WEIGHTS)[:, None, None] / sum(anchors.WEIGHTS) - score


def near(threshold: float) -> list[np.ndarray]:
    """For each part, [key, key]: whether two keys lose at most half of what a score of threshold may lose.

    A pair that scores threshold loses 1 - threshold over all places at most, and no place gains. So one
    of both parts loses at most half of it.
    """
    loss, out = losses(), []
    for i, j in PARTS:
        both = loss[i][:, None, :, None] + loss[j][None, :, None, :]
        out.append((both <= (1 - threshold) / 2 + SLACK).reshape(LETTERS**2, LETTERS**2))
    return out


def key(codes: Column, part: int) -> Column:
    """An anchor's key in a part."""
    i, j = PARTS[part]
    return (F.get(codes, F.lit(i)) * LETTERS + F.get(codes, F.lit(j))).cast("int")


def table(spark: SparkSession, threshold: float) -> DataFrame:
    """part, key, other: keys near each other; as many rows as the alphabet allows, whatever the data."""
    rows = [(part, int(a), int(b)) for part, close in enumerate(near(threshold)) for a, b in zip(*np.nonzero(close), strict=True)]
    return spark.createDataFrame(rows, "part int, key int, other int")
