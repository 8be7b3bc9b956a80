"""Anchors of sequences and their weighted similarity."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Residue letters and the public BLOSUM62 matrix in their order.
RESIDUES = "ARNDCQEGHILKMFPSTWYV"
BLOSUM62 = """
 4 -1 -2 -2  0 -1 -1  0 -2 -1 -1 -1 -1 -2 -1  1  0 -3 -2  0
-1  5  0 -2 -3  1  0 -2  0 -3 -2  2 -1 -3 -2 -1 -1 -3 -2 -3
-2  0  6  1 -3  0  0  0  1 -3 -3  0 -2 -3 -2  1  0 -4 -2 -3
-2 -2  1  6 -3  0  2 -1 -1 -3 -4 -1 -3 -3 -1  0 -1 -4 -3 -3
 0 -3 -3 -3  9 -3 -4 -3 -3 -1 -1 -3 -1 -2 -3 -1 -1 -2 -2 -1
-1  1  0  0 -3  5  2 -2  0 -3 -2  1  0 -3 -1  0 -1 -2 -1 -2
-1  0  0  2 -4  2  5 -2  0 -3 -3  1 -2 -3 -1  0 -1 -3 -2 -2
 0 -2  0 -1 -3 -2 -2  6 -2 -4 -4 -2 -3 -3 -2  0 -2 -2 -3 -3
-2  0  1 -1 -3  0  0 -2  8 -3 -3 -1 -2 -1 -2 -1 -2 -2  2 -3
-1 -3 -3 -3 -1 -3 -3 -4 -3  4  2 -3  1  0 -3 -2 -1 -3 -1  3
-1 -2 -3 -4 -1 -2 -3 -4 -3  2  4 -2  2  0 -3 -2 -1 -2 -1  1
-1  2  0 -1 -3  1  1 -2 -1 -3 -2  5 -1 -3 -1  0 -1 -3 -2 -2
-1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5  0 -2 -1 -1 -1 -1  1
-2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6 -4 -2 -2  1  3 -1
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7 -1 -1 -4 -3 -2
 1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4  1 -3 -2 -2
 0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5 -2 -2  0
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11  2 -3
-2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7 -1
 0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4
"""
# Groups of like residues, and the weights of an anchor's six places.
GROUPS = ["AST", "VILM", "FYW", "DE", "KR", "NQ", "G", "H", "C", "P"]
WEIGHTS = [1.0, 2.0, 1.0, 1.0, 1.0, 2.0]
#: The order in which places are added up: the heavy ones first.
ORDER = [1, 5, 0, 2, 3, 4]
FRONT = BACK = 3


def matrix() -> np.ndarray:
    """Similarity of residues in their order, normalised so that each has 1 with itself."""
    raw = np.array([[int(x) for x in line.split()] for line in BLOSUM62.split("\n") if line.strip()], float)
    out = np.empty_like(raw)
    for i in range(len(raw)):
        for j in range(len(raw)):
            out[i, j] = raw[i, j] / math.sqrt(raw[i, i] * raw[j, j])
    return out


def coded(anchors: list[str]) -> np.ndarray:
    """Residue numbers of anchors; unknown letters are one more than the last."""
    number = {c: i for i, c in enumerate(RESIDUES)}
    return np.array([[number.get(c, len(RESIDUES)) for c in a] for a in anchors], np.int64).reshape(-1, FRONT + BACK)


def weighted() -> np.ndarray:
    """[place, residue, residue]: weighted similarity, 0 for unknown residues."""
    out = np.zeros((FRONT + BACK, len(RESIDUES) + 1, len(RESIDUES) + 1))
    for k, w in enumerate(WEIGHTS):
        out[k, :-1, :-1] = w / sum(WEIGHTS) * matrix()
    return out


def scores(table: np.ndarray, one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Scores of one coded anchor with many, summed in ORDER."""
    total = np.zeros(len(many))
    for k in ORDER:
        total = total + table[k, one[k], many[:, k]]
    return total


def anchor(sequence: Column) -> Column:
    """First and last three letters in upper case; null for shorter sequences."""
    upper = F.upper(sequence)
    return F.when(F.length(upper) >= FRONT + BACK, F.concat(F.left(upper, F.lit(FRONT)), F.right(upper, F.lit(BACK))))


def mask(sequence: Column) -> Column:
    """First and last three letters as they are; shorter sequences whole."""
    return F.when(F.length(sequence) >= 6, F.concat(F.left(sequence, F.lit(3)), F.right(sequence, F.lit(3)))).otherwise(sequence)


def group_of(letter: Column) -> Column:
    """The number of a residue's group, -1 for unknown letters."""
    known = F.create_map(*[F.lit(x) for i, g in enumerate(GROUPS) for c in g for x in (c, i)])
    return F.coalesce(F.try_element_at(known, letter), F.lit(-1))


def block(anchor: Column) -> tuple[Column, Column]:
    """Groups of the second and the last residue, which clustering compares within."""
    return group_of(F.substring(anchor, 2, 1)), group_of(F.substring(anchor, 6, 1))


def codes(anchor: Column) -> Column:
    """Numbers of an anchor's residues, from 1; 0 for unknown letters."""
    letter = lambda k: F.rpad(F.substring(anchor, k + 1, 1), 1, " ")  # noqa: E731 (an empty string would be found everywhere)
    return F.array(*[F.instr(F.lit(RESIDUES), letter(k)) for k in range(FRONT + BACK)])


def _terms(a: Column, b: Column, places: tuple[int, ...]) -> list[Column]:
    """Weighted similarities at places of two anchors given as codes(): one look into a constant array a place."""
    n = len(RESIDUES) + 1
    square = np.zeros((n, n))
    square[1:, 1:] = matrix()
    known = F.array(*[F.lit(float(x)) for x in square.ravel()])
    return [F.lit(WEIGHTS[k] / sum(WEIGHTS)) * F.coalesce(F.get(known, F.get(a, F.lit(k)) * n + F.get(b, F.lit(k))), F.lit(0.0)) for k in places]


def coded_score(a: Column, b: Column) -> Column:
    """The weighted similarity of two anchors given as codes()."""
    first, *rest = _terms(a, b, tuple(ORDER))
    return sum(rest, first)


def partial_loss(a: Column, b: Column, places: tuple[int, ...]) -> Column:
    """What places take from the score 1 of two anchors given as codes()."""
    first, *rest = _terms(a, b, places)
    return F.lit(sum(WEIGHTS[k] for k in places) / sum(WEIGHTS)) - sum(rest, first)


def score(a: Column, b: Column) -> Column:
    """The weighted similarity of two anchors."""
    return coded_score(codes(a), codes(b))
