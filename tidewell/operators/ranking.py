"""The best rows of a batch for many queries at once."""

from __future__ import annotations

import numpy as np


def best_of_batch(rows: np.ndarray, scores: np.ndarray, k: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the ``k`` best rows in every column of ``scores``, the smaller row first among equals.

    Scores of minus infinity are no candidates. Without ``k``, all candidates.
    """
    order = np.argsort(rows, kind="stable")
    rows, scores = rows[order], scores[order]
    n = len(rows)
    if k is None or n <= k:
        at, query = np.nonzero(scores > -np.inf)
    else:  # beyond the k-th best score, and of rows that share it the smallest
        least = np.partition(scores, n - k, axis=0)[n - k]
        above = scores > least
        equal = (scores == least) & (scores > -np.inf)
        at, query = np.nonzero(above | equal & (np.cumsum(equal, axis=0) <= k - above.sum(axis=0)))
    return query, rows[at], scores[at, query]
