"""Scores of all pairs of a block of queries and a part of the rows, reduced where they are computed.

Scores are cosines in billionths, rounded once to nine digits and once more to six, half up, as whole numbers. A vector that holds NaN scores NaN, above all others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_NAN = 1 << 60
#: Pairs that are held at a time.
_HELD = 1 << 20


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _scores(queries: pa.Table, rows: pa.Table):
    """(first, scores): slices of the queries from ``first`` on with their scores of all rows; -inf for a row of the query's own id."""
    q, v, asked, ids = _matrix(queries["v"]), _matrix(rows["v"]), queries["query_id"].to_numpy(), rows["vec_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    low, high = (np.searchsorted(ids[order], asked, side=s) for s in ("left", "right"))
    step = max(1, _HELD // len(ids))
    for first in range(0, len(asked), step):
        out = q[first:first + step] @ v.T
        for k in np.flatnonzero(high[first:first + step] > low[first:first + step]):
            out[k, order[low[first + k]:high[first + k]]] = -np.inf
        yield first, out


def _billionths(x: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(x), _NAN, np.rint(np.where(np.isnan(x), 0.0, x) * 1e9)).astype(np.int64)


def _six_digits(k: np.ndarray) -> np.ndarray:
    """Billionths, none below 0, as millionths."""
    return np.where(k == _NAN, _NAN, (k + 500) // 1000)


def _shown(k: np.ndarray) -> np.ndarray:
    return np.where(k == _NAN, np.nan, k / 1e6)


def best(queries: pa.Table, rows: pa.Table, top: int) -> pa.Table:
    """(query_id, vec_id, score): of these rows the ``top`` best of each query with scores above 0, and equal scores by id."""
    asked, ids, found = queries["query_id"].to_numpy(), rows["vec_id"].to_numpy(), [[], [], []]
    for first, x in _scores(queries, rows) if len(queries) and len(rows) else ():
        x = np.where(np.isnan(x), np.inf, x) if np.isnan(x).any() else x
        least = np.partition(x, -top, axis=1)[:, -top] if x.shape[1] > top else np.full(len(x), -np.inf)
        q, r = np.nonzero(x >= np.maximum(least - 2e-6, 1e-7)[:, None])  # all that may be as good at six digits
        k = _six_digits(_billionths(np.where(x[q, r] == np.inf, np.nan, x[q, r])))
        order = np.lexsort((ids[r], -k, q))
        q, r, k = q[order], r[order], k[order]
        keep = (np.arange(len(q)) - np.searchsorted(q, q) < top) & (k > 0)
        for part, own in zip(found, (asked[first + q[keep]], ids[r[keep]], _shown(k[keep]))):
            part.append(own)
    whole = [np.concatenate(x) if x else np.array([], dtype=t) for x, t in zip(found, (np.int64, np.int64, np.float64))]
    return pa.table(dict(zip(("query_id", "vec_id", "score"), whole)))


def above(queries: pa.Table, rows: pa.Table, floor: float) -> pa.Table:
    """(query_id, n, best): how many of these rows score above the floor for each query that any does, and the best score."""
    asked, found, least = queries["query_id"].to_numpy(), [[], [], []], round(floor * 1e9)
    for first, x in _scores(queries, rows) if len(queries) and len(rows) else ():
        q, r = np.nonzero(~(x < floor - 1e-8))  # NaN, too
        k = _billionths(x[q, r])
        q, k = q[k > least], k[k > least]
        n, most = np.bincount(q, minlength=len(x)), np.zeros(len(x), dtype=np.int64)
        np.maximum.at(most, q, k)
        for part, own in zip(found, (asked[first:first + len(x)][n > 0], n[n > 0], _shown(_six_digits(most[n > 0])))):
            part.append(own)
    whole = [np.concatenate(x) if x else np.array([], dtype=t) for x, t in zip(found, (np.int64, np.int64, np.float64))]
    return pa.table(dict(zip(("query_id", "n", "best"), whole)))
