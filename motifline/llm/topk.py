"""Exact top-k search by inner product over an impact-ordered index.

Rows are dealt into blocks. In a block every component is quantised; a posting
segment holds the rows that share a dimension and a quantised value (the impact).
Segments are processed by descending size of the impact, for a batch of queries
at once: score at a time. What a row still lacks is the rest vector: the row minus
the impacts added so far. By Cauchy and Schwarz the true score is within
|query| * |rest| of the accumulated one, so rows that can't be among the k best
are known. A query stops only when few rows are left by that proof (or no
segment), and those are rescored exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS, BATCH_ROWS, SHIFT = 4096, 512, 3
#: A proof is tried when this share of the postings is still open.
TRIED_AT = (0.4, 0.2, 0.0)
#: Rows worth an exact rescore before all segments are done, as a share of the block.
FEW = 0.02
PROBES = 16


def segments(x: np.ndarray, shift: int = SHIFT) -> list[tuple[int, int, int, np.ndarray]]:
    """(size of the impact, dimension, impact, rows), by descending size."""
    half = (1 << shift) >> 1
    out = []
    for d in range(x.shape[1]):
        code = x[:, d] >> shift
        order = np.argsort(code, kind="stable")
        cuts = np.flatnonzero(np.diff(code[order])) + 1
        for rows in np.split(order, cuts):
            if len(rows):
                impact = (int(code[rows[0]]) << shift) + half
                out.append((abs(impact), d, impact, rows))
    return sorted(out, key=lambda s: (-s[0], s[1], s[2]))


def _long_products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact products of rows of large numbers; what no 64-bit number can hold becomes the nearest one."""
    exact = x.astype(object) @ q.astype(object)
    return np.array([min(max(int(s), -(2**63)), 2**63 - 1) for s in exact], dtype=np.int64)


def search_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of each query's k best rows of the block, ties to smaller ids; own ids excluded."""
    width = max(x.shape[1], q.shape[1])  # shorter vectors end in zeros
    x, q = (np.pad(a, ((0, 0), (0, width - a.shape[1]))).astype(np.int64) for a in (x, q))
    # Where sums stay below 2**53 doubles are exact; else the bounds are widened by the error of doubles.
    sure = float(np.abs(x.astype(np.float64)).max(initial=0)) * float(np.abs(q.astype(np.float64)).max(initial=0)) * width < 2**53
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    parts = segments(x)
    open_rows, total = x.size, max(x.size, 1)
    acc = np.zeros((len(ids), len(q)))
    weights, norms = q.astype(np.float64), np.sqrt((q.astype(np.float64) ** 2).sum(1))
    rest = (x.astype(np.float64) ** 2).sum(1)
    unsure = (0.0 if sure else 1e-6) * np.sqrt(rest)
    alive = np.arange(len(q))
    tries = [t for t in TRIED_AT]

    def members(some: np.ndarray) -> np.ndarray:
        """For the open queries at the places `some`, one line each: rows that may be among the k best."""
        asked = query_ids[alive[some]]
        bound = norms[alive[some]][:, None] * (np.sqrt(np.maximum(rest, 0)) * (1 + 1e-9) + unsure)[None, :] + 1e-6
        high = np.ascontiguousarray(acc[:, some].T)
        low = high - bound
        high += bound
        if not sure:  # scores end at 64 bits, and what ends there ties
            low, high = np.clip(low, -(2.0**63), 2.0**63), np.clip(high, -(2.0**63), 2.0**63)
        for j, (i, e) in enumerate(zip(np.searchsorted(ids, asked, "left"), np.searchsorted(ids, asked, "right"), strict=True)):
            low[j, i:e] = high[j, i:e] = -np.inf
        least = np.partition(low, len(ids) - k, axis=1)[:, [len(ids) - k]] if len(ids) > k else -np.inf
        return (high >= least) & (high > -np.inf)

    def prove(last: bool) -> None:
        nonlocal acc, alive
        few = len(ids) if last else max(4 * k, FEW * len(ids))
        # A few queries show first whether a full proof is worth its cost.
        if not len(alive) or np.median(members(np.arange(0, len(alive), -(-len(alive) // PROBES))).sum(1)) > few:
            return
        possible = members(np.arange(len(alive)))
        done = possible.sum(1) <= few
        for j in np.flatnonzero(done):
            rows = np.flatnonzero(possible[j])
            scores = x[rows] @ q[alive[j]] if sure else _long_products(x[rows], q[alive[j]])
            best = np.lexsort((ids[rows], -scores))[:k]
            found.append((np.full(len(best), query_ids[alive[j]]), ids[rows[best]], scores[best]))
        acc, alive = acc[:, ~done], alive[~done]

    for n, (_, d, impact, rows) in enumerate(parts):
        acc[rows] += (impact * weights[alive, d])[None, :]
        value = x[rows, d].astype(np.float64)
        rest[rows] += (value - impact) ** 2 - value**2
        open_rows -= len(rows)
        while tries and n + 1 < len(parts) and open_rows <= tries[0] * total:
            tries.pop(0)
            prove(False)
        if not len(alive):
            break
    prove(True)
    if not found:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(c).astype(np.int64) for c in zip(*found, strict=True))


def whole_numbers(vector: Column) -> Column:
    """floor(256 * x) of each component, null if the vector or a component is null or not finite.

    Beyond 2**62 either way it is that number.
    """
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    most = F.lit(float(1 << 62))
    whole = F.transform(vector, lambda x: F.floor(F.least(F.greatest(x.cast("double") * 256, -most), most)).cast("long"))
    return F.when(vector.isNotNull() & ~bad, whole)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    rows = rows.chunk(0) if isinstance(rows, pa.ChunkedArray) else rows
    sizes = np.asarray(rows.value_lengths())
    flat = np.asarray(rows.flatten())
    if not len(sizes) or sizes.min() == sizes.max():
        return flat.reshape(len(sizes), int(sizes.max()) if len(sizes) else 0)
    out = np.zeros((len(sizes), sizes.max()), dtype=flat.dtype)
    out[np.arange(sizes.max())[None, :] < sizes[:, None]] = flat
    return out


def search(rows: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all rows for each row that is a query.

    Candidates are all rows but those with the query's own id. A vector that is null or
    holds a null or non-finite component takes no part, nor does a null id; shorter
    vectors count as ending in zeros. Components may be of any finite size: those whose
    256-fold is beyond 2**62 count as that, and a score beyond 64 bits as the largest or
    smallest one. Ties go to the smaller id. A repeated candidate
    row counts as often as it is there, a repeated query once.
    """
    valid = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), whole_numbers(F.col(vector)).alias("x"), is_query.alias("_query")).where("x is not null")
    queries = valid.where("_query").select("id", "x").distinct()
    n = valid.agg(F.count("*").alias("rows"), F.count_if("_query").alias("queries")).first()
    blocks, batches = -(-n.rows // BLOCK_ROWS) or 1, -(-n.queries // BATCH_ROWS) or 1
    # Blocks and batches are dealt by hash, so they are of like size whatever the ids or vectors.
    deal = lambda parts: F.pmod(F.xxhash64("id", "x"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = valid.select("id", "x", deal(blocks).alias("block")).withColumn("batch", every(batches))
    right = queries.select("id", "x", deal(batches).alias("batch")).withColumn("block", every(blocks))

    def task(a: pa.Table, b: pa.Table) -> pa.Table:
        got = (np.empty(0, np.int64),) * 3
        if a.num_rows and b.num_rows:
            got = search_block(a["id"].to_numpy(), _matrix(a["x"]), b["id"].to_numpy(), _matrix(b["x"]), k)
        return pa.table({"query_id": got[0], "vec_id": got[1], "score": got[2]})

    best = left.groupBy("block", "batch").cogroup(right.groupBy("block", "batch")).applyInArrow(task, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
