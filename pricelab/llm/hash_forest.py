"""Approximate nearest neighbours by cosine with a hash-prefix forest (LSH forest).

Index. The vectors are dealt over shards by a hash of their id (about ``SHARD_ROWS`` rows each), so that copies of
one vector spread evenly. A shard's forest has ``TREES`` trees; a tree is the sorted array of its vectors' hash
strings: ``BITS`` signs of projections on the tree's own random directions, drawn from a fixed seed.

Search. A query visits every shard. In each tree it descends to its longest prefix match. Then all trees ascend
together: at depth d the candidates are the vectors that share d bits with the query in any tree (a range of each
sorted array); d falls until the ranges hold ``share`` of the shard's rows together (a vector counts once for every
tree that finds it) and k + 1 rows per tree, or reach the roots, so there are always k candidates if there are k rows. Every candidate is scored exactly on
the original vectors, in double precision, and a shard returns its ``k`` best; a window over these few rows per query
merges the shards.

Random directions tell little about unstructured vectors whose neighbours are far away (cosine 0.4 to 0.5 in 64
dimensions), so ``share`` is high; recall is measured in the tests (0.9 or more) and given in the README.

Blocks of ``QUERY_ROWS`` queries meet one shard at a time; no pair is written but a shard's k best. Vectors that are
null, empty, zero or hold null or non-finite components take no part, neither as queries nor as candidates;
vectors of another length than a query's are no candidates of it. Ties go to the smaller id. Repeated rows
(equal id and vector) count as one; rows that share an id but not the vector are candidates with that id each.
A null id takes no part. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TREES = 96
BITS = 24
SHARE = 0.5
SHARD_ROWS = 16384
QUERY_ROWS = 4096
SEED = 4711


def _usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _codes(vectors: np.ndarray, trees: int) -> np.ndarray:
    """(trees, rows) hash strings as numbers of BITS bits, the first bit highest."""
    planes = np.random.default_rng((SEED, vectors.shape[1])).standard_normal((vectors.shape[1], trees * BITS))
    signs = (vectors @ planes > 0).reshape(len(vectors), trees, BITS)
    weights = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)
    return (signs @ weights).T


def candidates(codes: np.ndarray, asked: np.ndarray, share: float, k: int = 0):
    """Yield (query number, candidate rows) of the synchronous ascent in one shard.

    ``codes``: (trees, rows) of the shard, ``asked``: (trees, queries)."""
    trees, n = codes.shape
    order = np.argsort(codes, axis=1, kind="stable")
    arrays = np.take_along_axis(codes, order, axis=1)
    need = max(share * n, trees * (k + 1) if k else 0)
    depth = np.full(asked.shape[1], -1)
    low = np.zeros(asked.shape, np.int64)
    high = np.zeros(asked.shape, np.int64)
    for d in range(BITS, -1, -1):
        open_ = np.flatnonzero(depth < 0)
        if not len(open_):
            break
        shift = np.uint64(BITS - d)
        begin = (asked[:, open_] >> shift) << shift
        end = begin + ((np.uint64(1) << shift) - np.uint64(1))
        lo = np.stack([np.searchsorted(arrays[t], begin[t], side="left") for t in range(trees)])
        hi = np.stack([np.searchsorted(arrays[t], end[t], side="right") for t in range(trees)])
        stop = ((hi - lo).sum(0) >= need) | (d == 0)
        done = open_[stop]
        depth[done], low[:, done], high[:, done] = d, lo[:, stop], hi[:, stop]
    for q in range(asked.shape[1]):
        found = np.zeros(n, bool)
        for t in range(trees):
            found[order[t, low[t, q]: high[t, q]]] = True
        yield q, np.flatnonzero(found)


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the vectors and all their components."""
    flat = column.combine_chunks()
    flat = flat if isinstance(flat, pa.ListArray) else pa.concat_arrays(flat.chunks)
    return np.diff(flat.offsets.to_numpy()), flat.flatten().to_numpy().astype(np.float64)


def _search(k: int, trees: int, share: float):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and queries.num_rows:
            (n_rows, flat_rows), (n_asked, flat_asked) = _matrix(rows["vector"]), _matrix(queries["vector"])
            ids, asked_ids = rows["id"].to_numpy(), queries["id"].to_numpy()
            at_rows, at_asked = np.cumsum(n_rows) - n_rows, np.cumsum(n_asked) - n_asked
            for width in np.unique(n_asked):
                own, asking = np.flatnonzero(n_rows == width), np.flatnonzero(n_asked == width)
                if not len(own):
                    continue
                lane = np.arange(width)
                x, y = flat_rows[at_rows[own][:, None] + lane], flat_asked[at_asked[asking][:, None] + lane]
                # scaled by the largest component first, so that squares neither overflow nor vanish
                x, y = x / np.abs(x).max(1, keepdims=True), y / np.abs(y).max(1, keepdims=True)
                long_x, long_y = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
                for q, found in candidates(_codes(x, trees), _codes(y, trees), share, k):
                    found = found[ids[own][found] != asked_ids[asking[q]]]
                    score = (x[found] * y[q]).sum(1) / (long_x[found] * long_y[q])
                    if len(found) > 4 * k:
                        near = np.flatnonzero(score >= np.partition(score, -k)[-k])
                        found, score = found[near], score[near]
                    best = np.lexsort((ids[own][found], -score))[:k]
                    out += [(asked_ids[asking[q]], ids[own][found[b]], score[b], len(found)) for b in best]
        cols = list(zip(*out)) if out else [(), (), ()]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    return run


def nearest(embeddings: DataFrame, queries: Column, k: int = 5, trees: int = TREES, share: float = SHARE,
            vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every row for which ``queries`` holds, the row itself left out."""
    rows = (embeddings.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"),
                              F.coalesce(queries, F.lit(False)).alias("asks"))
            .filter(F.col("id").isNotNull() & _usable(F.col("vector"))).dropDuplicates(["id", "vector"]))
    n, n_asks = embeddings.agg(F.count("*"), F.count(F.when(queries, 1))).first()
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-n_asks // QUERY_ROWS))
    all_of = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    # every shard meets every block of queries once
    index = (rows.select(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shards)).alias("shard"), "id", "vector")
             .withColumn("block", all_of(blocks)))
    asked = (rows.filter("asks").select(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(blocks)).alias("block"), "id", "vector")
             .withColumn("shard", all_of(shards)))
    cell = lambda df: df.select(F.col("shard").cast("int").alias("shard"), F.col("block").cast("int").alias("block"), "id", "vector").groupBy("shard", "block")
    found = cell(index).cogroup(cell(asked)).applyInArrow(_search(k, trees, share), "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
