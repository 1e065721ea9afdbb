"""Nearest neighbours by a block matrix join on int8 product tiles (operator 2).

Vectors are scaled to unit length and quantised to int8 with a scale each; the length of what quantising lost is
kept. A tile of queries times candidates is an exact integer matrix product (float32 holds it exactly for the given
dimension, else float64). With u = s q + e for both sides the cosine differs from s s' q.q' by at most
|e| + (1 + |e|) |e'|, so every pair whose upper bound reaches the k-th best lower bound of its query survives, and
no true neighbour is lost. Survivors are recomputed in double precision from the original vectors and kept in heaps
of k for each query; heaps of different tiles are merged by further heaps.

Both sides are dealt into blocks of bounded size by a hash of the id, and each pair of blocks is one group, so the
work splits evenly whatever the data: no cross join of rows, no side is broadcast. Queries are a stated set.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows with a
null id; vectors of different dimension are never compared; ties go to the smaller id; repeated ids are separate
candidates, but never neighbours of their own id; an id that several query rows have is one query, answered by the k
best pairs with any of its vectors (equal vectors once); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import as_batch

#: Bytes of a block, about, as doubles. A task holds one block of each side; a row is copied once for each block of the
#: other side, so large blocks mean little shuffle.
BLOCK = 8 << 20
#: Queries times candidates of a tile, which bounds its memory.
TILE = 1 << 21
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
RANKED = pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64())])


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``v`` (array of double), ``dim`` of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
            .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(fine).withColumn("dim", F.size("v")))


def quantised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of the unit vectors, their scales, and the length of what is lost (rounded up)."""
    big = np.abs(v).max(axis=1, keepdims=True)
    unit = v / big
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    lost = np.sqrt(((unit - scale[:, None] * codes) ** 2).sum(axis=1))
    return codes, scale, lost + 1e-12


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, components added in order."""
    dot, aa, bb = (np.zeros(len(a)) for _ in range(3))
    for k in range(a.shape[1]):
        x, y = a[:, k], b[:, k]
        dot += x * y
        aa += x * x
        bb += y * y
    with np.errstate(all="ignore"):
        out = dot / np.sqrt(aa * bb)
    odd = np.flatnonzero(~np.isfinite(out) | (aa * bb < 1e-280))
    for i in odd:  # components so large or small that squares leave the range
        x, y = a[i] / np.abs(a[i]).max(), b[i] / np.abs(b[i]).max()
        out[i] = (x @ y) / np.sqrt((x @ x) * (y @ y))
    return np.clip(out, -1.0, 1.0)


def tile(q_id: np.ndarray, q: np.ndarray, c_id: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """The k best of the block's candidates for each query, exactly."""
    exact = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64
    qc, qs, ql = quantised(q)
    cc, cs, cl = quantised(c)
    about = (qc.astype(exact) @ cc.astype(exact).T).astype(np.float64) * qs[:, None] * cs[None, :]
    slack = ql[:, None] + (1 + ql[:, None]) * cl[None, :]
    own = q_id[:, None] == c_id[None, :]
    low = np.where(own, -np.inf, about - slack)
    floor = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(q), -np.inf)
    i, j = np.nonzero(~own & (about + slack >= floor[:, None]))
    heaps: dict[int, list[tuple[float, int]]] = {}
    for at in range(0, len(i), 1 << 16):
        x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        for n, s, d in zip(x.tolist(), cosines(q[x], c[y]).tolist(), c_id[y].tolist(), strict=True):
            offer(heaps.setdefault(n, []), (s, -d), k)
    return [(int(q_id[n]), -d, s) for n, heap in heaps.items() for s, d in heap]


def offer(heap: list, item: tuple, k: int) -> None:
    if len(heap) < k:
        heapq.heappush(heap, item)
    elif item > heap[0]:
        heapq.heapreplace(heap, item)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, query_block: int | None = None, candidate_block: int | None = None) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the k candidates of largest cosine for each query id. Blocks hold
    so many rows, by default what BLOCK bytes of the largest dimension are."""
    every = usable(vectors)
    queries = every.where(is_query).select("vec_id", "v", "dim").dropDuplicates(["vec_id", "v"])
    n, nq, dim = every.agg(F.count("*"), F.count_if(is_query), F.coalesce(F.max("dim"), F.lit(1))).first()
    rows_of = max(1, BLOCK // (8 * dim))
    # blocks by counts of all rows; sizes vary little around their mean, as ids are hashed
    nb, qb = max(1, -(-n // (candidate_block or rows_of))), max(1, -(-nq // (query_block or rows_of)))

    def side(df: DataFrame, kind: int, own: int, other: int, names: tuple[str, str]) -> DataFrame:
        # salted with the vector and, for candidates, the row, so that neither repeated ids nor repeated rows meet in one block
        return (df.withColumn(names[0], F.pmod(F.xxhash64("vec_id", "v", F.monotonically_increasing_id() if kind else F.lit(0)), F.lit(own)).cast("int"))
                .withColumn(names[1], F.explode(F.sequence(F.lit(0), F.lit(other - 1))))
                .select("dim", "qb", "cb", F.lit(kind).alias("kind"), "vec_id", "v"))

    both = side(queries, 0, qb, nb, ("qb", "cb")).unionByName(side(every, 1, nb, qb, ("cb", "qb")))

    def search(batch: pa.Table) -> pa.Table:
        kind = batch.column("kind").to_numpy()
        ids = batch.column("vec_id").to_numpy()
        v = np.array(batch.column("v").combine_chunks().flatten()).reshape(len(ids), -1)
        q, c = kind == 0, kind == 1
        rows: list[tuple[int, int, float]] = []
        if q.any():
            qi, qv = ids[q], v[q]
            step = max(1, TILE // max(1, int(c.sum())))
            for at in range(0, len(qi), step):
                rows += tile(qi[at : at + step], qv[at : at + step], ids[c], v[c], k) if c.any() else []
        cols = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.table(dict(zip(FOUND.names, cols, strict=True)), schema=FOUND)

    found = both.groupBy("dim", "qb", "cb").applyInArrow(search, "query_id long, vec_id long, score double")

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list[tuple[float, int]]] = {}
        for b in batches:
            for q, d, s in zip(*(b.column(c).to_pylist() for c in FOUND.names), strict=True):
                offer(heaps.setdefault(q, []), (s, -d), k)
        rows = [(q, r, -d, s) for q, heap in heaps.items() for r, (s, d) in enumerate(sorted(heap, reverse=True), 1)]
        for at in range(0, len(rows), 50_000):
            yield as_batch(dict(zip(RANKED.names, zip(*rows[at : at + 50_000], strict=True), strict=True)), RANKED)

    return found.repartition("query_id").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")
