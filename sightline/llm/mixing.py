"""Mixing of sources to target weights by balanced sampling with the cube method (operator 12).

A source's target is its weight's share of the budget, stopped at ``MOST`` times its size; what is cut off is shared
again by weight. A document is taken whole so often as its source's quotient of target and size says; for the fraction
that is left it has an inclusion probability. The cube method moves these probabilities: of three open documents the
vector (s2 - s3, s3 - s1, s1 - s2) lies in the null space of the constraints "words" and "documents", so a step along
it, of random direction and as far as the unit cube allows, keeps both totals and closes a document at least.

A source is split by a hash of its documents into blocks of about ``BLOCK``, each a group of its own, so one that holds
a third of all rows is many tasks. A block leaves at most two documents open; those of ``FAN`` blocks meet in a group of
the next level, until a source has one group. There at most ``LANDING`` documents stay open, and of all ways to close
them the one whose words come nearest to what is due is taken (of equals that nearest in documents).

Chance comes from a fixed seed and the name of the block; order from sizes and ids: reruns agree, whatever the layout of
the table. Only ids, sources and sizes are shuffled.

Defined cases: null text has size 0; a null source is a source, the last one; repeated rows are documents each (equal
rows are counted first and dealt one by one, so even a third of all rows may be alike); null ids likewise; sources of
size 0 get target 0; an empty table gives no rows; words of very long texts are counted in blocks of bytes; further
columns are ignored.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterable, Iterator
from decimal import Decimal
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import as_batch, bounded_batches, drop_memories, pieces, stored, word_counts

#: Weights of the sources, repeating; budget in words as a share of all (a fraction); a document's times, at most.
WEIGHTS, SHARE, MOST = (5, 2, 1), (3, 2), 2
#: Documents of a block, about; blocks that meet on the next level; documents open at the end.
BLOCK, FAN, LANDING = 8192, 64, 10


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size`` of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("size", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_memories()
        for b in batches:
            for p in pieces(b):
                yield as_batch({"doc_id": p.column("doc_id"), "source": p.column("source"), "size": word_counts(p.column("text"))}, schema)

    bounded_batches(docs.sparkSession)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return read.mapInArrow(run, "doc_id long, source string, size long")


def numbered(sources: DataFrame) -> DataFrame:
    """With ``place``: from 0 by code point of ``source``, null last. Ranges are numbered each by itself."""
    order = F.col("source").asc_nulls_last()
    ranges = stored(sources.repartitionByRange(order).withColumn("range", F.spark_partition_id()), "sources")
    rows = sorted((r["range"], r["count"]) for r in ranges.groupBy("range").count().collect())  # one for each partition
    before = [0, *accumulate(n for _, n in rows)]
    start = F.create_map(*(F.lit(x) for (k, _), n in zip(rows, before, strict=False) for x in (k, n))) if rows else F.create_map(F.lit(0), F.lit(0))
    return ranges.withColumn("place", F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1 + start[F.col("range")]).drop("range")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """``sources`` (source, source_size, rows) with ``target``. The level of words for a unit of weight is the fraction
    above / below; sources it gives more than their limit are set to that and the level worked out again, until
    none is new. Only sums reach the driver; a round reads a row for each source."""
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    rows = stored(numbered(sources).withColumn("weight", weight).drop("place"), "weights")
    big = "decimal(38,0)"
    limit = most * F.col("source_size")
    total = rows.agg(F.coalesce(F.sum(F.col("source_size").cast(big)), F.lit(0).cast(big))).first()[0]
    stopped, count = F.lit(False), 0
    while True:
        r = rows.agg(F.coalesce(F.sum(F.when(stopped, limit.cast(big))), F.lit(0).cast(big)).alias("cut"), F.coalesce(F.sum(F.when(~stopped, F.col("weight"))), F.lit(1)).alias("left"), F.count_if(stopped).alias("n")).first()
        above, below = int(budget[0] * total - budget[1] * r["cut"]), int(budget[1] * r["left"])
        if r["n"] == count and count:
            break
        count = r["n"]
        stopped = F.col("weight").cast(big) * F.lit(Decimal(above)).cast("decimal(26,0)") > limit.cast("decimal(20,0)") * F.lit(Decimal(below)).cast("decimal(18,0)")
        if not rows.where(stopped).limit(1).count():
            break
    target = F.when(stopped, limit.cast("double")).otherwise(F.col("weight") * F.lit(float(above)) / F.lit(float(below)))
    return rows.withColumn("target", target)


def flight(size: list[int], p: list[float], chance: random.Random, stop: int) -> None:
    """Moves ``p`` until at most ``stop`` (two or more) are open, words and documents unchanged but for rounding."""
    n, at, work = len(p), 0, []
    while True:
        while len(work) < 3 and at < n:
            if 0 < p[at] < 1:
                work.append(at)
            at += 1
        if len(work) < 3 or len(work) + n - at <= stop:
            return
        a, b, c = work
        u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
        if not any(u):
            u = (1, -1, 0)
        room = [((1 - p[k]) / v if v > 0 else -p[k] / v, p[k] / v if v > 0 else (p[k] - 1) / v, k) for k, v in zip(work, u, strict=True) if v]
        up, down = min(r[0] for r in room), min(r[1] for r in room)
        forward = chance.random() * (up + down) < down
        step = up if forward else -down
        closed = min(room, key=lambda r: r[0 if forward else 1])[2]
        for k, v in zip(work, u, strict=True):
            p[k] += step * v
            if p[k] < 1e-9 or p[k] > 1 - 1e-9 or k == closed:
                p[k] = float(round(p[k]))
        work = [k for k in work if 0 < p[k] < 1]


def land(size: list[int], p: list[float]) -> None:
    """Closes the open ones, as near as can be to their words and then to their number."""
    still = [k for k, x in enumerate(p) if 0 < x < 1]
    if not still:
        return
    ways = (np.arange(1 << len(still))[:, None] >> np.arange(len(still))) & 1
    own, due = np.array([size[k] for k in still], dtype=float), np.array([p[k] for k in still])
    words, number = np.abs(ways @ own - due @ own), np.abs(ways.sum(axis=1) - due.sum())
    best = ways[np.lexsort((number, np.round(words, 6)))[0]]
    for k, x in zip(still, best.tolist(), strict=True):
        p[k] = float(x)


UNIT = "source string, block long, blocks long, doc_id long, copy long, size long, p double, whole long, source_size long, target double"


def moved(level: int, seed: int, landing: int = LANDING):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        doc = table.column("doc_id").combine_chunks()
        order = np.lexsort((table.column("copy").to_numpy(), doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False), -table.column("size").to_numpy()))
        table = table.take(pa.array(order))
        size, p = table.column("size").to_pylist(), table.column("p").to_pylist()
        last = table.column("blocks")[0].as_py() == 1
        flight(size, p, random.Random(zlib.crc32(repr((seed, level, *(k.as_py() for k in key))).encode())), landing if last else 2)
        if last:
            land(size, p)
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))

    return run


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: tuple[int, int] = SHARE, most: int = MOST, block: int = BLOCK, fan: int = FAN, seed: int = 7) -> DataFrame:
    """``doc_id, size, source_size, target, taken, source, copies`` of every row."""
    alike = stored(sizes(docs).groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")), "sizes")
    own = targets(alike.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("rows")), weights, budget, most)
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    own = stored(own.select(F.col("source").alias("of"), "source_size", "target", F.ceil(F.col("rows") / block).alias("blocks"), F.floor(times).alias("whole"), (times - F.floor(times)).alias("p")), "targets")
    deepest = own.agg(F.max("blocks")).first()[0] or 1
    rows = alike.join(own, F.col("source").eqNullSafe(F.col("of")))
    # equal rows one by one, in two steps so that no array is long
    rows = rows.withColumn("hundred", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / 1000))))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.col("hundred") * 1000, F.least(F.col("hundred") * 1000 + 999, F.col("n") - 1))))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "size", "copy"), F.col("blocks")))
    columns = [c.split()[0] for c in UNIT.split(", ")]
    rows = rows.select(*columns)
    closed = [rows.where("p = 0")]
    still, level = rows.where("p > 0"), 0
    while True:
        done = stored(still.groupBy("source", "block").applyInArrow(moved(level, seed), UNIT), "level")
        closed.append(done.where("p = 0 or p = 1"))
        if deepest == 1:
            break
        still = (done.where("p > 0 and p < 1").withColumn("block", F.floor(F.col("block") / fan)).withColumn("blocks", F.ceil(F.col("blocks") / fan)))
        deepest, level = -(-deepest // fan), level + 1
    out = closed[0]
    for more in closed[1:]:
        out = out.unionByName(more)
    copies = (F.col("whole") + F.col("p").cast("long")).alias("copies")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), "source", copies)
