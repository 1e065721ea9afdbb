"""Audit of how filters interact over all their orders (operator 13).

Five filters, 120 orders, five steps: 600 step outcomes for each document. A document's failed filters are a mask of
five bits, and each mask (with its two labels) stands for one big integer whose 64-bit fields hold all step outcomes
at once: removed, kept, redundant and the others. A task adds the integers of its documents up by part, so a table of
any size leaves it as one integer a part; these are added in two further steps, ``FAN`` tasks' at a time and then all,
and unpacked once. A field overflows beyond 2^64 documents of a part.

Identity of texts goes by SHA-256: the smallest id of each digest is found with partial sums, and joined back on digest
and id together, so that a text with very many copies isn't one key of a join.

Defined cases: null text is empty (it fails A alone, or A and E); null lang is ''; a null id has no smaller one and is
no smaller one, so it never fails E, and has no labels; rows that repeat an id and a text don't fail E by each other;
of repeated labels any 1 counts; null labels are 0; an empty table gives no rows; of very long texts the distinct words
alone are held, and words are split in pieces of ``PIECE`` bytes; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import as_batch, bounded_batches, drop_memories, pieces, stored

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(ORDERS) * len(FILTERS)
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
#: Bytes of a field; tasks whose sums meet at first; parts a task holds; bytes of text split at once.
FIELD, FAN, HELD, PIECE = 8, 512, 256, 1 << 20
#: Bits of a cell beyond the mask.
GOOD, TOXIC = 32, 64

FURTHER = bytes(range(0x80, 0xC0))
UPPER = bytes(range(0x41, 0x5B))
SIGNS = b"#$%&*|"
GAP = re.compile(rb"[\x20\x09-\x0D]")


def failed(text: bytes, least: int = 100, distinct: int = 80, upper: int = 10) -> int:
    """Mask of the filters A to D that a text fails."""
    words, seen, at = 0, set(), 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):  # a piece ends where a word does
            gap = GAP.search(text, end)
            end = gap.start() if gap else len(text)
        found = text[at:end].split()
        words += len(found)
        seen.update(found)
        at = end
    points = len(text.translate(None, FURTHER))
    capitals = len(text) - len(text.translate(None, UPPER))
    signs = len(text) != len(text.translate(None, SIGNS))
    return (words < least) | (100 * len(seen) < distinct * words) << 1 | (100 * capitals > upper * points) << 2 | signs << 3


ROWS = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("digest", pa.binary())])


def masks(docs: DataFrame) -> DataFrame:
    """``doc_id, part, mask`` (filters A to D) and ``digest`` of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_memories()
        for b in batches:
            for p in pieces(b):
                texts = p.column("text").to_pylist()
                yield as_batch({"doc_id": p.column("doc_id"), "part": p.column("part"), "mask": [failed(t) for t in texts], "digest": [hashlib.sha256(t).digest() for t in texts]}, ROWS)

    bounded_batches(docs.sparkSession)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("part"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return read.mapInArrow(run, "doc_id long, part string, mask int, digest binary")


@lru_cache(maxsize=None)
def packed(cell: int) -> int:
    """The integer of a mask with its labels: a field for each measure, order and step."""
    fields = np.zeros((len(MEASURES), STEPS), dtype="<u8")
    for k, order in enumerate(ORDERS):
        gone = False
        for s, name in enumerate(order):
            bit = 1 << FILTERS.index(name)
            fails = bool(cell & bit)
            out = fails and not gone
            fields[:, 5 * k + s] = (not (gone or fails), out, fails and gone, cell & 31 == bit, out and bool(cell & GOOD), out and bool(cell & TOXIC))
            gone |= fails
    return int.from_bytes(fields.tobytes(), "little")


WIDE = len(MEASURES) * STEPS * FIELD
SUMS = pa.schema([("part", pa.string()), ("salt", pa.int64()), ("packed", pa.binary())])


def summed(rows: DataFrame) -> DataFrame:
    """``part, salt, packed``: the integers of each task's rows (part, cell), added up by part."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() // FAN
        totals: dict[str, int] = {}

        def given() -> pa.RecordBatch:
            return as_batch({"part": list(totals), "salt": [salt] * len(totals), "packed": [v.to_bytes(WIDE, "little") for v in totals.values()]}, SUMS)

        for b in batches:
            for (part, cell), n in Counter(zip(b.column("part").to_pylist(), b.column("cell").to_pylist(), strict=True)).items():
                totals[part] = totals.get(part, 0) + n * packed(cell)
            if len(totals) > HELD:
                yield given()
                totals.clear()
        if totals:
            yield given()

    return rows.mapInArrow(run, "part string, salt long, packed binary")


def added(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = 0
    for b in batches:
        for x in b.column("packed"):
            total += int.from_bytes(x.as_py(), "little")
    yield as_batch({"part": [key[0].as_py()], "salt": [0], "packed": [total.to_bytes(WIDE, "little")]}, SUMS)


RESULT = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((m, pa.int64()) for m in (*MEASURES, "shapley"))])


def unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    letters = np.array([FILTERS.index(c) for order in ORDERS for c in order])
    for b in batches:
        for part, data in zip(b.column("part").to_pylist(), b.column("packed").to_pylist(), strict=True):
            fields = np.frombuffer(data, "<u8").reshape(len(MEASURES), STEPS).astype(np.int64)
            removed = np.bincount(letters, weights=None, minlength=len(FILTERS)) * 0
            np.add.at(removed, letters, fields[MEASURES.index("removed")])
            yield as_batch({"part": [part] * STEPS, "filter_order": [o for o in ORDERS for _ in FILTERS], "step": [s for _ in ORDERS for s in range(1, len(FILTERS) + 1)]} | dict(zip(MEASURES, fields, strict=True)) | {"shapley": removed[letters]}, RESULT)


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part`` and ``cell`` (all five filters and both labels) of every row."""
    rows = stored(masks(docs), "masks")
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("earliest", F.lit(True))
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        (F.max(F.when(F.col("quality") == 1, GOOD).otherwise(0)) + F.max(F.when(F.col("toxic") == 1, TOXIC).otherwise(0))).alias("said"))
    rows = rows.join(first, ["digest", "doc_id"], "left").join(said, "doc_id", "left")
    again = F.when(F.col("doc_id").isNotNull() & F.col("earliest").isNull(), 16).otherwise(0)
    return rows.select("part", (F.col("mask") + again + F.coalesce("said", F.lit(0))).cast("int").alias("cell"))


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step`` with the counts of ``MEASURES`` and ``shapley``."""
    shape = "part string, salt long, packed binary"
    sums = summed(cells(docs, labels)).groupBy("part", "salt").applyInArrow(added, shape).groupBy("part").applyInArrow(added, shape)
    return sums.mapInArrow(unpacked, "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in (*MEASURES, "shapley")))
