"""Packing of token sequences into windows of a fixed length, online and in bounded space (operator 9).

A task keeps a fixed number of open windows. A document's tokens first fill whole windows by themselves; the
rest goes whole into the open window it fits best. If it fits none, the fullest window is topped up with the
head of the rest and emitted full, and what is left opens a new window. At the end of a partition the open
windows are leftovers: their pieces, with their ids, go to merge tasks (a fixed number of partitions each), which
fill windows one after the other. What a merge task has at the very end is cut into lengths that are powers of
two, which need no padding.

Memory of a task: the open windows, the words of ``PIECE`` bytes of text or of one document, and the encoder's bounded memory of
words. What is shuffled: at most ``open_windows`` windows for each
input partition, whatever the size of the partition or of any one document.

Defined cases: null text counts as empty and gives the closing id alone; an empty table gives no rows; repeated
rows are packed each for itself; ids of very long texts are cut over many windows, in time and memory in proportion; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.bpe import default_vocabulary, encoder
from sightline.llm.common import as_batch, pieces, release_memory, stored, texts

WIDTH, OPEN, MERGE = 4096, 16, 64
#: Bytes of text that are encoded at once, about: the words of 8 MB took 100 MB of a worker more. A longer text goes by itself.
PIECE = 1 << 20
COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                 ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
LEFT = pa.schema([*OUT, ("ids", pa.binary()), ("part", pa.int64())])
#: Room for the windows of one task in a sequence's number; merge tasks number theirs from MERGED on.
ROOM, MERGED = 1 << 34, 1 << 61

#: A piece: document, start there, ids (4 bytes each), tokens of the document.
Piece = tuple[int, int, bytes, int]


class Packer:
    """Open windows of one task."""

    def __init__(self, width: int, windows: int, first: int):
        self.width, self.windows, self.number = width, windows, first
        self.open: list[tuple[int, list[Piece]]] = []  # tokens in the window, its pieces
        self.rows: list[tuple] = []

    def emit(self, window: list[Piece]) -> None:
        at = 0
        for doc, start, ids, total in window:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.number, at))
            at += n
        self.number += 1

    def put(self, doc: int, start: int, ids: bytes, total: int) -> None:
        wide, at = 4 * self.width, 0
        while len(ids) - at >= wide:  # by an offset: what is left is copied once
            self.emit([(doc, start, ids[at : at + wide], total)])
            at, start = at + wide, start + self.width
        ids = ids[at:]
        n = len(ids) // 4
        if not n:
            return
        best = max((k for k, (used, _) in enumerate(self.open) if used + n <= self.width), key=lambda k: self.open[k][0], default=-1)
        if best < 0 and len(self.open) == self.windows:
            k = max(range(len(self.open)), key=lambda k: self.open[k][0])
            used, window = self.open.pop(k)
            head = self.width - used
            self.emit([*window, (doc, start, ids[: 4 * head], total)])
            ids, start, n = ids[4 * head :], start + head, n - head
        if best < 0:
            self.open.append((n, [(doc, start, ids, total)]))
            return
        used, window = self.open[best]
        window.append((doc, start, ids, total))
        if used + n == self.width:
            self.emit(self.open.pop(best)[1])
        else:
            self.open[best] = (used + n, window)

    def finish(self) -> None:
        """Emit what is open as sequences whose lengths are powers of two (of these, a window is the longest)."""
        rest = deque(p for _, w in self.open for p in w)
        total = sum(len(p[2]) // 4 for p in rest)
        self.open = []
        while total:
            size = self.width if total >= self.width else 1 << (total.bit_length() - 1)
            total -= size
            window = []
            while size:
                doc, start, ids, whole = rest.popleft()
                n = min(size, len(ids) // 4)
                window.append((doc, start, ids[: 4 * n], whole))
                if 4 * n < len(ids):
                    rest.appendleft((doc, start + n, ids[4 * n :], whole))
                size -= n
            self.emit(window)


def flush(p: Packer) -> Iterator[pa.RecordBatch]:
    if p.rows:
        yield as_batch(dict(zip(OUT.names, zip(*p.rows, strict=True), strict=True)), OUT)
        p.rows = []


def pack(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2, width: int = WIDTH, open_windows: int = OPEN) -> DataFrame:
    """One row for each piece of each document. ``width`` must be a power of two."""
    if width & (width - 1):
        raise ValueError("width must be a power of two")
    path = vocabulary or default_vocabulary()
    end = end_id.to_bytes(4, "little")

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()  # of the stages before; the encoder's memory of words comes on top
        enc, part = encoder(path, True), TaskContext.get().partitionId()
        packer = Packer(width, open_windows, part * ROOM)
        for b in batches:
            for p in pieces(b, PIECE):
                for doc, (ids, _) in zip(p.column("doc_id").to_pylist(), enc.batch(p.column("text").to_pylist()), strict=True):
                    packer.put(doc, 0, ids + end, len(ids) // 4 + 1)
                for out in flush(packer):
                    n = out.num_rows
                    yield as_batch({**{c: out.column(c) for c in OUT.names}, "ids": [None] * n, "part": [-1] * n}, LEFT)
        rest = [p for _, w in packer.open for p in w]
        if rest:
            doc, start, ids, total = zip(*rest, strict=True)
            none = [None] * len(rest)
            yield as_batch({"doc_id": doc, "start": start, "length": none, "ids_crc32": none, "doc_tokens": total,
                            "sequence_id": none, "offset": none, "ids": ids, "part": [part] * len(rest)}, LEFT)

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(width, 1, MERGED + key[0].as_py() * ROOM)
        rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True)]
        for r in sorted(rows, key=lambda r: (r[0] is None, r[0], r[1], r[2])):
            packer.put(*r)
        packer.finish()
        yield from flush(packer)

    filled = texts(docs).mapInArrow(fill, f"{COLUMNS}, ids binary, part long")
    # full windows are given out as they are; both branches need the first pass, which is written once
    filled = stored(filled, "packed")
    whole = filled.where("part < 0").select(*OUT.names)
    rest = (filled.where("part >= 0").withColumn("task", F.floor(F.col("part") / MERGE))
            .groupBy("task").applyInArrow(merge, COLUMNS))
    return whole.unionByName(rest)
