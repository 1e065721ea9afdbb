"""Removal of repeated passages by longest-previous-factor arrays (operator 3).

Every byte is removed that a string of ``LENGTH`` bytes covers which also starts in a document with a smaller id; the
first copy stays. Matches are judged on the input and never cross documents.

The longest previous factor (LPF) of a suffix is the longest prefix that also starts in an earlier document. In suffix
order it is the larger of the common prefixes with the previous and with the next entry of a smaller document. Bytes
that suffixes with an LPF of at least ``LENGTH`` cover are removed; since only that bound matters, suffixes are sorted,
and factors measured, to a depth of ``LENGTH``, and suffixes shorter than it are left out.

No suffix array of everything is built in one place. Equal strings of LENGTH bytes have the same smallest hash among
their k-mers (their anchor), so the work splits exactly by anchors:

1. Documents are dealt into groups of about two megabytes by a hash of the row. A group sends each anchor it has, once,
   to the anchor's bucket (five bytes each, packed), and gets a bit back: does any other document have it?
2. For anchors that others have, a group sends the runs of windows around them, each distinct text once with its
   smallest and largest document. A bucket builds the LPF array of its texts (see ``longest_previous``). Of a text it
   takes two copies, those of the smallest and the largest document; what holds for the latter holds for all but the
   first, since the first is an earlier match of the whole text. A bit for each window goes back.
3. The group removes what the windows with a long enough LPF cover.

Hot anchors: around a phrase that many documents share, the texts differ at their edges, so all would go to one bucket.
A group that has more than LONGEST_RUN bytes of texts under an anchor says how many; any other counts as LONGEST_RUN. Where
these add up to more than ``HOT`` the bucket answers that the anchor is hot. Its windows then go singly, each distinct one once from a group, with
a hash of all their bytes as anchor: equal windows still meet, and no others need to.

Hot passages are aggregated before each shuffle: a group of documents sends a string once however many of them hold
it. Texts are dealt once; all three steps read the same shuffle.

Defined cases: null text is empty and loses nothing; texts under LENGTH bytes lose nothing; repeated rows share an id,
so neither removes from the other (a hot id is dealt over all groups, equal rows of it by their input partition); a null
doc_id counts as larger than all others; very long texts are taken whole; an empty table gives no rows; other columns
are carried along untouched where documents are returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm.common import bounded_batches, drop_memories

LENGTH, KMER = 50, 24
#: Bytes of text in a group, anchors in a bucket, bytes of text in a bucket: about.
GROUP, ANCHORS, BUCKET = 2 << 20, 1 << 20, 4 << 20
#: Bytes of text under one anchor, of all groups, before its windows are dealt singly. A text under it has at most
#: LONGEST_RUN bytes, but for periodic texts.
HOT, LONGEST_RUN = 1 << 19, 2 * LENGTH - KMER
LAST = (1 << 63) - 1
#: Anchors for each byte of text, about: two for each window of k-mers.
DENSITY = 2 / (LENGTH - KMER + 2)


def kmer_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of the KMER bytes at every position (of fewer at the end, which no window uses)."""
    n = len(raw)
    buf = raw + b"\0" * 32
    word = np.ndarray((n + 16,), "<u8", buf, strides=(1,))
    h = word[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h += word[8 : n + 8]
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h += word[16 : n + 16]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def mixed(h: np.ndarray) -> np.ndarray:
    """Anchors are smallest hashes, so small; this spreads them again."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(30))


class Windows:
    """The windows of a group's texts, as runs with one anchor each."""

    def __init__(self, docs: np.ndarray, texts: list[bytes]):
        self.docs, self.raw = docs, b"".join(texts)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        n = len(self.raw)
        empty = np.zeros(0, dtype=np.int64)
        self.anchor, self.start, self.count, self.owner = np.zeros(0, np.uint64), empty, empty, empty
        self.whole = np.zeros(0, np.uint64)
        if n < LENGTH:
            return
        least = kmer_hashes(self.raw)
        # of LENGTH bytes, from three k-mers that cover them
        self.whole = mixed(mixed(mixed(least[: n - LENGTH + 1]) + least[KMER : n - LENGTH + 1 + KMER]) + least[LENGTH - KMER : n - KMER + 1])
        width, want = 1, LENGTH - KMER + 1
        while 2 * width <= want:
            np.minimum(least[:-width], least[width:], out=least[:-width])
            width *= 2
        if width < want:
            least = np.minimum(least[: n - (want - width)], least[want - width :])
        least = least[: n - LENGTH + 1]
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)[: len(least)]
        inside = np.arange(len(least)) + LENGTH <= self.ends[owner]
        edge = np.ones(len(least), dtype=bool)
        edge[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])
        start = np.flatnonzero(edge)
        count = np.diff(np.append(start, len(least)))
        fine = inside[start]
        self.start, self.count = start[fine], count[fine]
        self.anchor, self.owner = mixed(least[self.start]), owner[self.start]

    def anchors(self, buckets: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By bucket: distinct anchors, ascending, whether more than one document here has each, and the bytes of their
        distinct texts here."""
        if not len(self.anchor):
            return {}
        doc = self.docs[self.owner]
        # a text is known by its first and last window and its length; a clash only makes the bytes count as fewer
        text = mixed(self.whole[self.start] + np.uint64(3) * self.whole[self.start + self.count - 1] + self.count.astype(np.uint64))
        order = np.lexsort((text, self.anchor))
        a, text = self.anchor[order], text[order]
        first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        fresh = np.append(True, (a[1:] != a[:-1]) | (text[1:] != text[:-1]))
        size = np.add.reduceat(np.where(fresh, self.count[order] + LENGTH - 1, 0), first)
        a = a[first]
        several = np.minimum.reduceat(doc[order], first) < np.maximum.reduceat(doc[order], first)
        return {int(b): (a[k], several[k], size[k]) for b, k in by_bucket(bucket_of(a, buckets))}

    def shared(self, known: dict[int, bytes], buckets: int) -> np.ndarray:
        """Runs whose anchor other documents have, by the buckets' answers; those of hot anchors are split first, so that
        each of their windows is a run of its own."""
        yes, hot = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for b, (a, _, _) in self.anchors(buckets).items():
            bits, places = np.split(np.frombuffer(known[b], np.uint8), [-(-len(a) // 8)])
            yes.append(a[np.unpackbits(bits, count=len(a)).astype(bool)])
            hot.append(a[places.view("<u4")])
        keep = np.isin(self.anchor, np.concatenate(yes))
        single = keep & np.isin(self.anchor, np.concatenate(hot))
        if single.any():
            n, s, o = self.count[single], self.start[single], self.owner[single]
            start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(s, n)
            rest = keep & ~single
            self.start, self.count = np.append(self.start[rest], start), np.append(self.count[rest], np.ones_like(start))
            self.anchor, self.owner = np.append(self.anchor[rest], mixed(self.whole[start])), np.append(self.owner[rest], np.repeat(o, n))
            return np.arange(len(self.start))
        return np.flatnonzero(keep)

    def entries(self, runs: np.ndarray) -> tuple[dict[bytes, int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct texts of the runs, the entry of each run, and by entry its smallest document, its largest, and its
        anchor."""
        number: dict[bytes, int] = {}
        raw = self.raw
        s = self.start[runs].tolist()
        e = (self.start[runs] + self.count[runs] + LENGTH - 1).tolist()
        which = np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip(s, e, strict=True)], dtype=np.int64)
        doc = self.docs[self.owner[runs]]
        least, most = np.full(len(number), LAST), np.full(len(number), -LAST)
        np.minimum.at(least, which, doc)
        np.maximum.at(most, which, doc)
        anchor = np.zeros(len(number), np.uint64)
        anchor[which] = self.anchor[runs]
        return number, which, least, most, anchor


def bucket_of(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return ((anchor >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def by_bucket(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(bucket, places) in ascending order, places ascending within each."""
    order = np.argsort(bucket, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)) if len(order) else []
    return [(int(bucket[k[0]]), k) for k in np.split(order, first[1:]) if len(k)]


def suffix_order(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of at least LENGTH bytes of all texts, numbered text by text, in suffix order to that depth, and the
    common prefix (LENGTH at most) of each with the one before it in that order."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    n = sizes - LENGTH + 1
    place = np.arange(n.sum()) + np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(n) - n), n)
    raw = b"".join(texts) + b"\0" * 8
    word = np.ndarray((len(raw) - 7,), ">u8", raw, strides=(1,))
    key = word[place].astype(np.uint64)
    order = np.argsort(key)
    shared = np.zeros(len(order), dtype=np.int64)
    # from the left, eight bytes a round: only suffixes that are equal so far are sorted on
    tied, group = np.arange(len(order)), np.zeros(len(order), dtype=np.int64)
    sub = key[order]
    for depth in range(8, LENGTH + 8, 8):
        differ = sub[1:] ^ sub[:-1]
        equal = np.zeros(len(sub) + 1, dtype=bool)  # with the one before
        within = group[1:] == group[:-1]
        equal[1:-1] = within & (differ == 0)
        apart = np.flatnonzero(within & (differ != 0)) + 1
        if len(apart):  # leading bytes that agree
            byte = differ[apart - 1].astype(">u8").view(np.uint8).reshape(-1, 8)
            shared[tied[apart]] = np.minimum(depth - 8 + np.argmax(byte != 0, axis=1), LENGTH)
        stays = equal[:-1] | equal[1:]
        group = np.cumsum(~equal[:-1])[stays]
        joined = equal[:-1][stays]
        tied = tied[stays]
        if not len(tied):
            break
        if depth >= LENGTH:
            shared[tied[joined]] = LENGTH
            break
        mine = order[tied]
        sub = word[place[mine] + depth].astype(np.uint64)
        if depth + 8 > LENGTH:
            sub &= ~np.uint64((1 << 8 * (depth + 8 - LENGTH)) - 1)
        by = np.lexsort((sub, group))
        order[tied], sub = mine[by], sub[by]
    return order, shared


def smaller_before(value: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """For each entry the common prefix with the nearest one before it that has a smaller value; 0 without one.

    Pointers jump from an entry to the candidate of its candidate, all at once. Where chains are long, a stack, which
    takes each entry once, does the same.
    """
    n = len(value)
    at, least = np.arange(n) - 1, shared.copy()
    active = np.flatnonzero(at >= 0)
    active = active[value[at[active]] >= value[active]]
    for _ in range(64):
        if not len(active):
            break
        q = at[active]
        least[active] = np.minimum(least[active], least[q])
        at[active] = at[q]
        active = active[at[active] >= 0]
        active = active[value[at[active]] >= value[active]]
    else:
        stack: list[tuple[int, int]] = []  # values, ascending, each with the prefix shared with the one below it
        for k, (v, m) in enumerate(zip(value.tolist(), shared.tolist(), strict=True)):
            while stack and stack[-1][0] >= v:
                m = min(m, stack.pop()[1])
            least[k] = m if stack else 0
            stack.append((v, m))
        return least
    least[at < 0] = 0
    return least


def longest_previous(texts: list[bytes], first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """LPF (LENGTH at most) of each suffix of at least LENGTH bytes, text by text: of the text's copy in document
    ``first``, and of its copy in ``last`` (0 where that is the same).

    Both copies stand side by side in suffix order; among all entries the previous and the next of a smaller document
    are found, and the longer of the prefixes shared with these two is the LPF.
    """
    order, shared = suffix_order(texts)
    owner = np.repeat(np.arange(len(texts)), [len(t) - LENGTH + 1 for t in texts])[order]
    copies = 1 + (last > first)[owner]
    entry = np.repeat(np.arange(len(order)), copies)
    second = np.append(False, entry[1:] == entry[:-1])
    doc = np.where(second, last[owner[entry]], first[owner[entry]])
    doc = np.unique(doc, return_inverse=True)[1].astype(np.int32)
    shared = np.where(second, LENGTH, shared[entry])
    before = smaller_before(doc, shared)
    after = smaller_before(doc[::-1], np.append(0, shared[:0:-1]))[::-1]
    found = np.maximum(before, after)
    out = np.zeros((2, len(order)), dtype=np.int64)
    out[second.astype(np.int64), order[entry]] = found
    return out[0], out[1]


def bucket_answers(firsts: list[np.ndarray], lasts: list[np.ndarray], anchors: list[np.ndarray], texts: list[list[bytes]]) -> list[bytes]:
    """For each message a bit for each window of its texts, is its LPF at least LENGTH: of the copies in the documents
    ``firsts``, and then of those in ``lasts`` where these differ."""
    least: dict[bytes, int] = {}
    most: dict[bytes, int] = {}
    anchor_of: dict[bytes, int] = {}
    for ds, es, an, ts in zip(firsts, lasts, anchors, texts, strict=True):
        for d, e, a, t in zip(ds.tolist(), es.tolist(), an.tolist(), ts, strict=True):
            if (seen := least.get(t)) is None:
                least[t], most[t], anchor_of[t] = d, e, a
            else:
                if d < seen:
                    least[t] = d
                if e > most[t]:
                    most[t] = e
    every = sorted(anchor_of, key=anchor_of.__getitem__)
    found: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
    at = 0
    while at < len(every):
        end, size = at, 0
        while end < len(every) and (size < BUCKET or anchor_of[every[end]] == anchor_of[every[end - 1]]):
            size += len(every[end])
            end += 1
        part = every[at:end]
        lpf = longest_previous(part, np.array([least[t] for t in part]), np.array([most[t] for t in part]))
        cut = np.cumsum([len(t) - LENGTH + 1 for t in part])[:-1]
        found.update(zip(part, zip(*(np.split(x >= LENGTH, cut) for x in lpf), strict=True), strict=True))
        at = end
    out = []
    for ds, es, ts in zip(firsts, lasts, texts, strict=True):
        bits = [found[t][d > least[t]] for d, t in zip(ds.tolist(), ts, strict=True)]
        bits += [found[t][1] for d, e, t in zip(ds.tolist(), es.tolist(), ts, strict=True) if e > d]
        out.append(np.packbits(np.concatenate(bits)).tobytes() if bits else b"")
    return out


ASK = pa.schema([("b", pa.int64()), ("g", pa.int64()), ("anchors", pa.binary()), ("several", pa.binary()), ("places", pa.binary()), ("bytes", pa.binary())])
RUNS = pa.schema([("b", pa.int64()), ("g", pa.int64()), ("first", pa.binary()), ("last", pa.binary()), ("anchors", pa.binary()), ("sizes", pa.binary()), ("text", pa.binary())])
BITS = pa.schema([("g", pa.int64()), ("b", pa.int64()), ("bits", pa.binary())])
BITS_DDL = "g long, b long, bits binary"


def rows(schema: pa.Schema, values: list[tuple]) -> pa.Table:
    cols = list(zip(*values, strict=True)) or [[] for _ in schema]
    return pa.table([pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def windows_of(t: pa.Table) -> Windows:
    """Of a group's table; its rows in the order of id, then text, so that each step numbers them alike."""
    drop_memories()
    raws = [(x or "").encode() for x in t.column("_text").to_pylist()]
    docs = np.array([LAST if d is None else d for d in t.column("_doc").to_pylist()], dtype=np.int64)
    order = sorted(range(len(raws)), key=lambda i: (docs[i], raws[i]))
    w = Windows(docs[order], [raws[i] for i in order])
    w.order = order
    return w


def answers(t: pa.Table) -> dict[int, bytes]:
    return dict(zip(t.column("b").to_pylist(), t.column("bits").to_pylist(), strict=True))


def covered(w: Windows, first: dict[int, bytes], second: dict[int, bytes], buckets: tuple[int, int]) -> np.ndarray:
    """By byte of the group's text: whether it goes."""
    n = len(w.raw)
    runs = w.shared(first, buckets[0])
    delta = np.zeros(n + 1, dtype=np.int32)
    if len(runs):
        _, which, least, most, anchor = w.entries(runs)
        counts = np.zeros(len(least), dtype=np.int64)
        counts[which] = w.count[runs]
        bits: list = [None] * len(least)
        later: list = [None] * len(least)
        for b, places in by_bucket(bucket_of(anchor, buckets[1])):
            again = places[most[places] > least[places]]
            both = np.append(counts[places], counts[again])
            flat = np.unpackbits(np.frombuffer(second[b], np.uint8), count=int(both.sum())).astype(bool)
            for k, piece in enumerate(np.split(flat, np.cumsum(both)[:-1])):
                if k < len(places):
                    bits[places[k]] = piece
                else:
                    later[again[k - len(places)]] = piece
        is_later = w.docs[w.owner[runs]] > least[which]
        flat = np.concatenate([later[e] if x else bits[e] for e, x in zip(which.tolist(), is_later.tolist(), strict=True)])
        own = np.repeat(np.arange(len(runs)), w.count[runs])
        place = np.arange(len(own)) - np.repeat(np.cumsum(w.count[runs]) - w.count[runs], w.count[runs]) + w.start[runs][own]
        delta += np.bincount(place[flat], minlength=n + 1).astype(np.int32)
        delta -= np.bincount(place[flat] + LENGTH, minlength=n + 1).astype(np.int32)
    return np.cumsum(delta[:n]) > 0


def messages(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, tuple[int, int]]:
    """The first step and half of the second: the dealt texts, the answers about anchors, the texts sent to buckets, and
    the numbers of buckets of both steps."""
    bounded_batches(docs.sparkSession)
    other = [c for c in docs.columns if c not in ("doc_id", "text")]
    each = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.coalesce("text", F.lit("")).alias("_text"),
                       (F.struct(*other) if other else F.lit(None).cast("string")).alias("_rest"))
    total = each.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    n_groups = max(1, -(-total // GROUP))
    buckets = (max(1, int(total * DENSITY / ANCHORS)), max(1, -(-total * LENGTH // (10 * BUCKET))))
    dealt = each.withColumn("g", F.pmod(F.xxhash64("_doc", "_text", F.spark_partition_id()), F.lit(n_groups)).cast("long"))
    most = HOT

    def ask(t: pa.Table) -> pa.Table:
        g = t.column("g")[0].as_py()
        out = []
        for b, (a, s, size) in windows_of(t).anchors(buckets[0]).items():
            large = np.flatnonzero(size > LONGEST_RUN)
            out.append((b, g, np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes(), np.packbits(s).tobytes(),
                        large.astype("<u4").tobytes(), size[large].astype("<i8").tobytes()))
        return rows(ASK, out)

    def tell(t: pa.Table) -> pa.Table:
        b = t.column("b")[0].as_py()
        cut = []
        for raw in t.column("anchors").to_pylist():
            a = np.zeros((len(raw) // 5, 8), np.uint8)
            a[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
            cut.append(a.view("<u8").ravel())
        every = np.concatenate(cut)
        several = np.concatenate([np.unpackbits(np.frombuffer(s, np.uint8), count=len(c)) for s, c in zip(t.column("several").to_pylist(), cut, strict=True)])
        _, which, n = np.unique(every, return_inverse=True, return_counts=True)
        yes = (n > 1) | (np.bincount(which, weights=several, minlength=len(n)) > 0)
        ends = np.cumsum([len(c) for c in cut])
        large = np.concatenate([np.frombuffer(p, "<u4") + e - len(c) for p, e, c in zip(t.column("places").to_pylist(), ends, cut, strict=True)]).astype(np.int64)
        size = np.concatenate([np.frombuffer(x, "<i8") for x in t.column("bytes").to_pylist()])
        under = LONGEST_RUN * n + np.bincount(which[large], weights=size - LONGEST_RUN, minlength=len(n))
        hot = yes & (under > most)
        return rows(BITS, [(g, b, np.packbits(y).tobytes() + np.flatnonzero(h).astype("<u4").tobytes())
                           for g, y, h in zip(t.column("g").to_pylist(), np.split(yes[which], ends[:-1]), np.split(hot[which], ends[:-1]), strict=True)])

    def send(t: pa.Table, known: pa.Table) -> pa.Table:
        if not t.num_rows:
            return rows(RUNS, [])
        g, w = t.column("g")[0].as_py(), windows_of(t)
        number, _, least, most, anchor = w.entries(w.shared(answers(known), buckets[0]))
        texts = list(number)
        return rows(RUNS, [(b, g, least[k].astype("<i8").tobytes(), most[k].astype("<i8").tobytes(), anchor[k].astype("<u8").tobytes(), np.array([len(texts[i]) for i in k], "<u4").tobytes(),
                            b"".join([texts[i] for i in k])) for b, k in by_bucket(bucket_of(anchor, buckets[1]))])

    asked = dealt.groupBy("g").applyInArrow(ask, "b long, g long, anchors binary, several binary, places binary, bytes binary")
    told = asked.groupBy("b").applyInArrow(tell, BITS_DDL)
    sent = dealt.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(send, "b long, g long, first binary, last binary, anchors binary, sizes binary, text binary")
    return dealt, told, sent, buckets


def exchange(docs: DataFrame, finish: Callable, schema: T.StructType) -> DataFrame:
    """The three steps; ``finish`` turns a group's table and its bytes to remove into rows."""
    dealt, told, sent, buckets = messages(docs)

    def match(t: pa.Table) -> pa.Table:
        b, groups = t.column("b")[0].as_py(), t.column("g").to_pylist()
        first, last = ([np.frombuffer(x, "<i8") for x in t.column(c).to_pylist()] for c in ("first", "last"))
        anchors = [np.frombuffer(x, "<u8") for x in t.column("anchors").to_pylist()]
        texts = []
        for x, sizes in zip(t.column("text").to_pylist(), t.column("sizes").to_pylist(), strict=True):
            ends = np.cumsum(np.frombuffer(sizes, "<u4").astype(np.int64)).tolist()
            texts.append([x[s:e] for s, e in zip([0, *ends], ends, strict=False)])
        return rows(BITS, [(g, b, bits) for g, bits in zip(groups, bucket_answers(first, last, anchors, texts), strict=True)])

    def end(t: pa.Table, known: pa.Table) -> pa.Table:
        w = windows_of(t)
        is_last = np.array(known.column("step").to_pylist()) == 2 if known.num_rows else np.zeros(0, bool)
        first, second = (answers(known.filter(pa.array(m))) if known.num_rows else {} for m in (~is_last, is_last))
        return finish(t, w, covered(w, first, second, buckets))

    matched = sent.groupBy("b").applyInArrow(match, BITS_DDL)
    both = told.withColumn("step", F.lit(1)).unionByName(matched.withColumn("step", F.lit(2)))
    return dealt.groupBy("g").cogroup(both.groupBy("g")).applyInArrow(end, schema)


def parts(w: Windows, gone: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    """(bytes, removed, spans, kept) of each of the group's texts, in its order."""
    out = []
    raw = np.frombuffer(w.raw, np.uint8)
    for s, e in zip(w.begins.tolist(), w.ends.tolist(), strict=True):
        g = gone[s:e]
        n = int(g.sum())
        spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()) if n else 0
        out.append((e - s, n, spans, raw[s:e][~g].tobytes() if n else w.raw[s:e]))
    return out


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def removed_digests(docs: DataFrame) -> DataFrame:
    """Counts and the digest of what is kept, for each row."""

    def finish(t: pa.Table, w: Windows, gone: np.ndarray) -> pa.Table:
        ids = t.column("_doc").to_pylist()
        return rows(DIGEST, [(ids[i], n, r, s, hashlib.sha256(kept).hexdigest()) for i, (n, r, s, kept) in zip(w.order, parts(w, gone), strict=True)])

    schema = T.StructType([T.StructField(n, T.StringType() if n == "kept_sha256" else T.LongType()) for n in DIGEST.names])
    return exchange(docs.select("doc_id", "text"), finish, schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``; bytes of a character cut in part go too. ``n_chars``, where
    there is one, is counted anew. Rows stay even if nothing is left of their text."""
    names = docs.columns
    mid = T.StructType([T.StructField("_doc", T.LongType()), T.StructField("_text", T.StringType()),
                        T.StructField("_rest", T.StructType([f for f in docs.schema if f.name not in ("doc_id", "text")]) if len(names) > 2 else T.StringType())])

    def finish(t: pa.Table, w: Windows, gone: np.ndarray) -> pa.Table:
        kept = [p[3].decode(errors="ignore") for p in parts(w, gone)]
        order = pa.array(w.order, pa.int64())
        return pa.table({"_doc": t.column("_doc").take(order), "_text": pa.array(kept, pa.string()), "_rest": t.column("_rest").take(order)})

    out = exchange(docs, finish, mid)
    pick = {"doc_id": F.col("_doc").cast(docs.schema["doc_id"].dataType), "text": F.col("_text")}
    if "n_chars" in names:
        pick["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    return out.select(*(pick[c].alias(c) if c in pick else F.col("_rest").getField(c).alias(c) for c in names))
