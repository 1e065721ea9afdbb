"""Near-duplicate documents by SimHash and meet-in-the-middle ball hashing (operator 10).

Fingerprints at most three bits apart are linked. Of at most three differing bits at most one lies in one of the
two halves of the fingerprint. So every distinct fingerprint emits, for both halves, all variants of the half within
half the radius (one bit); the shuffle is on the variants, and pairs that meet are deduplicated and verified on all
64 bits. Two halves one bit apart differ in parity, so it suffices that halves of even parity emit their one-bit
variants and all emit themselves: 1 + 32 or 1 rows a half, against 2081 for balls of two bits on whole fingerprints.

Hot groups: exact copies become one fingerprint before anything else. Within a variant's group no list of all pairs
is made: members are compared in blocks of bits, and only links that join two parts of the group are emitted (at
most one less than its fingerprints). A group of more than ``HOT`` fingerprints is split beforehand by the quarters
of the other half, as further variants in the shuffle.

Components come from links between distinct fingerprints by star contraction, with checkpoints in the shared folder.

Defined cases: null and empty texts have the fingerprint zero, linked like any other; repeated rows are repeated in
the result; an empty table gives no rows; a null doc_id keeps its row but can name no component other than null;
texts are taken whole. Where one document of each group is kept, documents are rows: see ``first_of_group``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import as_batch, drop_memories, forget, pieces, shared_dir, stored, stored_at, texts

RADIUS, WORDS, SEED = 3, 3, 42
#: Fingerprints that meet in one variant before the group is split by further variants.
HOT = 5_000


def fingerprint(text: str, words: int = WORDS) -> int:
    """64-bit SimHash of a text's word shingles; zero for a text without words."""
    w = text.encode().lower().split()
    if not w:
        return 0
    hash_ = xxhash.xxh64_digest
    if len(w) < words:
        digests = hash_(b" ".join(w), SEED)
    else:
        join = b" ".join
        digests = b"".join([hash_(join(s), SEED) for s in zip(*(w[i:] for i in range(words)), strict=False)])
    n = len(digests) // 8
    counts = np.zeros(64, dtype=np.int64)
    raw = np.frombuffer(digests, np.uint8).reshape(n, 8)
    for i in range(0, n, 4096):
        counts += np.unpackbits(raw[i : i + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS, *more: str) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed long, and ``more`` columns of longs as they are."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "fp", *more)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_memories()
        for b in batches:
            for p in pieces(b):
                fp = np.array([fingerprint(t, words) for t in p.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
                yield as_batch({"doc_id": p.column("doc_id"), "fp": fp} | {c: p.column(c) for c in more}, schema)

    return texts(docs, *more).mapInArrow(run, ", ".join(f"{n} long" for n in schema.names))


def variants(half: Column, width: int) -> Column:
    """Array: the bits, and for even parity all that differ from them in one bit."""
    flips = F.array(*(F.lit(1 << i).cast("long") for i in range(width)))
    ball = F.concat(F.array(half), F.transform(flips, lambda b: half.bitwiseXOR(b)))
    return F.when(F.bit_count(half) % 2 == 0, ball).otherwise(F.array(half))


def emitted(fps: DataFrame) -> DataFrame:
    """``fp``, ``part`` (which half), ``key`` (variant of that half)."""
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    out = None
    for part, half in enumerate((high, low)):
        one = fps.select("fp", F.lit(part).alias("part"), F.explode(variants(half, 32)).alias("key"))
        out = one if out is None else out.unionByName(one)
    return out


def links_within(fp: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the parts of one group: all pairs are compared, in blocks, but of those that are near only
    as many are given as join two parts. A group has at most HOT members, or few after the split."""
    n = len(fp)
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out: list[tuple[int, int]] = []
    block = 2048
    for i in range(0, n, block):
        a = fp[i : i + block]
        for j in range(i, n, block):
            near = np.bitwise_count(a[:, None] ^ fp[None, j : j + block]) <= RADIUS
            if i == j:
                near = np.triu(near, 1)
            left, right = np.nonzero(near)
            if len(left) > 4 * block:  # a first link for each row and column joins most; the rest is then mostly within parts
                first = np.r_[np.unique(left, return_index=True)[1], np.unique(right, return_index=True)[1]]
                order = np.r_[first, np.setdiff1d(np.arange(len(left)), first)]
                left, right = left[order], right[order]
                done = 2 * block
            else:
                done = len(left)
            for x, y in zip(left[:done] + i, right[:done] + j, strict=True):
                p, q = root(x), root(y)
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    out.append((int(fp[x]), int(fp[y])))
            if done < len(left):
                roots = np.array([root(k) for k in range(n)])
                x, y = left[done:] + i, right[done:] + j
                keep = roots[x] != roots[y]
                for u, v in zip(x[keep], y[keep], strict=True):
                    p, q = root(u), root(v)
                    if p != q:
                        parent[max(p, q)] = min(p, q)
                        out.append((int(fp[u]), int(fp[v])))
    return out


def links(fps: DataFrame) -> DataFrame:
    """Verified links ``a`` < ``b`` between distinct fingerprints that span every component; none is between parts
    that RADIUS doesn't join."""
    first = emitted(fps)
    hot = first.groupBy("part", "key").count().where(F.col("count") > HOT).select("part", "key", F.lit(True).alias("hot"))
    met = first.join(hot, ["part", "key"], "left")
    other = F.when(F.col("part") == 0, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32))

    def quarter(number: int, bits: Column) -> Column:
        return F.transform(variants(bits, 16), lambda v: F.struct(F.lit(number).alias("sub"), v.alias("more")))

    # the half that isn't the key differs in at most three bits, so one of its quarters in at most one
    quarters = [quarter(1, F.shiftrightunsigned(other, 16)), quarter(2, other.bitwiseAND(F.lit(0xFFFF)))]
    whole = F.array(F.struct(F.lit(0).alias("sub"), F.lit(0).cast("long").alias("more")))
    met = met.withColumn("split", F.explode(F.when(F.col("hot"), F.concat(*quarters)).otherwise(whole)))
    met = met.select("fp", "part", "key", "split.sub", "split.more")
    keys = ["part", "key", "sub", "more"]
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: set[tuple[int, int]] = set()
            for members in b.column("fps").to_pylist():
                for x, y in links_within(np.array(sorted(members), dtype=np.int64).view(np.uint64)):
                    found.add((x, y))
            if found:
                a, c = (np.array(v, dtype=np.uint64).view(np.int64) for v in zip(*found, strict=True))
                yield as_batch({"a": np.minimum(a, c), "b": np.maximum(a, c)}, schema)

    # most variants are met by one fingerprint alone: these groups go before any reaches Python
    groups = met.groupBy(*keys).agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1).select("fps")
    return groups.mapInArrow(verify, "a long, b long").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) for all nodes with an edge, by large- and small-star steps. An
    error where they still change after ``rounds``."""
    shared_dir(edges.sparkSession)
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e, path = stored_at(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("u"), "v")
        down = large.where("u <> v").distinct()
        least = down.groupBy("v").agg(F.min("u").alias("m"))
        small = down.join(least, "v").select(F.col("m").alias("x"), "u", "v")
        small = small.select(F.col("x").alias("u"), F.explode(F.array("u", "v")).alias("v")).where("u <> v").distinct()
        old = path
        e, path = stored_at(small, "edges")
        forget(e.sparkSession, old)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    return e.groupBy("v").agg(F.min("u").alias("root")).select(F.col("v").alias("node"), "root")


def rooted(firsts: DataFrame) -> DataFrame:
    """``firsts`` (fp, first), one row for each fingerprint, with the ``root`` of its component."""
    roots = components(links(firsts.select("fp")))
    return firsts.join(roots, firsts["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def groups(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id``, ``fingerprint`` (hex) and ``component_id`` (smallest reachable doc_id) of every row."""
    each = stored(fingerprints(docs, words), "fingerprints")
    # components of fingerprints, then the smallest document of each
    named = rooted(each.groupBy("fp").agg(F.min("doc_id").alias("first")))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = named.join(least, "root").select("fp", "component_id")
    return each.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_group(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Exactly one row of ``docs`` for each group of near duplicates: that of the smallest doc_id, one with a null id only
    where all ids of the group are null. Rows are told apart by a number that is stored with them, so of repeated rows one
    stays, a repeated id with two texts counts as two documents, and a null id is no reason to go."""
    numbered = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc")), "numbered")
    each = stored(fingerprints(numbered.select("doc.doc_id", "doc.text", "row"), words, "row"), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    named = rooted(each.groupBy("fp").agg(F.min(first).alias("first")))
    keep = named.groupBy("root").agg(F.min("first").alias("first")).select("first.row")
    return numbered.join(keep, "row", "left_semi").select("doc.*")
