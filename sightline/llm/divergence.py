"""Audit of how far the sources of a language diverge in their words (operator 11).

Tokens come from a translate table: ``bytes.translate`` lowers A to Z and turns each other byte below 0x80 that is no
letter into a blank, in one pass; ``bytes.split`` cuts at the blanks and a Counter for each document gives its terms and
their occurrences. A task adds the Counters up by language, source and term, and gives the sums out whenever it holds
``HELD`` entries, so its memory is bounded and a frequent word costs a row a task, not a row a document. One shuffle on
(language, term) then brings all counts of a term together, from which its documents in the language, its occurrences
there and those in each source follow.

Smoothed shares are whole numbers, p = 1 + floor(10^9 (count + 5) / (N + 5 V)), worked out in decimals of 38 digits.
Distances of sources are sums over all kept terms of |p - q|. Terms are dealt into blocks, so that terms times sources of
a block stay bounded; a block's table of shares gives partial sums for all its sources, and these are added up.
Beyond ``TILE`` sources of a language a block goes to several tasks, each with its share of the sources on the left.

Defined cases: null text, lang and source count as ''; each row is a document, repeated rows and null ids too; a group
without terms has its pairs (0 where the language keeps no term) and no terms; an empty table gives no rows; a very long
text is split in pieces of ``PIECE`` bytes, whole terms each, and its Counter grows with its distinct terms alone;
further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import as_batch, bounded_batches, drop_memories, pieces, stored

#: Documents of a language that a kept term occurs in, at least; what is added to each count; terms listed of a group.
LEAST, PRIOR, TOP = 30, 5, 50
#: Entries of a task's sums; cells of a block's table, at least and at most (between them eight for each pair of sources,
#: so that sums of blocks are fewer than what they sum); sources on a table's left; bytes split at once.
HELD, CELLS, MOST_CELLS, TILE, PIECE = 300_000, 1 << 16, 1 << 22, 256, 1 << 20
SCALE = 1_000_000_000

TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def counted(text: bytes) -> Counter:
    """Terms of one document with their occurrences."""
    out: Counter = Counter()
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and TABLE[text[end]] != 32:  # a piece ends where a term does
            end += 1
        out.update(text[at:end].translate(TABLE).split())
        at = end
    return out


COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("n", pa.int64())])


def term_counts(docs: DataFrame, held: int = HELD) -> DataFrame:
    """``lang, source, term, docs, n``: sums of one task each; the empty term counts a group's documents."""

    def sums(groups: dict[tuple[str, str], tuple[Counter, Counter]]) -> pa.RecordBatch:
        columns: dict[str, list] = {name: [] for name in COUNTS.names}
        for (lang, source), (within, times) in groups.items():
            columns["lang"] += [lang] * len(within)
            columns["source"] += [source] * len(within)
            columns["term"] += within
            columns["docs"] += within.values()
            columns["n"] += [times[t] for t in within]
        return as_batch(columns, COUNTS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_memories()
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for b in batches:
            for p in pieces(b):
                for lang, source, text in zip(p.column("lang").to_pylist(), p.column("source").to_pylist(), p.column("text").to_pylist(), strict=True):
                    found = counted(text)
                    within, times = groups.setdefault((lang, source), (Counter(), Counter()))
                    size -= len(within)
                    within.update(found.keys())
                    within[b""] += 1
                    times.update(found)
                    size += len(within)
                    if size > held:
                        yield sums(groups)
                        groups, size = {}, 0
        if groups:
            yield sums(groups)

    bounded_batches(docs.sparkSession)
    read = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return read.mapInArrow(run, "lang string, source string, term string, docs long, n long")


def kept_terms(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``lang, source, term, n, lang_n, first``: kept terms of each group where they occur, and the empty term for each
    group. ``first`` marks one row of each term of a language."""
    term = Window.partitionBy("lang", "term")
    sums = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    return (sums.select("lang", "source", "term", "n", F.sum("docs").over(term).alias("lang_docs"), F.sum("n").over(term).alias("lang_n"),
                        (F.min("source").over(term) == F.col("source")).alias("first"))
            .where((F.col("term") == "") | (F.col("lang_docs") >= least)).drop("lang_docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (count + PRIOR) / (total + PRIOR terms)), exact; null where there are no terms."""
    above = (count + PRIOR).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = F.nullif(total + PRIOR * terms, F.lit(0)).cast("decimal(20,0)")
    return (F.lit(1) + F.call_function("div", above, below)).cast("long")


def groups_of(kept: DataFrame) -> DataFrame:
    """``lang, source, k, total, lang_total, terms, sources, none``: of each group its number in the language, its
    occurrences and the language's, the language's kept terms and sources, and the share of a term it doesn't have."""
    real = F.col("term") != ""
    own = kept.groupBy("lang", "source").agg(F.coalesce(F.sum(F.when(real, F.col("n"))), F.lit(0)).alias("total"), F.count_if(real & F.col("first")).alias("firsts"))
    lang = Window.partitionBy("lang")
    out = own.select("lang", "source", (F.row_number().over(lang.orderBy("source")) - 1).alias("k"), "total", F.sum("total").over(lang).alias("lang_total"),
                     F.sum("firsts").over(lang).alias("terms"), F.count("*").over(lang).alias("sources"))
    return out.withColumn("none", F.coalesce(share(F.lit(0), F.col("total"), F.col("terms")), F.lit(0)))


PAIRS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def distances(key: tuple, entries: pa.Table, frame: pa.Table) -> pa.Table:
    """Sums of |p - q| over the terms of a block, for the sources of a tile with all others of the language."""
    lang, _, tile = (k.as_py() for k in key)
    names = pa.array([s["source"] for s in frame.column("all")[0].as_py()], pa.string())
    none = np.array([s["none"] for s in frame.column("all")[0].as_py()], dtype=np.int64)
    number = len(names)
    mine = np.arange(tile * TILE, min((tile + 1) * TILE, number))
    value = np.zeros((len(mine), number), dtype=np.int64)
    if entries.num_rows:
        term = entries.column("term").combine_chunks().dictionary_encode()
        shares = np.tile(none, (len(term.dictionary), 1))
        shares[term.indices.to_numpy(), entries.column("k").to_numpy()] = entries.column("p").to_numpy()
        for i, a in enumerate(mine):
            value[i] = np.abs(shares - shares[:, a : a + 1]).sum(axis=0)
    left, right = np.repeat(mine, number), np.tile(np.arange(number), len(mine))
    other = left != right
    return pa.table([pa.repeat(pa.scalar(lang, pa.string()), int(other.sum())), names.take(pa.array(left[other])), names.take(pa.array(right[other])), value.ravel()[other]], schema=PAIRS)


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP, cells: int = CELLS) -> DataFrame:
    """``lang, source, part, item, value, rank``: distances of each source to the others of its language (part ``pair``)
    and the ``top`` terms it has more of than the language (part ``term``)."""
    kept = stored(kept_terms(docs, least), "terms")
    groups = stored(groups_of(kept), "sources")
    known = kept.where("term <> ''").join(groups, ["lang", "source"])
    known = known.withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    q = share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    more = known.select("lang", "source", F.col("term").alias("item"), (F.col("p") - q).alias("value")).where("value > 0")
    more = more.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    table = F.least(F.greatest(F.lit(cells), 8 * F.col("sources") * F.col("sources")), F.lit(MOST_CELLS))
    blocks = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("terms") * F.col("sources") / table))
    tiles = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("sources") - 1) / TILE))).alias("tile")
    entries = known.select("lang", F.pmod(F.xxhash64("term"), blocks).alias("block"), tiles, "k", "term", "p")
    frame = (groups.groupBy("lang").agg(F.max("terms").alias("terms"), F.max("sources").alias("sources"), F.array_sort(F.collect_list(F.struct("k", "source", "none"))).alias("all"))
             .select("lang", "sources", "all", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block")).select("lang", "block", tiles, "all"))
    keys = ["lang", "block", "tile"]
    pairs = (entries.groupBy(*keys).cogroup(frame.groupBy(*keys)).applyInArrow(distances, "lang string, source string, item string, value long")
             .groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(ranked)))
    out = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*out).unionByName(more.withColumn("part", F.lit("term")).select(*out))
