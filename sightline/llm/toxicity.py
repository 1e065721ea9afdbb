"""Toxicity by a weighted lexicon matched with an Aho-Corasick automaton (operator 8).

Texts are folded first: lower case, accents of Latin letters off only where they disguise ASCII words (homoglyphs of
other scripts), digits and signs between letters read as the letters they stand for. Folded words are joined by
single spaces, so a lexicon entry " idiot " is a whole word and " prefix" the beginning of one.

The lexicon is learned from a bounded, documented number of labelled rows (``per_class`` of each label): words and
word beginnings that many more toxic than other texts hold, weighted by their log odds. Phrases of two words that
hold a lexicon word but occur in texts not marked toxic become exceptions: a match inside one doesn't count.
The score is logistic in the matched weight and in that weight for each hundred words (length normalisation).
Texts stay in Spark's tasks, whatever their length: they are folded there, entries and phrases are counted by
aggregation, and the driver gets entries that many toxic texts hold, exceptions, and two numbers for each row.

Defined cases: null and empty texts have no match and the lowest score; very long texts are matched whole; repeated
rows are scored each; labels that are null, or whose document is missing, teach nothing; without labels of both
kinds nothing can be learned, and every score is 0; further columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import as_batch, drop_memories, forget, pieces, sample_labelled, stored_at, texts

THRESHOLD = 0.7
#: Labelled rows of each kind that the lexicon is learned from, at most.
PER_CLASS = 3_000
#: Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans("аеорсухіјѕԁһкмтвнгԛԝοαεικνρτυχßɑɡıʟѵӏ", "aeopcyxijsdhkmtbhrqwoaeiknptuxßagilvl")
#: Digits and signs that stand for letters inside words.
LEET = str.maketrans("013457@$!|", "oieastasil")
DISGUISED = re.compile(r".*(?:[^\W\d_][\d@$|!]+[^\W_]|[\d@$|!][^\W\d_])")
HIDDEN = re.compile("[\u200b-\u200f\u00ad\u2060\ufe00-\ufe0f]")
BREAK = regex.compile(r"[^\p{L}\p{M}\p{N}]")
#: Where all characters are below U+0250, signs become spaces by this table.
SPACES = {c: " " for c in range(0x250) if not (chr(c).isalnum())}
WIDE = re.compile("[^\\x00-\u024f]|\u00ad")
SIGN = re.compile(r"[\d@$|]|!\w")


def fold(text: str) -> str:
    """Folded words with one space before, between and after them."""
    wide = not text.isascii() and WIDE.search(text) is not None
    if wide:
        text = unicodedata.normalize("NFKC", HIDDEN.sub("", text)).lower().translate(LOOKALIKES)
    else:
        text = text.lower()
    if SIGN.search(text):
        text = " ".join([w.translate(LEET) if not w.isalpha() and DISGUISED.match(w) else w for w in text.split()])
    text = BREAK.sub(" ", text) if wide else text.translate(SPACES)
    return f" {' '.join(text.split())} "


@dataclass
class Lexicon:
    """Entries with their weights, exception phrases, and the coefficients of the score."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    bias: float = -8.0
    total: float = 0.0
    density: float = 0.0

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.weights:
            return None
        a = ahocorasick.Automaton()
        for entry, w in self.weights.items():
            a.add_word(entry, (entry, w))
        for phrase in self.exceptions:
            a.add_word(phrase, (phrase, None))
        a.make_automaton()
        return a

    def matched(self, automaton: ahocorasick.Automaton | None, folded: str) -> tuple[float, int]:
        """Weight matched outside exceptions, and the words of the text. Of the entries that begin at one word
        the heaviest counts."""
        if automaton is None:
            return 0.0, folded.count(" ") - 1
        at: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (entry, w) in automaton.iter(folded):
            start = end - len(entry) + 1
            if w is None:
                spared.append((start, end))
            elif w > at.get(start, 0.0):
                at[start] = w
        if spared:  # both in the order of their starts, so that each is looked at once
            spared.sort()
            reach, j = -1, 0
            for s in sorted(at):
                while j < len(spared) and spared[j][0] <= s:
                    reach = max(reach, spared[j][1])
                    j += 1
                if s < reach:
                    del at[s]
        return sum(w for _, w in sorted(at.items())), max(0, folded.count(" ") - 1)

    def score(self, weight: float, words: int) -> float:
        if not self.total and not self.density:
            return 0.0
        z = self.bias + self.total * math.log1p(weight) + self.density * math.log1p(100 * weight / max(words, 1))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def entries_of(folded: str) -> set[str]:
    """Whole words and beginnings (4 to 7 letters of longer words) as lexicon entries."""
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:n]}" for n in range(4, min(8, len(w))))
    return out


def marks_of(folded: str) -> set[int]:
    """Hashes of a quarter of the text's shingles of five words, to know copies by."""
    w = folded.split()
    found = {xxhash.xxh64_intdigest(" ".join(s)) for s in zip(w, w[1:], w[2:], w[3:], w[4:], strict=False)}
    return {(h >> 2) - (1 << 61) for h in found if not h % 4}


def phrases_of(folded: str, automaton: ahocorasick.Automaton) -> Iterator[str]:
    """Each match with the word before it and with the word after it."""
    for end, (entry, _) in automaton.iter(folded):
        start = end - len(entry) + 1
        before = folded.rfind(" ", 0, start)
        stop = folded.find(" ", start + 1)
        after = folded.find(" ", stop + 1)
        yield from {folded[a : z + 1] for a, z in ((before, stop), (start, after)) if a >= 0 and z > 0}


def chosen(candidates: dict[str, tuple[list[int], int]], n1: int, n0: int, least: int) -> dict[str, float]:
    """Entries with their log odds out of candidates (toxic rows that hold each, number of other rows), greedily: what
    covers toxic rows that earlier entries don't; chance entries cover few anew."""
    odds = {e: math.log(len(held) / n1) - math.log((clean + 1) / n0) for e, (held, clean) in candidates.items()}
    best: dict[str, float] = {}
    beginnings: set[str] = set()
    longer: dict[str, set[int]] = {}  # rows of chosen entries, by their own beginnings
    covered: set[int] = set()
    many = max(least, n1 // 60)
    for e in sorted(candidates, key=lambda e: (10 * candidates[e][1] * n1 / n0 - len(candidates[e][0]), -len(e), e)):
        held = candidates[e][0]
        if any(e[:n] in beginnings for n in range(5, len(e) + 1)):
            continue
        if e in longer and sum(k not in longer[e] for k in held) < many:
            continue
        if len(held) >= many or sum(k not in covered for k in held) >= least:
            best[e] = min(odds[e], 8.0)
            covered.update(held)
            if not e.endswith(" "):
                beginnings.add(e)
            for n in range(5, len(e)):
                longer.setdefault(e[:n], set()).update(held)
    return best


def fitted(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Newton steps of a ridge logistic regression with both labels of equal weight."""
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    c, a = np.zeros(3), np.c_[np.ones(len(x)), x]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ c, -30, 30)))
        g = a.T @ (weight * (p - y)) + 1e-4 * c
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-4 * np.eye(3)
        step = np.linalg.solve(h, g)
        c -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in c)


FEATURES = pa.schema([("doc_id", pa.int64()), ("y", pa.int64()), ("folded", pa.string()), ("entries", pa.list_(pa.string())), ("marks", pa.list_(pa.int64()))])


def featured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folded texts with their entries and marks."""
    drop_memories()
    for b in batches:
        for p in pieces(b, 1 << 20):
            folded = [fold(t) for t in p.column("text").to_pylist()]
            yield as_batch({"doc_id": p.column("doc_id"), "y": p.column("y"), "folded": folded, "entries": [sorted(entries_of(f)) for f in folded],
                            "marks": [sorted(marks_of(f)) for f in folded]}, FEATURES)


def fresh(rows: DataFrame) -> DataFrame:
    """Rows without those of whose marks rows of smaller ids hold 0.3 or more: copies would lend weight to chance words."""
    mark = rows.select("doc_id", F.explode("marks").alias("mark"))
    first = mark.groupBy("mark").agg(F.min("doc_id").alias("first"))
    copies = (mark.join(first, "mark").groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("first") < F.col("doc_id")).alias("again"))
              .where((F.col("n") >= 4) & (F.col("again") >= 0.3 * F.col("n"))))
    return rows.join(copies, "doc_id", "left_anti")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, mod: int = 3, rest: int = 1, least: int = 5, ratio: float = 2.5) -> Lexicon:
    """Learn from at most ``per_class`` rows of each label outside the held-out fold. Entries must be in ``least`` toxic
    texts (fewer where few texts are given) and have log odds over ``ratio``."""
    sample, *paths = sample_labelled(docs, labels, "toxic", mod, rest, per_class)
    rows = sample.select("doc_id", F.col("y").cast("long").alias("y"), "text").mapInArrow(
        featured, "doc_id long, y long, folded string, entries array<string>, marks array<long>")
    rows, path = stored_at(rows, "features")
    paths.append(path)
    rows, path = stored_at(fresh(rows).drop("marks"), "fresh")
    try:
        return learned(rows, least, ratio)
    finally:
        for p in (*paths, path):
            forget(docs.sparkSession, p)


def learned(rows: DataFrame, least: int, ratio: float) -> Lexicon:
    """Lexicon from featured rows (doc_id, y, folded, entries)."""
    n, n1 = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    n0 = n - n1
    if not n0 or not n1:
        return Lexicon()
    least = max(2, min(least, n1 // 20))
    entry = rows.select("y", "doc_id", F.explode("entries").alias("entry")).groupBy("entry")
    toxic, clean = F.col("toxic"), F.col("clean")
    counted = entry.agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"), F.collect_list(F.when(F.col("y") == 1, F.col("doc_id"))).alias("held"))
    # careful odds: what is certain of the toxic texts' share, two standard deviations off, must be something
    likely = counted.where((toxic >= least) & (toxic > 2 * F.sqrt(toxic)) & (F.log(toxic / n1) - F.log((clean + 1) / n0) >= ratio))
    lex = Lexicon(weights=chosen({r["entry"]: (sorted(r["held"]), r["clean"]) for r in likely.collect()}, n1, n0, least))
    if lex.weights:
        lex.exceptions = exceptions(rows, lex)

    def measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = lex.automaton()
        for b in batches:
            got = [lex.matched(auto, t) for t in b.column("folded").to_pylist()]
            yield as_batch({"doc_id": b.column("doc_id"), "y": b.column("y"), "w": [w for w, _ in got], "n": [k for _, k in got]}, MEASURED)

    got = sorted(rows.select("doc_id", "y", "folded").mapInArrow(measured, "doc_id long, y long, w double, n long").collect())
    x = np.array([(math.log1p(r["w"]), math.log1p(100 * r["w"] / max(r["n"], 1))) for r in got])
    lex.bias, lex.total, lex.density = fitted(x, np.array([r["y"] for r in got], dtype=float))
    return lex


MEASURED = pa.schema([("doc_id", pa.int64()), ("y", pa.int64()), ("w", pa.float64()), ("n", pa.int64())])
PHRASES = pa.schema([("phrase", pa.string()), ("y", pa.int64()), ("n", pa.int64())])


def exceptions(rows: DataFrame, lex: Lexicon) -> frozenset[str]:
    """Phrases around matches that rows not marked toxic hold twice and at least twice as often as others."""

    def around(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = lex.automaton()
        for b in batches:
            found: Counter = Counter()
            for t, y in zip(b.column("folded").to_pylist(), b.column("y").to_pylist(), strict=True):
                found.update((p, y) for p in phrases_of(t, auto))
            if found:
                yield as_batch({"phrase": [p for p, _ in found], "y": [y for _, y in found], "n": list(found.values())}, PHRASES)

    each = rows.select("y", "folded").mapInArrow(around, "phrase string, y long, n long").groupBy("phrase")
    spared, meant = (F.sum(F.when(F.col("y") == v, F.col("n")).otherwise(0)) for v in (0, 1))
    return frozenset(r["phrase"] for r in each.agg(spared.alias("spared"), meant.alias("meant")).where("spared >= 2 and spared >= 2 * meant").collect())


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id``, ``score``, ``matched`` (weight) and ``n_words`` of every whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("matched", pa.float64()), ("n_words", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_memories()
        auto = lexicon.automaton()
        for b in batches:
            for p in pieces(b):
                got = [lexicon.matched(auto, fold(t)) for t in p.column("text").to_pylist()]
                yield as_batch({"doc_id": p.column("doc_id"), "score": [lexicon.score(w, n) for w, n in got],
                                "matched": [w for w, _ in got], "n_words": [n for _, n in got]}, schema)

    return texts(docs).mapInArrow(run, "doc_id long, score double, matched double, n_words long")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` whose text scores below the threshold, scored beside each row so that nothing is joined."""
    lexicon = fit(docs, labels)
    return docs.where(flagger(lexicon)(F.coalesce(F.col("text"), F.lit(""))) < threshold)


def flagger(lexicon: Lexicon):
    """The score as a function of a text column."""
    auto: list = []

    @F.pandas_udf("double")
    def toxicity(t: pd.Series) -> pd.Series:
        if not auto:
            drop_memories()
            auto.append(lexicon.automaton())
        return pd.Series([lexicon.score(*lexicon.matched(auto[0], fold(x))) for x in t])

    return toxicity
