"""Divergence, mixing and filter interactions against brute force and on odd tables."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from sightline.llm import common, divergence, interactions, mixing


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def copies(docs):
    """The rows dealt anew, so that tasks differ."""
    return docs.repartition(7, "n_chars")


def plain_divergence(rows, least=30, top=50):
    found = [(r.lang or "", r.source or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")))) for r in rows]
    out = []
    for lang in {f[0] for f in found}:
        mine = [f for f in found if f[0] == lang]
        within = Counter(t for f in mine for t in f[2])
        kept = [t for t, n in within.items() if n >= least]
        sources = sorted({f[1] for f in mine})
        counts = {s: Counter() for s in [*sources, None]}
        for _, s, c in mine:
            for t in kept:
                counts[s][t] += c[t]
                counts[None][t] += c[t]
        p = {s: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept} for s, c in counts.items()}
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - p[None][t]) for t in kept if counts[s][t] and p[s][t] > p[None][t]]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, *x, k) for k, x in enumerate(ranked, 1) if part == "pair" or k <= top]
    return sorted(out)


def test_divergence(spark, sf, odd_docs, no_docs, monkeypatch):
    docs = documents(spark, sf)
    want = plain_divergence(docs.collect(), 20)
    assert {x[2] for x in want} == {"pair", "term"}
    assert sorted(map(tuple, divergence.divergence(docs, 20).collect())) == want
    assert sorted(map(tuple, divergence.divergence(copies(docs), 20, cells=500).collect())) == want  # many blocks
    for least in (1, 2, 30):
        assert sorted(map(tuple, divergence.divergence(odd_docs, least).collect())) == plain_divergence(odd_docs.collect(), least)
    assert divergence.divergence(no_docs).count() == 0


def test_tiles_and_flushes_change_nothing(spark, odd_docs):
    docs = spark.createDataFrame([(k, f"w{k % 5} common words {'x' * (k % 3)}", None if k == 3 else "en", f"s{k % 9}" if k % 9 else None) for k in range(60)], "doc_id long, text string, lang string, source string")
    want = plain_divergence(docs.collect(), 3)
    assert sorted(map(tuple, divergence.divergence(docs, 3).collect())) == want
    one = divergence.term_counts(odd_docs).groupBy("lang", "source", "term").sum("docs", "n")
    many = divergence.term_counts(odd_docs, held=5).groupBy("lang", "source", "term").sum("docs", "n")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    # tiles: the tables of each tile together are the one table
    frame = pa.table({"lang": ["l"], "all": [[{"k": k, "source": f"s{k:03}", "none": 7 + k} for k in range(600)]]})
    entries = pa.table({"term": ["a", "a", "b"], "k": [0, 599, 300], "p": [1000, 50, 9]})
    got = {}
    for tile in range(3):
        for r in divergence.distances((pa.scalar("l"), pa.scalar(0), pa.scalar(tile)), entries, frame).to_pylist():
            got[r["source"], r["item"]] = r["value"]
    p = {t: {k: 7 + k for k in range(600)} for t in "ab"}
    p["a"] |= {0: 1000, 599: 50}
    p["b"] |= {300: 9}
    assert got == {(f"s{a:03}", f"s{b:03}"): sum(abs(p[t][a] - p[t][b]) for t in "ab") for a in range(600) for b in range(600) if a != b}


def test_terms_of_long_texts(monkeypatch):
    text = ("Straße ab12cd É! " * 500).encode()
    want = divergence.counted(text)
    monkeypatch.setattr(divergence, "PIECE", 37)
    assert divergence.counted(text) == want and want["straße".encode()] == 500 and want["É".encode()] == 500 and want[b"ab"] == 500


def test_shares_are_exact(spark):
    from pyspark.sql import functions as F

    big = [(3 * 10**13 + 7, 10**14 + 9, 12345), (0, 0, 1), (10**18, 10**18, 1), (0, 0, 0)]
    got = spark.createDataFrame(big, "n long, total long, terms long").select(divergence.share(F.col("n"), F.col("total"), F.col("terms")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (n + 5) // (t + 5 * v) if v else None for n, t, v in big]


def plain_targets(size):
    """target by source, from words by source"""
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    stopped = set()
    while True:
        left = sum(weight[s] for s in order if s not in stopped)
        rest = Fraction(3 * sum(size.values()), 2) - sum(2 * size[s] for s in stopped)
        out = {s: Fraction(2 * size[s]) if s in stopped else weight[s] * rest / left for s in order}
        new = {s for s in order if s not in stopped and out[s] > 2 * size[s]}
        if not new:
            return out
        stopped |= new


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def check_mix(docs, got, near):
    want = Counter((r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in docs.collect())
    assert Counter((r.doc_id, r.source, r.size) for r in got) == want
    size = defaultdict(int)
    for (_, s, n), k in want.items():
        size[s] += n * k
    target = plain_targets(size)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(float(target[r.source]), rel=1e-12)
        assert 0 <= r.copies <= 2 and r.taken == r.copies * r.size <= 2 * r.size
        assert r.copies in (int(target[r.source] / size[r.source]), -int(-target[r.source] // size[r.source])) if size[r.source] else r.taken == 0
        taken[r.source] += r.taken
    for s in size:
        assert abs(taken[s] - target[s]) <= near(s), (s, taken[s], float(target[s]))


def test_mixing(spark, sf, odd_docs, no_docs):
    docs = documents(spark, sf)
    got = mixing.mix(docs).collect()
    words, largest = Counter(), Counter()
    for r in docs.collect():
        n = len(WORD.findall(r.text or ""))
        words[r.source] += n
        largest[r.source] = max(largest[r.source], n)
    near = lambda s: words[s] / 100  # noqa: E731  ten documents a source
    check_mix(docs, got, near)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(copies(docs)).collect()))
    small = mixing.mix(docs, block=3, fan=2).collect()  # many levels
    check_mix(docs, small, lambda s: largest[s])
    check_mix(odd_docs, mixing.mix(odd_docs).collect(), lambda s: 10**6)
    assert mixing.mix(no_docs).count() == 0
    none = spark.createDataFrame([(1, None, "a"), (2, " ", "b"), (None, "", None)], "doc_id long, text string, source string")
    assert [(r.size, r.source_size, r.target, r.taken) for r in mixing.mix(none).collect()] == [(0, 0, 0.0, 0)] * 3


def test_mixing_of_equal_rows_and_of_one_large_source(spark):
    rows = [(7, "a b c", "big")] * 2500 + [(k, "w " * (1 + k % 9), "big") for k in range(900)] + [(k, "x " * 40, f"s{k % 4}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    check_mix(docs, mixing.mix(docs, block=100, fan=4).collect(), lambda s: 3 if s == "big" else 40)


def test_flight_keeps_both_totals():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randrange(1, 60)
        size = [rng.choice((0, 5, 5, 9, rng.randrange(1, 10**6))) for _ in range(n)]
        p = [rng.choice((0.0, 1.0, rng.random(), 0.375)) for _ in range(n)]
        before = sum(p), sum(s * x for s, x in zip(size, p, strict=True))
        stop = rng.choice((2, 10))
        mixing.flight(size, p, rng, stop)
        assert sum(0 < x < 1 for x in p) <= stop and all(0 <= x <= 1 for x in p)
        assert sum(p) == pytest.approx(before[0], abs=1e-6) and sum(s * x for s, x in zip(size, p, strict=True)) == pytest.approx(before[1], abs=1e-2)
        mixing.land(size, p)
        assert set(p) <= {0.0, 1.0}


def test_each_document_has_its_probability():
    """Over many seeds a document is taken as often as its probability says (the landing's few aside)."""
    size = [1 + k * k % 97 for k in range(60)]
    taken = np.zeros(60)
    for seed in range(600):
        p = [0.3] * 60
        mixing.flight(size, p, random.Random(seed), 2)
        taken += p
    assert np.abs(taken / 600 - 0.3).max() < 0.1


def test_word_counts():
    values = [b"", b" ", b"a", b"a b", b"\x0b\x0c\rx\ty\n", "é ü z".encode(), b"ab " * 50, b"x" * 40, b"", b"q"]
    want = [len(v.split()) for v in values]
    for block in (1, 2, 7, 1 << 20):
        for kind in (pa.binary(), pa.large_binary()):
            column = pa.array([b"skipped words", *values], kind).slice(1)
            assert common.word_counts(column, block).tolist() == want
    assert common.word_counts(pa.array([], pa.binary())).tolist() == []


def plain_interactions(rows, labels):
    least = {}
    for r in rows:
        if r.doc_id is not None:
            least[r.text or ""] = min(least.get(r.text or "", r.doc_id), r.doc_id)
    good, toxic = ({x.doc_id for x in labels if x.doc_id is not None and x[k] == 1} for k in ("quality", "toxic"))
    parts = defaultdict(list)
    for r in rows:
        t = r.text or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": r.doc_id is not None and least[t] < r.doc_id}
        parts[r.lang or ""].append((frozenset(k for k, v in fails.items() if v), r.doc_id in good, r.doc_id in toxic))
    out = {}
    for part, docs in parts.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in d[0] for d in docs) - len(gone), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone), f]
        for k, v in out.items():
            if k[0] == part:
                v[-1] = shapley[v[-1]] if isinstance(v[-1], str) else v[-1]
    return sorted((*k, *v) for k, v in out.items())


LABELS = "doc_id long, quality int, toxic int, text string"


def test_interactions(spark, sf, odd_docs, no_docs):
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    want = plain_interactions(docs.collect(), labels.collect())
    assert sorted(map(tuple, interactions.interactions(docs, labels).collect())) == want
    assert sorted(map(tuple, interactions.interactions(copies(docs), labels).collect())) == want
    said = spark.createDataFrame([(1, 1, 0, "x"), (1, 0, 1, "y"), (2, None, 1, None), (None, 1, 1, ""), (99, 1, 1, "z"), (7, 1, None, "")], LABELS)
    assert sorted(map(tuple, interactions.interactions(odd_docs, said).collect())) == plain_interactions(odd_docs.collect(), said.collect())
    assert interactions.interactions(no_docs, said).count() == 0
    assert interactions.interactions(odd_docs, said.where("false")).count() == 600 * odd_docs.select("lang").distinct().count()


def test_packed_sums_do_not_overflow_into_neighbours():
    n = 2**63 - 1
    fields = np.frombuffer((n * interactions.packed(31 | 32)).to_bytes(interactions.WIDE, "little"), "<u8").reshape(len(interactions.MEASURES), 600)
    assert set(np.unique(fields)) == {0, n}
    assert fields[1].reshape(120, 5).sum(axis=1).tolist() == [n] * 120  # the first filter takes it, whatever the order


def test_masks_of_long_texts(monkeypatch):
    texts = [("Word and #more " * 80).encode(), b"a" * 300, ("É " * 101).encode(), b"AB cd " * 10, b""]
    want = [interactions.failed(t) for t in texts]
    monkeypatch.setattr(interactions, "PIECE", 5)
    assert [interactions.failed(t) for t in texts] == want == [2 | 8, 1, 2, 1 | 2 | 4, 1]
