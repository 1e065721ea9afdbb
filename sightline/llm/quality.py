"""Quality classifier by attention-based multiple-instance learning (operator 1).

A document is a bag of passages. Every passage is encoded: histograms of its byte classes and their successions, with
a few measures of repetition, go through a learned layer to a representation h. Gated attention, w . (tanh(V h) *
sigmoid(U h)), gives each passage a weight (softmax over the document), and the score is logistic in the weighted
sum of the representations. Only document labels train it; the weights of passages are learned from them.

Training rows are a bounded, documented sample: ``per_class`` of each label, and ``most_bytes`` of their texts together.
Encoding runs in Spark's tasks; the driver gets the encoded passages of the sample, about as many bytes as its texts.
Every passage of a sampled text trains, and every passage of every text is scored, ``BLOCK`` bytes at a time.

Defined cases: null and empty texts are one empty passage and get its score; very long texts have many passages, of
which a block is in memory (the softmax is accumulated; of earlier blocks the hashes of their words are kept); repeated rows are scored each; null labels and labels without a document
teach nothing; without labels of both kinds all scores are the share of good labels (1 without any); further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import as_batch, drop_memories, forget, pieces, sample_labelled, texts

THRESHOLD = 0.7
PER_CLASS = 1_500
#: Bytes of a passage; a text's last passage may be shorter.
PASSAGE = 512
#: Bytes of text that are encoded at once.
BLOCK = 1 << 20
#: Bytes of text of all training rows of a label together, at most.
MOST_BYTES = 64 << 20
#: Byte classes: control, space, line end, digit, lower, upper, sentence end, comma, quotes, brackets, dash,
#: pipe and slash, other signs, lead bytes of UTF-8, its further bytes.
KINDS = 16


def kinds() -> np.ndarray:
    t = np.zeros(256, dtype=np.uint8)
    for k, chars in enumerate((b" ", b"\n\r", b"0123456789", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".?", b",;:", b"\"'`", b"()[]{}<>", b"-_", b"|/\\", b"!", b"#$%&*+=@^~"), 1):
        t[list(chars)] = k
    t[0x80:0xC0], t[0xC0:] = 14, 15
    return t


KIND = kinds()
SIZE = KINDS + KINDS * KINDS + 4


def encode(raw: np.ndarray, starts: np.ndarray, owner: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for each passage. ``starts``: where each begins in ``raw``, ascending from 0; owner: its document.
    ``seen``: hashes of words that the first document has in earlier blocks. Also given: those of the last document."""
    n = len(starts)
    words_of_last = seen if len(owner) and owner[0] == owner[-1] else seen[:0]
    stops = np.append(starts[1:], len(raw))
    lengths = stops - starts
    out = np.zeros((n, SIZE), dtype=np.float32)
    if len(raw):
        k = KIND[raw].astype(np.int32)
        at = np.repeat(np.arange(n, dtype=np.int32), lengths)
        one = np.bincount(at * KINDS + k, minlength=n * KINDS).reshape(n, KINDS)
        two = np.bincount(at[:-1] * KINDS * KINDS + k[:-1] * KINDS + k[1:], weights=at[:-1] == at[1:], minlength=n * KINDS * KINDS).reshape(n, -1)
        size = np.maximum(lengths, 1)[:, None]
        out[:, :KINDS] = np.sqrt(one / size)
        out[:, KINDS : KINDS + KINDS * KINDS] = np.sqrt(two / size)
        # words by their hash: how many of a passage's differ, and how many came earlier in its document
        gap = k <= 2
        first = np.flatnonzero(~gap & np.append(True, gap[:-1] | (at[1:] != at[:-1])))
        if len(first):
            lower = np.where(k == 5, raw | 32, raw).astype(np.uint64)
            place = np.arange(len(raw), dtype=np.uint64)
            edges = np.unique(np.append(0, first))
            mix = (lower + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            within = place - np.repeat(edges, np.diff(np.append(edges, len(raw)))).astype(np.uint64)
            mix = (mix ^ (mix >> np.uint64(29))) * ((within << np.uint64(1)) | np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
            mix[gap] = 0
            h = np.add.reduceat(mix, first)
            p = at[first]
            order = np.lexsort((np.arange(len(h)), h, owner[p]))
            again = np.zeros(len(h), dtype=bool)
            again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (owner[p[order[1:]]] == owner[p[order[:-1]]])
            if len(seen):
                again[owner[p] == owner[0]] |= np.isin(h[owner[p] == owner[0]], seen)
            words_of_last = np.union1d(words_of_last, h[owner[p] == owner[-1]])
            words = np.bincount(p, minlength=n)
            base = KINDS + KINDS * KINDS
            out[:, base] = np.bincount(p, weights=again, minlength=n) / np.maximum(words, 1)
            out[:, base + 1] = np.log1p(words) / 5
            out[:, base + 2] = lengths / np.maximum(words, 1) / 20
    out[:, -1] = np.log1p(lengths) / 7
    return out, words_of_last


def bags(raws: list[bytes], block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Encoded passages with the document of each, ``block`` bytes at a time; a longer document goes on in the next
    block, and takes the hashes of its words along."""
    parts: list[bytes] = []
    starts: list[int] = []
    owner: list[int] = []
    size, seen, before = 0, np.zeros(0, np.uint64), -1

    def encoded() -> tuple[np.ndarray, np.ndarray]:
        nonlocal seen, before
        own = np.array(owner)
        x, seen = encode(np.frombuffer(b"".join(parts), np.uint8), np.array(starts), own, seen if own[0] == before else seen[:0])
        before = own[-1]
        return x, own

    for i, r in enumerate(raws):
        at = 0
        while at < len(r) or not at:
            end = min(len(r), at + (block - size) // PASSAGE * PASSAGE)
            number = max(1, -(-(end - at) // PASSAGE))
            starts += range(size, size + number * PASSAGE, PASSAGE)
            owner += [i] * number
            parts.append(r[at:end])
            size += end - at
            at = max(end, 1)
            if block - size < PASSAGE:
                yield encoded()
                parts, starts, owner, size = [], [], [], 0
    if owner:
        yield encoded()


@dataclass
class Model:
    """Weights of the encoder's layer, the gated attention and the logistic output."""

    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]
    constant: float | None = None

    def represent(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) * self.scale) @ self.w["E"] + self.w["e"])

    def score(self, raws: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(raws), self.constant)
        # softmax over a document's passages, whichever blocks they are in: sums of e and of e h
        above, below = np.zeros((len(raws), self.w["E"].shape[1])), np.zeros(len(raws))
        for x, owner in bags(raws):
            h = self.represent(x)
            a = (np.tanh(h @ self.w["V"]) * (0.5 + 0.5 * np.tanh(0.5 * (h @ self.w["U"])))) @ self.w["w"]
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            e = np.exp(np.clip(a, -30, 30))
            above[owner[first]] += np.add.reduceat(e[:, None] * h, first)
            below[owner[first]] += np.add.reduceat(e, first)
        z = above / np.maximum(below, 1e-300)[:, None]
        return 1 / (1 + np.exp(-np.clip(z @ self.w["c"] + self.w["b"], -40, 40)))


def train(rows: list[tuple[np.ndarray, int]], width: int = 24, gate: int = 12, epochs: int = 60, seed: int = 7) -> Model:
    """Adam on the logistic loss, both labels with equal weight. ``rows``: (passages, label)."""
    none = np.zeros(SIZE, np.float32)
    ys = [y for _, y in rows]
    if len(set(ys)) < 2:
        return Model(none, none, {}, float(np.mean(ys)) if ys else 1.0)
    rng = np.random.default_rng(seed)
    every = np.concatenate([x for x, _ in rows])
    mean, scale = every.mean(0), 1 / (every.std(0) + 0.02)
    w = {"E": rng.normal(0, 0.5 / np.sqrt(SIZE), (SIZE, width)), "e": np.zeros(width), "V": rng.normal(0, 0.3, (width, gate)),
         "U": rng.normal(0, 0.3, (width, gate)), "w": rng.normal(0, 0.3, gate), "c": rng.normal(0, 0.3, width), "b": np.zeros(1)}
    m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    y = np.array(ys, dtype=float)
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), 64):
            ids = order[at : at + 64]
            x = (np.concatenate([rows[i][0] for i in ids]) - mean) * scale
            sizes = np.array([len(rows[i][0]) for i in ids])
            own = np.repeat(np.arange(len(ids)), sizes)
            first = np.append(0, np.cumsum(sizes)[:-1])
            h = np.tanh(x @ w["E"] + w["e"])
            t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
            e = np.exp((t * s) @ w["w"])
            alpha = e / np.add.reduceat(e, first)[own]
            z = np.add.reduceat(alpha[:, None] * h, first)
            p = 1 / (1 + np.exp(-(z @ w["c"] + w["b"])))
            dz_ = share[ids] * (p - y[ids]) / len(ids)
            g = {"c": z.T @ dz_, "b": np.array([dz_.sum()])}
            dz = dz_[:, None] * w["c"]
            da = (dz[own] * h).sum(1)
            da = alpha * (da - np.add.reduceat(alpha * da, first)[own])
            dts = da[:, None] * w["w"]
            dv, du = dts * s * (1 - t * t), dts * t * s * (1 - s)
            dh = alpha[:, None] * dz[own] + dv @ w["V"].T + du @ w["U"].T
            pre = dh * (1 - h * h)
            g |= {"w": (t * s).T @ da, "V": h.T @ dv, "U": h.T @ du, "E": x.T @ pre, "e": pre.sum(0)}
            step += 1
            for k, v in w.items():
                grad = g[k] + 1e-4 * v
                a, b = m[k]
                a += 0.1 * (grad - a)
                b += 0.01 * (grad * grad - b)
                v -= 0.01 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return Model(mean.astype(np.float32), scale.astype(np.float32), {k: v.astype(np.float32) for k, v in w.items()})


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, mod: int = 4, rest: int = 2, most_bytes: int = MOST_BYTES) -> Model:
    """Train on at most ``per_class`` rows of each label outside the held-out fold, in the order of a hash of their ids,
    whose texts together have no more than ``most_bytes``; one that would be too much is passed over."""
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int64()), ("bag", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_memories()
        for b in batches:
            for p in pieces(b):
                raws = [t.encode() for t in p.column("text").to_pylist()]
                found: list[list[bytes]] = [[] for _ in raws]
                for x, owner in bags(raws):
                    x = x.astype(np.float16)
                    edges = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                    for d, mine in zip(owner[edges].tolist(), np.split(x, edges[1:]), strict=True):
                        found[d].append(mine.tobytes())
                yield as_batch({"doc_id": p.column("doc_id"), "y": p.column("y"), "bag": [b"".join(f) for f in found]}, schema)

    sample, path = sample_labelled(docs, labels, "quality", mod, rest, per_class)
    try:
        # sizes of at most 2 * per_class rows; a text that doesn't fit any more is passed over
        chosen, left = [], {}
        for r in sorted(sample.select("y", "h", "doc_id", F.octet_length("text").alias("size")).collect()):
            if r["size"] <= left.setdefault(r["y"], most_bytes):
                left[r["y"]] -= r["size"]
                chosen.append((r["doc_id"],))
        fits = docs.sparkSession.createDataFrame(chosen, "doc_id long")
        rows = sample.join(F.broadcast(fits), "doc_id").select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y long, bag binary")
        got = sorted((r["doc_id"], r["bag"], r["y"]) for r in rows.collect())
    finally:
        forget(docs.sparkSession, path)
    return train([(np.frombuffer(b, np.float16).reshape(-1, SIZE).astype(np.float32), int(y)) for _, b, y in got])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` of every whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_memories()
        for b in batches:
            for p in pieces(b):
                yield as_batch({"doc_id": p.column("doc_id"), "score": model.score([t.encode() for t in p.column("text").to_pylist()])}, schema)

    return texts(docs).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` whose text scores at least the threshold."""
    model = fit(docs, labels)

    @F.pandas_udf("double")
    def quality(t: pd.Series) -> pd.Series:
        drop_memories()
        return pd.Series(model.score([x.encode() for x in t]))

    return docs.where(quality(F.coalesce(F.col("text"), F.lit(""))) >= threshold)
