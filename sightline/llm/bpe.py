"""Byte-pair encoding and decoding by one pass over a trie of distinct words (operator 6).

Distinct words go into a trie whose edges are the byte symbols of a word. Depth first, every node gets its
last-token state: the last token of the encoding of the path to it. Encodings have the property that the
encoding of a prefix that ends at a token boundary is a prefix of the encoding, so one token per node is a
complete description, shared prefixes are worked out once, and a word's ids are read by walking up from its end.

A token can be the state of a node only if it ends there and the pair (state at its start, token) is one that
merging leaves alone; exactly one token fits (tested against the tokenizers library).

Defined cases: null text is encoded as empty (no ids, empty decoded text); the strings of special tokens in a
text give their ids, as in the library; very long texts and words need memory in proportion to themselves;
repeated rows give repeated rows; further input columns are ignored. Vocabularies whose normaliser, pre-tokeniser,
decoder or model settings are other than those built here raise ValueError. Null ids decode to null, and ids that the
vocabulary lacks are left out.
"""

from __future__ import annotations

import gc
import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sightline.llm.common import MEMORIES, as_batch, pieces, release_memory, texts

WORD = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
#: Beyond these scripts a chunk is looked at for characters that Unicode versions class differently.
FAR = regex.compile(r"[^\x00-\u052f]")
#: Marks that are one word by themselves after letters.
MARKS = frozenset(".,;:!?")
#: White space to str.split() that the tokenizer's pattern doesn't take as such.
ODD = regex.compile(r"[\x1c-\x1f]")
GAP = regex.compile(r"\p{White_Space}+")
#: The settings of a vocabulary file that this module does the work of.
SETTINGS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None, "decoder": None}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
ADDED = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(256 + extra), extra + 1
    return out


class Vocabulary:
    """Tables of a byte-level BPE vocabulary with an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if any(spec.get(k) != v for k, v in SETTINGS.items()) or any(model.get(k, v) != v for k, v in MODEL.items()) or any(
                t.get(k, v) != v for t in spec["added_tokens"] for k, v in ADDED.items()):
            raise ValueError(f"{path}: settings other than those that this module applies")
        self.end = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in [*self.ids.items(), *self.special.items()]}
        self.special_re = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.merges: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            left, right = self.ids[a], self.ids[b]
            self.merges.setdefault((left, right), rank)
            self.parts.setdefault(self.ids[a + b], (left, right, rank))
        self.symbols = byte_symbols()
        #: Symbols of the longest token, and by a token's last four symbols the lengths, longest first, that may end so.
        self.longest = max(map(len, self.ids))
        lengths: dict[str, set[int]] = {}
        for s in self.ids:
            close = len(self.end) if self.end and s.endswith(self.end) else 0
            if (n := len(s) - close) > 3:
                lengths.setdefault(s[-4 - close :], {1, 2, 3}).add(n)
        self.reach = {tail: tuple(sorted(n, reverse=True)) for tail, n in lengths.items()}
        self.fits: dict[tuple[int, int], bool] = {}

    def apart(self, a: int, b: int) -> bool:
        """Whether merging the text of both tokens gives just these two, by undoing the later merge stepwise."""
        known = self.fits.get((a, b))
        if known is not None:
            return known
        left, right, limit, out = a, b, len(self.merges), None
        none = (-1, -1, -1)
        while out is None:
            rank = self.merges.get((left, right))
            if rank is not None and rank < limit:
                out = False
                break
            pl, pr = self.parts.get(left, none), self.parts.get(right, none)
            # the later of the two merges is undone; a merge across the seam must rank above it
            if pl[2] < 0 and pr[2] < 0:
                out = True
            elif pl[2] > pr[2]:
                limit, left = pl[2], pl[1]
            else:
                limit, right = pr[2] + 1, pr[0]
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        self.fits[(a, b)] = out
        return out

    @property
    def own(self) -> dict[str, int]:
        """Tokens that merging makes from their own text; no others occur in an encoding."""
        if not hasattr(self, "_own"):
            self._own = {s: i for s, i in self.ids.items() if i not in self.parts or self.apart_inside(i)}
        return self._own

    def apart_inside(self, token: int) -> bool:
        """Whether the merge that makes the token is what its text leads to: its halves stay apart until it."""
        left, right, rank = self.parts[token]
        seam, none, limit = (left, right), (-1, -1, -1), rank
        a, b = seam
        while True:
            if (a, b) != seam and (r := self.merges.get((a, b))) is not None and r < limit:
                return False
            pa_, pb = self.parts.get(a, none), self.parts.get(b, none)
            if pa_[2] < 0 and pb[2] < 0:
                return True
            if pa_[2] > pb[2]:
                limit, a = min(limit, pa_[2]), pa_[1]
            else:
                limit, b = min(limit, pb[2] + 1), pb[0]


class Trie:
    """Words as paths of byte symbols; ``states`` gives each word's tokens."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.root: dict = {}

    def insert(self, word: str) -> None:
        node, symbols = self.root, self.v.symbols
        raw = word.encode()
        for b in raw[:-1]:
            s = symbols[b]
            child = node.get(s)
            if child is None:
                child = node[s] = {}
            node = child
        node[symbols[raw[-1]] + self.v.end] = word

    def states(self) -> Iterator[tuple[str, list[int]]]:
        """(word, ids), depth first. ``last`` and ``size`` hold the states on the path to the current node; of the path
        itself each level keeps only as many symbols as a token may have."""
        own, apart, reach, fits, end, longest = self.v.own, self.v.apart, self.v.reach, self.v.fits, len(self.v.end), self.v.longest
        last, size = [-1], [0]
        work = [("", iter(self.root.items()))]
        while work:
            path, children = work[-1]
            step = next(children, None)
            if step is None:
                work.pop()
                last.pop()
                size.pop()
                continue
            symbol, below = step
            here = path + symbol
            depth = len(work)  # symbols on the path, this one included
            leaf = isinstance(below, str)
            close = end if leaf else 0
            for n in reach.get(here[-4 - close:], (3, 2, 1)):
                if n > depth:
                    continue
                token = own.get(here[-n - close:])
                if token is not None:
                    if n == depth:
                        break
                    known = fits.get((last[depth - n], token))
                    if known or known is None and apart(last[depth - n], token):
                        break
            if leaf:
                ids, at, width = [token], depth - n, 0
                while at:
                    ids.append(last[at])
                    at -= size[at]
                yield below, ids[::-1]
            else:
                last.append(token)
                size.append(n)
                work.append((here if depth < longest else here[-longest:], iter(below.items())))


class Encoder:
    """Text to ids with a bounded memory of chunks (text between white space) seen by this worker."""

    #: Chunks and words kept; beyond it the memory starts anew. Only speed depends on it.
    KEEP = 400_000
    #: Words in a trie at once, which bounds its memory, and characters of a chunk or word that outlives its batch.
    TRIE, SHORT = 50_000, 256

    def __init__(self, path: str, decode: bool = True):
        self.v = Vocabulary(path)
        self.path = path
        self.word = regex.compile(WORD)
        self.decode = decode
        #: By chunk its ids, little-endian, and what they decode to; by word its ids.
        self.seen: dict[str, bytes] = {}
        self.text: dict[str, str] = {}
        self.words: dict[str, bytes] = {}
        #: Whether the batch has chunks that are too long to be kept.
        self.forgets = False

    def word_ids(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """Each word's tokens; sorted, so that words with a shared prefix meet in one trie."""
        words.sort()
        for i in range(0, len(words), self.TRIE):
            trie = Trie(self.v)
            for w in words[i : i + self.TRIE]:
                trie.insert(w)
            yield from trie.states()

    def split(self, chunk: str) -> list[str]:
        """The tokenizer's words of a chunk; the plain forms, letters and letters with one mark, need no pattern."""
        if chunk.isalpha():
            return [chunk]
        if chunk[-1] in MARKS and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.word.findall(chunk)

    def learn(self, chunks: set[str]) -> None:
        """Ids of new chunks, by way of the distinct words in them. It makes many lists and no cycles, so the search for
        cycles, which would walk them again and again, waits."""
        gc.disable()
        try:
            self._learn(chunks)
        finally:
            gc.enable()

    def _learn(self, chunks: set[str]) -> None:
        names, known, keep, text, split = self.v.names, self.words, self.seen, self.text, self.split
        words = [(c, split(c) if c.isascii() or not FAR.search(c) or all(unicodedata.category(x) != "Cn" for x in c) else self.library_split(c)) for c in chunks]
        new = {w for _, ws in words for w in ws}
        if len(known) + len(new) > self.KEEP:
            known.clear()
        new.difference_update(known)
        for w, ids in self.word_ids(list(new)):
            known[w] = array("I", ids).tobytes()
        for c, ws in words:
            if len(ws) == 1:
                raw = known[ws[0]]
            elif len(ws) == 2:
                raw = known[ws[0]] + known[ws[1]]
            else:
                raw = b"".join([known[w] for w in ws])
            keep[c] = raw
            if self.decode:
                text[c] = " ".join([names[i] for i in memoryview(raw).cast("I")])

    def library_split(self, chunk: str) -> list[str]:
        """Words of a chunk with characters that are unassigned in this Python's Unicode tables, which versions class
        differently: the library says where words end. Their ids come from the trie like all others."""
        if not hasattr(self, "_library"):
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        back = {s: b for b, s in enumerate(self.v.symbols)}
        found = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(chunk))
        return [bytes([back[x] for x in piece]).decode() for piece, _ in found]

    def chunks(self, text: str) -> list[str]:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower case of each character alone, whatever its place
                text = text.replace("Σ", "σ")
        low = text.lower()
        return [c for c in GAP.split(low) if c] if ODD.search(low) else low.split()

    def segments(self, text: str) -> list[list[str] | int]:
        """Lists of chunks, and ids of special tokens between them."""
        sp = self.v.special_re
        if sp is None or "<|" not in text and not sp.search(text):
            return [self.chunks(text)]
        out: list[list[str] | int] = []
        at = 0
        for m in sp.finditer(text):
            out += [self.chunks(text[at : m.start()]), self.v.special[m[0]]]
            at = m.end()
        return [*out, self.chunks(text[at:])]

    def batch(self, many: list[str]) -> Iterator[tuple[bytes, str]]:
        """For each text its ids (little-endian unsigned 32-bit) and what they decode to."""
        cut = [self.segments(t) for t in many]
        every = set().union(*(s for segs in cut for s in segs if type(s) is list))
        new = every.difference(self.seen)
        if len(self.seen) + len(new) > self.KEEP:
            self.seen.clear()
            self.text.clear()
            new = every
        if new:
            self.learn(new)
            self.forgets = max(map(len, new)) > self.SHORT
        ids, text, special = self.seen.__getitem__, self.text.__getitem__, self.v.names
        for segs in cut:
            raw = b"".join([b"".join(map(ids, s)) if type(s) is list else int(s).to_bytes(4, "little") for s in segs])
            decoded = " ".join([part for s in segs if (part := " ".join(map(text, s)) if type(s) is list else special[s])]) if self.decode else ""
            yield raw, decoded
        for memory in (self.seen, self.text, self.words):
            for c in [c for c in memory if len(c) > self.SHORT] if self.forgets else ():
                del memory[c]
        self.forgets = False


class LibraryEncoder(Encoder):
    """The same memory of words and chunks, with the tokenizers library's own model encoding each new word."""

    KEEP = 600_000

    def word_ids(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        if not hasattr(self, "_model"):
            from tokenizers.models import BPE

            with open(self.path, encoding="utf-8") as f:
                model = json.load(f)["model"]
            self._model = BPE(vocab=model["vocab"], merges=[tuple(m) for m in model["merges"]], end_of_word_suffix=self.v.end)
        symbols, tokens = self.v.symbols, self._model.tokenize
        for w in words:
            yield w, [t.id for t in tokens(w if w.isascii() and w.isalnum() else "".join([symbols[b] for b in w.encode()]))]


@lru_cache(maxsize=2)
def encoder(path: str, library: bool = False) -> Encoder:
    """One for each worker process, reused by its tasks."""
    return LibraryEncoder(path, decode=False) if library else Encoder(path)


def forget() -> None:
    """Empty this worker's encoders."""
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        gc.collect()
        release_memory()


MEMORIES["bpe"] = forget
OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id``, ``ids`` (array of int) and ``decoded`` of every whole text."""
    path = vocabulary or default_vocabulary()
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for p in pieces(b):
                got = list(enc.batch(p.column("text").to_pylist()))
                yield as_batch({"doc_id": p.column("doc_id"), "ids": [np.frombuffer(i, "<u4").astype("i4") for i, _ in got],
                                "decoded": [d for _, d in got]}, schema)

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id`` and ``decoded``, the text of ``ids``."""
    path = vocabulary or default_vocabulary()
    schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = encoder(path).v.names
        for b in batches:
            got = [None if ids is None else " ".join([names[i] for i in ids if i in names]) for ids in b.column("ids").to_pylist()]
            yield as_batch({"doc_id": b.column("doc_id"), "decoded": got}, schema)

    return encoded.selectExpr("cast(doc_id as long) doc_id", "ids").mapInArrow(run, "doc_id long, decoded string")


def encode_digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """As ``encode``, with counts and digests in place of ids and decoded text, which never leave the task."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for p in pieces(b):
                got = [(len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(d.encode()).hexdigest())
                       for i, d in enc.batch(p.column("text").to_pylist())]
                n, ids, dec = zip(*got, strict=True)
                yield as_batch({"doc_id": p.column("doc_id"), "n_tokens": n, "ids_sha256": ids, "decoded_sha256": dec}, OUT)

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
