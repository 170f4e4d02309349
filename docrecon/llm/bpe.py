"""Byte-level BPE: encoding by merges in the order of their ranks, found by a segment tree, and decoding.

A text falls into words by the pattern of byte-level tokenizers, a word into bytes. A segment tree stands over the ranks of
a word's adjacent pairs: its root is the leftmost pair of the lowest rank, and after a merge three leaves change, each on a
way of logarithmic length. So a word of n bytes takes n log n steps, however long it is. The trees of the short words that
some texts hold anew take their steps together, in vectors. Workers remember words of moderate length, as most words of a
corpus are repeats.

Edge cases: a null or empty text has no ids. The strings of added tokens are single ids wherever they stand. A null list of
ids is an empty text; null ids and ids that the vocabulary lacks are skipped. Bytes that are no UTF-8 become U+FFFD. Rows
that repeat, and rows with a null id, are kept as they are. Texts are encoded whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from docrecon.llm.ranges import pieces
from docrecon.llm.storage import bounded

#: The pattern of byte-level pre-tokenization, a fixed value of this kind of tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that a worker remembers before it starts anew, and the longest of them in characters.
CACHED_WORDS, CACHED_LENGTH = 400_000, 64
#: Bytes of the longest words whose trees take their steps together, and words that do so at once.
SHORT, TOGETHER = 64, 8192
#: Characters of a text from which its words are taken in parts, and words of a part.
LONG, PART = 1 << 20, 1 << 16
_NONE = 1 << 62
_coders: dict[str, Coder] = {}


def byte_chars() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is printable, else one above 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def merged(ids: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """``ids`` after all merges. ``ranks`` has a pair's rank and what it merges to."""
    n = len(ids)
    if n < 2:
        return ids
    size = 1 << (n - 1).bit_length()
    tree = [_NONE] * (2 * size)  # rank * n + place of the pair's left part, so that the least is the leftmost
    for i, pair in enumerate(zip(ids, ids[1:], strict=False)):
        if found := ranks.get(pair):
            tree[size + i] = found[0] * n + i
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])
    ids, left, right = list(ids), list(range(-1, n - 1)), list(range(1, n + 1))

    def update(i: int) -> None:
        """The leaf of the pair that begins at ``i``, and what stands above it as far as that changes."""
        found = ranks.get((ids[i], ids[right[i]])) if ids[i] >= 0 and right[i] < n else None
        k, value = size + i, found[0] * n + i if found else _NONE
        while k and tree[k] != value:
            tree[k] = value
            value, k = min(value, tree[k ^ 1]), k >> 1

    while tree[1] != _NONE:
        i = tree[1] % n
        gone = right[i]
        ids[i] = ranks[ids[i], ids[gone]][1]
        ids[gone], right[i] = -1, right[gone]
        if right[i] < n:
            left[right[i]] = i
        update(gone)
        update(i)
        if left[i] >= 0:
            update(left[i])
    return [x for x in ids if x >= 0]


class Pairs:
    """Ranks of pairs of ids and what they merge to, in vectors, and the ids of bytes."""

    def __init__(self, ranks: dict[tuple[int, int], tuple[int, int]], singles: list[int]):
        self.singles = np.array(singles, np.int64)
        keys = np.array([a << 32 | b for a, b in ranks], np.int64)
        order = np.argsort(keys)
        told = np.array([*ranks.values()], np.int64).reshape(-1, 2)
        self.keys = np.append(keys[order], _NONE)
        self.ranks = np.append(told[order, 0], -1)
        self.made = np.zeros(len(told) and told[:, 0].max() + 1, np.int64)
        self.made[told[:, 0]] = told[:, 1]

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 if it has none."""
        key = a << 32 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def merged(self, words: list[bytes], dtype: np.dtype) -> list[bytes]:
        """What ``merged`` gives for each of some words, packed; they have two bytes at least and about as many as one another."""
        lengths = np.array(list(map(len, words)))
        most = int(lengths.max())
        size = 1 << (most - 1).bit_length()  # a leaf for each place; the last place of a word never has a pair
        ids = np.full((len(words), size), -1, np.int64)
        ids[np.arange(size) < lengths[:, None]] = self.singles[np.frombuffer(b"".join(words), np.uint8)]
        right = np.tile(np.arange(1, size + 1), (len(words), 1))
        left = right - 2
        leaves = lambda rank, place: np.where(rank >= 0, rank * size + place, _NONE)
        tree = np.full((len(words), 2 * size), _NONE, np.int64)
        whole = ids[:, 1:] >= 0
        found = np.full(whole.shape, -1, np.int64)
        found[whole] = self.of(ids[:, :-1][whole], ids[:, 1:][whole])
        tree[:, size : 2 * size - 1] = leaves(found, np.arange(size - 1))
        level = size
        while (level := level // 2) >= 1:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        open_ = np.flatnonzero(tree[:, 1] != _NONE)
        while len(open_):
            w, (rank, i) = open_, np.divmod(tree[open_, 1], size)
            gone, new = right[w, i], self.made[rank]
            after, before = right[w, gone], left[w, i]
            ids[w, i], ids[w, gone], right[w, i] = new, -1, after
            follows, leads = after < lengths[w], before >= 0
            left[w[follows], after[follows]] = i[follows]
            rank = np.full((2, len(w)), -1, np.int64)
            rank[0, follows] = self.of(new[follows], ids[w[follows], after[follows]])
            rank[1, leads] = self.of(ids[w[leads], before[leads]], new[leads])
            tree[w, size + gone] = _NONE
            tree[w, size + i] = leaves(rank[0], i)
            before = np.where(leads, before, i)
            tree[w[leads], size + before[leads]] = leaves(rank[1], before)[leads]
            nodes = size + np.stack([gone, i, before])
            while nodes[0, 0] > 1:
                nodes >>= 1
                tree[w, nodes] = np.minimum(tree[w, 2 * nodes], tree[w, 2 * nodes + 1])
            open_ = w[tree[w, 1] != _NONE]
        kept = ids >= 0
        packed, ends = ids[kept].astype(dtype).tobytes(), (np.cumsum(kept.sum(axis=1)) * dtype.itemsize).tolist()
        return [packed[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class Coder(dict):
    """A byte-level BPE tokenizer of a file; as a dictionary it remembers the packed ids of words."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, added = spec["model"], spec["added_tokens"]
        # Rearranging words, prefixes and the like would need code of their own.
        plain = spec["normalizer"] is None and spec["pre_tokenizer"] | {"trim_offsets": True} == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        if not plain or odd or model["type"] != "BPE" or any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path} is no plain byte-level BPE tokenizer {odd}")
        vocab, chars = model["vocab"], byte_chars()
        self.dtype = np.dtype("<i4")
        self.bytes = [vocab[c] for c, _ in sorted(chars.items(), key=lambda x: x[1])]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.pairs = Pairs(self.ranks, self.bytes)
        self.added = {t["content"]: self._packed([t["id"]]) for t in added}
        self.split = re.compile("(" + "|".join(re.escape(c) for c in sorted(self.added, key=len, reverse=True)) + ")") if added else None
        self.words = regex.compile(PATTERN)
        self.tokens = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in added)]))
        for token, i in [*vocab.items(), *((t["content"], t["id"]) for t in added)]:
            self.tokens[i] = bytes(map(chars.__getitem__, token)) if all(c in chars for c in token) else token.encode()
        self.stored = pa.array(self.tokens, pa.large_binary())

    def _packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def __missing__(self, word: str) -> bytes:
        packed = self._packed(merged([self.bytes[b] for b in word.encode()], self.ranks))
        if len(word) <= CACHED_LENGTH:
            self[word] = packed
        return packed

    def learn(self, words: set[str]) -> None:
        """Remember the short ones of these words, worked out together."""
        by_size: dict[int, tuple[list[str], list[bytes]]] = {}
        for word in words:
            own = word.encode()
            if 2 <= len(own) <= SHORT:
                names, raw = by_size.setdefault((len(own) - 1).bit_length(), ([], []))
                names.append(word)
                raw.append(own)
        for names, raw in by_size.values():
            for k in range(0, len(raw), TOGETHER):
                self.update(zip(names[k : k + TOGETHER], self.pairs.merged(raw[k : k + TOGETHER], self.dtype), strict=True))

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """``encode`` of each text."""
        out: list[bytes] = []
        held: list[tuple[str | None, list[str] | None, list[bytes | None]]] = []
        new: set[str] = set()
        room = 0
        for text in texts:
            plain = text and len(text) < LONG and not any(map(text.__contains__, self.added))
            own = self.words.findall(text) if plain else None
            got = list(map(self.get, own)) if own else []
            if None in got:
                new.update(word for word, ids in zip(own, got, strict=True) if ids is None)
            held.append((text, own, got))
            room += len(got)
            if room >= PART:
                out += self._joined(held, new)
                held, new, room = [], set(), 0
        return out + self._joined(held, new)

    def _joined(self, held: list[tuple[str | None, list[str] | None, list[bytes | None]]], new: set[str]) -> list[bytes]:
        """The packed ids of texts, of which the words and what is known of them are there; unknown ones are ``new``."""
        if len(self) > CACHED_WORDS:
            self.clear()
        self.learn(new)
        whole = lambda own, got: [self[w] if x is None else x for w, x in zip(own, got, strict=True)] if None in got else got
        return [self.encode(text) if own is None else b"".join(whole(own, got)) for text, own, got in held]

    def _parts(self, text: str) -> Iterator[list[str]]:
        """The text's words, of a long text in parts."""
        if len(text) < LONG:
            yield self.words.findall(text)
        else:
            found = (m.group() for m in self.words.finditer(text))
            while part := list(islice(found, PART)):
                yield part

    def _plain(self, text: str) -> bytes:
        out = []
        for part in self._parts(text):
            if len(self) > CACHED_WORDS:
                self.clear()
            out.append(b"".join(map(self.__getitem__, part)))
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """The ids of a text, packed."""
        if not text:
            return b""
        if not any(map(text.__contains__, self.added)):
            return self._plain(text)
        return b"".join(self.added.get(x) or self._plain(x) for x in self.split.split(text) if x)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> Iterator[str]:
        """The text of each list of ``ids``: they lie one after another, from one of ``ends`` to the next."""
        own = ids[ends[0] : ends[-1]]
        known = (own >= 0) & (own < len(self.tokens))
        _, offsets, data = self.stored.take(pa.array(own[known], pa.int32())).buffers()
        at = np.frombuffer(offsets, np.int64)[np.concatenate([[0], np.cumsum(known)])[ends - ends[0]]].tolist()
        view = memoryview(data or b"")
        return (str(view[a:b], "utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True))


def coder(path: str) -> Coder:
    """The tokenizer of this Python worker, which lives on from task to task."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``docs`` (doc_id, text) encoded by the file ``tokenizer``, which every executor can open: doc_id, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(tokenizer)
        for piece in pieces(batches, 4096):
            packed = own.encode_all(piece.column("text").to_pylist())
            ends = np.cumsum([0, *map(len, packed)]) // own.dtype.itemsize
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), own.dtype)))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), ids], ["doc_id", "ids"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return bounded(texts).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``encoded`` with its column ``ids`` decoded to ``text``, which takes that column's place."""
    fields = [StructField("text", StringType()) if f.name == "ids" else f for f in encoded.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(tokenizer)
        for batch in batches:
            place = batch.schema.get_field_index("ids")
            lists = batch.column(place)
            ids = pc.fill_null(lists.values, -1).to_numpy(zero_copy_only=False)
            found = own.decode(ids, lists.offsets.to_numpy()) if len(lists) else ()
            texts = pa.array([text if known else "" for text, known in zip(found, lists.is_valid().to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([texts if k == place else c for k, c in enumerate(batch.columns)], [f.name for f in fields])

    return bounded(encoded.withColumn("ids", F.col("ids").cast("array<int>"))).mapInArrow(run, StructType(fields))
