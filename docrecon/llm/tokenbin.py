"""Token-ID output: flat unsigned integer files with 64-bit document offsets, read back by memory mapping.

A shard is a pair of files. ``.bin`` holds the token ids of its documents one after another, little-endian, in 16 bits
where every id fits and else in 32. ``.idx`` holds the magic ``TOKIDX01``, the width in bytes and the number n of
documents (both uint64), n document ids (int64), n flags (uint64, 1 where the document id is null) and n + 1 offsets
(uint64, counted in tokens). Shards hold ascending, disjoint ranges of documents; the position of a shard's first token
in the whole output is the prefix sum of the totals of the shards before it.

Edge cases: a null or empty text is one end token. A null document id comes first. Rows that share a document id are
kept, all of them, in the order of a hash of their text. An empty table gives no shard. Other columns are ignored. A
text is encoded whole, whatever its length. Files of attempts that failed stay behind under names that no manifest lists.
"""

from __future__ import annotations

import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docrecon.llm.ranges import bucket_of, cut_points, shuffle_parts, spread_of
from docrecon.llm.storage import bounded, create, fresh_path, map_array, materialize

MAGIC = b"TOKIDX01"
MANIFEST = "shard int, bin string, idx string, width int, n_docs long, n_tokens long"
#: Chunks that a Python worker remembers before it starts anew.
CACHED_WORDS = 400_000
_TAIL = ".,;:!?*%&$#|"
#: Lower-case letters of Latin scripts, none of which a normaliser for composed text takes apart.
_LETTERS = [c for c in map(chr, [*range(0x61, 0x7B), *range(0xDF, 0x180)]) if c.isalpha() and c.lower() == c and is_normalized("NFKC", c)]
_encoders: dict[tuple[str, int], WordEncoder] = {}


class WordEncoder(dict):
    """Encodes texts with a tokenizer file; as a dictionary it remembers the packed ids of white-space separated chunks.

    Tokenizers that split at white space never merge across it, so a text's ids are those of its chunks in turn. Where
    this doesn't hold of a tokenizer (a probe tells), and for texts with its special strings or with controls that only
    Python takes for white space, texts are encoded whole. A chunk goes through the library's own normalizer,
    pre-tokenizer and model, which is what encoding does, without the cost of an Encoding each.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = t = Tokenizer.from_file(path)
        added = t.get_added_tokens_decoder()
        self.whole = [x.content for x in added.values()] + ["\x1c", "\x1d", "\x1e", "\x1f"]
        self.dtype = np.dtype("<u2" if max(t.get_vocab_size() - 1, end_id, *added, 0) < 1 << 16 else "<u4")
        self.end = self._packed([end_id])
        self.steps = (t.normalizer, t.pre_tokenizer, t.model)
        probe = ["a b", "Ab, cd.  ef\n1 2", "x%% y**", "\xe9 \xf6\u0308 \xc9t\xe9,", " it's 's"]
        self.by_chunk = self.lowers = False
        self.letters, self.spelled = frozenset(), {}
        if all(self.steps) and not any(" " in x.content for x in added.values()):
            self.by_chunk = [b"".join(map(self.__getitem__, p.split())) for p in probe] == [self._encode(p) for p in probe]
            self.lowers = self._encode("AbC \xc9") == self._encode("abc \xe9")
            if self.by_chunk:
                self.letters, self.spelled = self._plain_letters()

    def _plain_letters(self) -> tuple[frozenset, dict]:
        """The letters of which a run is one piece, and what each is spelled as in a piece: such a run needs the model
        alone. None if the splitter joins or cuts runs of them in another way, which all of them in several orders tell."""
        normalizer, splitter, _ = self.steps
        pieces = lambda text: [piece for piece, _ in splitter.pre_tokenize_str(normalizer.normalize_str(text))]
        spelled = {c: own[0] for c in _LETTERS if normalizer.normalize_str(c) == c and len(own := pieces(c)) == 1}
        runs = ["".join(list(spelled)[::step] * 2) for step in (1, -1, 3, 7, -5)]
        good = all(pieces(run) == ["".join(map(spelled.__getitem__, run))] for run in runs) if spelled else False
        return (frozenset(spelled), str.maketrans(spelled)) if good else (frozenset(), {})

    def _packed(self, ids) -> bytes:
        return array(self.dtype.char, ids).tobytes() if sys.byteorder == "little" else np.asarray(ids, self.dtype).tobytes()

    def _encode(self, text: str) -> bytes:
        return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, chunk: str) -> bytes:
        word = chunk.rstrip(_TAIL)
        if word == chunk and self.letters.issuperset(chunk):
            packed = self._packed([token.id for token in self.steps[2].tokenize(chunk.translate(self.spelled))])
        elif word != chunk and word.isalpha():  # letters never share a piece with what is no letter
            tail = chunk[len(word) :]
            packed = self[word] + self[tail]
        else:
            normalizer, splitter, model = self.steps
            packed = self._packed([token.id for piece, _ in splitter.pre_tokenize_str(normalizer.normalize_str(chunk)) for token in model.tokenize(piece)])
        self[chunk] = packed
        return packed

    def _lower(self, text: str) -> str:
        """The text in lower case if that can't change its ids, so that fewer chunks need remembering."""
        if text.isascii():
            return text.lower()
        low = text.lower()
        plain = "\u03a3" not in text and "\u0130" not in text and is_normalized("NFC", text) and is_normalized("NFC", low)
        return low if plain else text

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text, packed, with the end id."""
        for text in texts:
            if not text:
                yield self.end
            elif not self.by_chunk or any(map(text.__contains__, self.whole)):
                yield self._encode(text) + self.end
            else:
                if len(self) > CACHED_WORDS:
                    self.clear()
                yield b"".join(map(self.__getitem__, (self._lower(text) if self.lowers else text).split())) + self.end


def encoder(path: str, end_id: int) -> WordEncoder:
    """The encoder of this Python worker, which lives on from task to task."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = WordEncoder(path, end_id)
    return _encoders[path, end_id]


def _write_index(uri: str, width: int, ids: list, lengths: list[int]) -> None:
    nulls = np.fromiter((i is None for i in ids), np.uint64, len(ids))
    keys = np.fromiter((i or 0 for i in ids), np.int64, len(ids))
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.uint64)]).astype("<u8")
    with create(uri) as file:
        file.write(MAGIC + np.array([width, len(ids)], "<u8").tobytes() + keys.astype("<i8").tobytes() + nulls.astype("<u8").tobytes() + offsets.tobytes())


def read_index(uri: str) -> tuple[int, list, np.ndarray]:
    """Width in bytes, document ids and offsets of a shard."""
    head = map_array(uri, "<u8", 0, 3)
    if head[:1].tobytes() != MAGIC:
        raise ValueError(f"{uri} is no token index")
    width, n = int(head[1]), int(head[2])
    keys, nulls = map_array(uri, "<i8", 24, n), map_array(uri, "<u8", 24 + 8 * n, n)
    ids = [None if null else int(key) for key, null in zip(keys, nulls, strict=True)]
    return width, ids, map_array(uri, "<u8", 24 + 16 * n, n + 1)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 1, out_dir: str | None = None, parts: int | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into shards below ``out_dir`` and return their manifest with each shard's ``base``.

    Texts move once, to the shard of their range of document ids; a task streams its shard to disk. Only the manifest
    (a row a shard) is gathered.
    """
    narrow = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = parts or shuffle_parts(docs)
    out_dir = out_dir or fresh_path(docs.sparkSession, "tokens")
    cuts = cut_points(narrow, "doc_id", parts)
    placed = narrow.withColumn("hash", F.xxhash64("text")).withColumn("tie", spread_of(F.col("text"))).withColumn("shard", bucket_of(F.col("doc_id"), spread_of(F.col("text")), cuts, "bigint"))
    ordered = placed.repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions(F.asc_nulls_first("shard"), F.asc_nulls_first("doc_id"), "tie", "hash")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, end_id)
        shard, stem, file, ids, lengths = None, "", None, [], []

        def done():
            file.close()
            _write_index(stem + ".idx", encode.dtype.itemsize, ids, lengths)
            row = (shard, stem + ".bin", stem + ".idx", encode.dtype.itemsize, len(ids), sum(lengths))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["shard", "bin", "idx", "width", "n_docs", "n_tokens"])

        for batch in batches:
            shards = batch.column("shard").to_pylist()
            for place, doc_id, packed in zip(shards, batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist()), strict=True):
                if place != shard:
                    if file:
                        yield done()
                    shard, ids, lengths = place, [], []
                    stem = f"{out_dir}/shard-{place:06d}-{uuid.uuid4().hex}"
                    file = create(stem + ".bin")
                file.write(packed)
                ids.append(doc_id)
                lengths.append(len(packed) // encode.dtype.itemsize)
        if file:
            yield done()

    manifest = materialize(ordered.select("doc_id", "text", "shard").mapInArrow(write, MANIFEST), "token-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame, parts: int | None = None) -> DataFrame:
    """Read shards back: doc_id, start (tokens before the document in the whole output), n_tokens, ids_crc32, first_ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                width, ids, offsets = read_index(row["idx"])
                tokens = map_array(row["bin"], f"<u{width}", 0, row["n_tokens"])
                for at in range(0, len(ids), 4096):
                    ends = offsets[at : at + 4097].astype(np.int64)
                    crcs = [zlib.crc32(tokens[a:b].astype("<u4").tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[at : at + 4096], pa.int64()), pa.array(ends[:-1] + row["base"]), pa.array(np.diff(ends)), pa.array(crcs, pa.int64()), pa.array([row["shard"]] * len(crcs), pa.int32())],
                        ["doc_id", "start", "n_tokens", "ids_crc32", "shard"],
                    )

    parts = parts or shuffle_parts(manifest)
    dealt = manifest.select("shard", "bin", "idx", "n_tokens", "base").repartitionById(parts, F.pmod(F.col("shard"), F.lit(parts)))
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 1, out_dir: str | None = None) -> DataFrame:
    """Write ``docs`` as token files and return what the files say of each document."""
    return read_tokens(write_tokens(docs, tokenizer, end_id, out_dir))
