"""Benchmark decontamination by latent semantic retrieval and a check by longest common subsequence.

The terms are pairs of neighbouring words, and the pairs of the benchmark items are the vocabulary. Documents are cut
into overlapping passages of words. TF-IDF weights come from document frequencies counted over all documents. A randomised
singular value decomposition gives the latent space: tasks add up the products of the term counts T of all passages of
all documents, the Gram matrix T'T; its product with random directions O, worked out by rows, gives its range, and Nystroem's formula the leading directions; benchmark
items enter with weight, so that their own directions are among them. Every passage is then projected and compared
with every item; a candidate's product reaches ``COSINE`` of the square of the passage's or of the item's length. The
former is the cosine, the latter the share of the item that the passage holds: it doesn't fall when an item stands in so
many documents that its terms weigh little beside the passage's others. Passages are projected only if the greatest
products that their terms can add reach that, so the test leaves no candidate out, however many documents share it. A
candidate is confirmed on its text: the longest common subsequence of words of the item and of some stretch of the text
round the passage must cover ``COVER`` of the item, or ``COVER_LOOSE`` of it if the item's answer (its last sentence)
stands there as a whole. All stretches are tried that hold enough of the item's words. An item of fewer than ``LEAST``
words is too short to be paraphrased: it counts where all its words stand in a row.

The benchmark is a set of queries held by every task. Items are cut into passages as documents are, and each passage is a
query of its own, so that a long item is found by any part of it. A latent space serves a block of ``QUERIES`` queries,
half its rank, since a space holds no more nearly orthogonal items than it has directions; an item with more has a block
to itself, of a rank to match. Documents are read twice for every ``GROUP`` blocks, to count and to search, and never
joined or shuffled. Counts, the fit and the search cover every row and whole texts; what a block's counts take is bounded
by the square of its terms, whatever the documents.

Edge cases: null or empty texts and items contain nothing. Rows that share an id are searched one by one, repeated rows
too; a null id is passed through, and an item without an id is left out. An empty table on either side gives no hits.
Other columns, whatever their names, are kept by ``uncontaminated`` and ignored by ``contaminated``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrecon.llm.ranges import pieces
from docrecon.llm.shingles import hash_words, mix
from docrecon.llm.storage import bounded, materialize

#: Latent dimensions and extra directions of the sketch; tasks that make it; queries in a block; blocks searched in one
#: reading; products of counts that a task holds.
RANK, EXTRA, FIT_TASKS, QUERIES, GROUP, PAIRS = 256, 32, 8, 128, 16, 1 << 20
COSINE, COVER, COVER_LOOSE, LEAST = 0.35, 0.7, 0.5, 8
#: Words of a passage, and the step from one to the next.
PASSAGE, STEP = 64, 32
# Words are runs of letters, digits and whatever isn't ASCII; everything else becomes a space.
_SPACED = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def normal(text: str | None) -> bytes:
    """A text in lower case with its words apart."""
    return (text or "").lower().encode().translate(_SPACED)


def tokens(text: str | None) -> list[bytes]:
    """Lower-case words."""
    return normal(text).split()


@dataclass
class Items:
    """A block of benchmark items, their terms, and the latent space once it is fitted."""

    ids: list[int]
    words: list[list[bytes]]
    answers: list[list[bytes]]
    idf: np.ndarray | None = None
    pull: np.ndarray | None = None
    basis: np.ndarray | None = None
    latent: np.ndarray | None = None
    norm: np.ndarray | None = None
    item: np.ndarray | None = None  # of each query

    def __post_init__(self):
        self.hashed = [hash_words([b" ".join(w)])[0] for w in self.words]
        self.said = [hash_words([b" ".join(a)])[0] for a in self.answers]
        self.short = [j for j, w in enumerate(self.words) if len(w) < LEAST]
        self.long = [j for j, w in enumerate(self.words) if len(w) >= LEAST]
        self.terms = np.unique(np.concatenate([pairs(self.hashed[j]) for j in self.long] or [np.zeros(1, np.uint64)]))
        self.maybe = np.zeros(1 << 20, bool)  # by the leading bits, so that few words need a search
        self.maybe[self.terms >> np.uint64(44)] = True

    def numbered(self, hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Of all words of some texts, as ``hashed`` has them, the numbers of the terms that begin there (-1: none in the
        vocabulary)."""
        if not len(hashes):
            return np.zeros(0, np.int64)
        found = np.append(pairs(hashes), np.uint64(0))
        ids = np.full(len(found), -1)
        some = np.flatnonzero(self.maybe[found >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.terms, found[some]), len(self.terms) - 1)
        ids[some] = np.where(self.terms[at] == found[some], at, -1)
        ids[begins[1:][np.diff(begins) > 0] - 1] = -1  # no term reaches into the next text
        return ids


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the texts laid end to end, and where each text's begin."""
    return hash_words([normal(t) for t in texts])


def pairs(hashes: np.ndarray) -> np.ndarray:
    """A hash of each word and the next."""
    return mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])


def passages(begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first and last (exclusive) word of each passage. A text's last passage ends with it."""
    count = np.diff(begins)
    n = np.where(count > 0, 1 + np.maximum(0, -(-(count - PASSAGE) // STEP)), 0)
    owner = np.repeat(np.arange(len(count)), n)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    low = begins[owner] + nth * STEP
    return owner, low, np.minimum(low + PASSAGE, begins[owner + 1])


def read_items(benchmark: DataFrame, block: int = QUERIES) -> Iterator[Items]:
    """The benchmark in blocks of ``block`` queries. Each block is bounded, whatever the table's size."""
    held: list[tuple[int, list[bytes], list[bytes]]] = []
    queries = 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL")
    for row in rows.orderBy("item_id").toLocalIterator():
        words = tokens(row["text"])
        if words:
            sentences = [tokens(s) for s in re.split(r"[.!?\n]+", row["text"])]
            answer = next((s for s in reversed(sentences) if s), [])
            own = len(passages(np.array([0, len(words)]))[0])
            if held and queries + own > block:
                yield Items(*map(list, zip(*held, strict=True)))
                held, queries = [], 0
            held.append((row["item_id"], words, answer))
            queries += own
    if held:
        yield Items(*map(list, zip(*held, strict=True)))


def counted(docs: DataFrame, blocks: Sequence[Items]) -> DataFrame:
    """block, i, j, n over all documents, which are read once: of each block the sums over passages of the products of the
    counts of its terms i <= j; under block -1 the number of documents that hold term i (of all blocks in turn), and of
    all documents where i is -1. Sums of whole numbers, so they are the same however rows are dealt to tasks."""
    shared = docs.sparkSession.sparkContext.broadcast(list(blocks))
    first = np.cumsum([0, *(len(items.terms) for items in blocks)])

    def rows(block: int, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(i), block, np.int32)), pa.array(i), pa.array(j), pa.array(n)], ["block", "i", "j", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs_, held, sizes = np.zeros(first[-1], np.int64), 0, {}, {}

        def flushed(block: int, least: int) -> Iterator[pa.RecordBatch]:
            """Sums what is held of a block, and hands it on if ``least`` pairs are left."""
            key, n = map(np.concatenate, zip(*held.pop(block), strict=True))
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            key, n = key[at], np.add.reduceat(n, at)
            if len(key) >= least:
                size = len(shared.value[block].terms)
                yield rows(block, key // size, key % size, n)
            else:
                held[block] = [(key, n)]

        for piece in pieces(batches, 128):
            hashes, begins = hashed(piece.column("text").to_pylist())
            docs_ += len(begins) - 1
            owner = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
            for block, (low, items) in enumerate(zip(first, shared.value, strict=False)):
                ids, size = items.numbered(hashes, begins), len(items.terms)
                seen = np.unique((owner * size + ids)[ids >= 0])
                total[low : low + size] += np.bincount(seen % size, minlength=size)
                if not items.long or not len(seen):
                    continue
                for key, n in _products(*_counts(ids, begins, items)[:3], size):
                    held.setdefault(block, []).append((key, n))
                    sizes[block] = sizes.get(block, 0) + len(key)
                    if sizes[block] > PAIRS:
                        yield from flushed(block, PAIRS // 2)
                        sizes[block] = sum(len(k) for k, _ in held.get(block, ()))
        for block in list(held):
            yield from flushed(block, 0)
        hit = np.flatnonzero(total)
        yield rows(-1, np.append(hit, -1), np.full(len(hit) + 1, -1), np.append(total[hit], docs_))

    summed = bounded(docs).select(F.col("text").cast("string").alias("text")).mapInArrow(count, "block int, i long, j long, n long")
    return materialize(summed.groupBy("block", "i", "j").agg(F.sum("n").alias("n")), "decontam-counts")


def _products(row: np.ndarray, col: np.ndarray, times: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of coordinates in order of passages and terms, i * size + j and the product of the counts for each two terms i <= j
    of a passage, a bounded number at a time."""
    last = np.searchsorted(row, row, "right")
    many = last - np.arange(len(row))
    ends = np.cumsum(many)
    low = 0
    while low < len(row):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PAIRS, "right")))
        a = np.repeat(np.arange(low, high), many[low:high])
        b = a + np.arange(len(a)) - np.repeat(np.cumsum(many[low:high]) - many[low:high], many[low:high])
        yield col[a] * np.int64(size) + col[b], times[a] * times[b]
        low = high


def document_frequencies(counts: DataFrame, blocks: Sequence[Items]) -> tuple[list[np.ndarray], int]:
    """Number of documents that hold each term of each block, and of all documents."""
    first = np.cumsum([0, *(len(items.terms) for items in blocks)])
    table = counts.filter("block = -1").select(F.col("i").alias("word"), "n").toArrow()  # at most a row for each term of the blocks
    word, times = (table.column(c).to_numpy() for c in ("word", "n"))
    out = np.zeros(first[-1])
    out[word[word >= 0]] = times[word >= 0]
    return np.split(out, first[1:-1]), int(times[word < 0].sum())


def _counts(ids: np.ndarray, begins: np.ndarray, items: Items, telling: bool = False) -> tuple[np.ndarray, ...]:
    """Term counts of passages as coordinates: passage, word, count; and the passages' texts and bounds. Telling: of
    passages that can reach ``COSINE`` with some item only."""
    owner, low, high = passages(begins)
    if telling:
        weight, pull, share = (np.concatenate([[0], np.cumsum(x[ids])]) for x in items.pull)
        # The root is at most the passage's length, as a term's squares add up to no more than its count's square.
        length = np.sqrt(np.maximum(weight[high] - weight[low], 0))
        least = COSINE - 1e-3  # room for rounding
        some = (weight[high] > weight[low]) & ((pull[high] - pull[low] >= least * length) | (share[high] - share[low] >= least))
        owner, low, high = owner[some], low[some], high[some]
    length = high - low
    at = np.repeat(low - (np.cumsum(length) - length), length) + np.arange(length.sum())
    row, col = np.repeat(np.arange(len(low)), length), ids[at]
    keep = col >= 0
    key, times = np.unique(row[keep] * np.int64(len(items.terms)) + col[keep], return_counts=True)
    return key // len(items.terms), key % len(items.terms), times, owner, low, high


def _project(row: np.ndarray, col: np.ndarray, value: np.ndarray, basis: np.ndarray, n: int) -> np.ndarray:
    """The product of a sparse matrix (coordinates in order of rows) with a dense one."""
    out = np.zeros((n, basis.shape[1]), basis.dtype)
    for at in range(0, len(row), 1 << 15):
        r = row[at : at + (1 << 15)]
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        out[r[first]] += np.add.reduceat(basis[col[at : at + len(r)]] * value[at : at + len(r), None], first, axis=0)
    return out


def fit(docs: DataFrame, blocks: Sequence[Items], rank: int = RANK) -> list[Items]:
    """Document frequencies and the latent space of each block, both of all documents."""
    counts = counted(docs, blocks)
    frequencies, n = document_frequencies(counts, blocks)
    return [_fit_block(counts.filter(F.col("block") == k), items, found, n, rank) for k, (items, found) in enumerate(zip(blocks, frequencies, strict=True))]


def _fit_block(products: DataFrame, items: Items, found: np.ndarray, n: int, rank: int) -> Items:
    items.idf = np.log((n + 1) / (found + 1)) + 1
    size = len(items.terms)
    if not items.long:
        return items
    own_hashes, own_begins = hash_words([b" ".join(items.words[j]) for j in items.long])
    own_ids = items.numbered(own_hashes, own_begins)
    row, col, times, item, *_ = _counts(own_ids, own_begins, items)
    items.item = np.array(items.long)[item]
    queries = len(item)
    rank = max(rank, 2 * queries)
    width = min(rank + EXTRA, size)
    directions = np.random.default_rng(17).standard_normal((size, width))

    idf = items.idf

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions = np.random.default_rng(17).standard_normal((size, width))
        total = np.zeros((size, width))
        for batch in batches:
            i, j, n = (batch.column(c).to_numpy() for c in ("i", "j", "n"))
            for low in range(0, len(i), 1 << 13):  # a slice at a time, each pair a row of sums wide
                r, c = i[low : low + (1 << 13)], j[low : low + (1 << 13)]
                at = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                total[r[at]] += np.add.reduceat(directions[c] * (n[low : low + (1 << 13)] * idf[r] * idf[c])[:, None], at, axis=0)
        hit = np.flatnonzero(np.abs(total).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array([hit.astype("<i8").tobytes()], pa.binary()), pa.array([total[hit].astype("<f4").tobytes()], pa.binary())], ["words", "sums"])

    def gram(ids: np.ndarray, begins: np.ndarray, directions: np.ndarray) -> np.ndarray:
        out = np.zeros((size, width))
        row, col, times, owner, *_ = _counts(ids, begins, items)
        value = times * items.idf[col]
        sums = _project(row, col, value, directions, len(owner))
        for low in range(0, len(row), 1 << 13):  # a slice of the coordinates at a time, each a row of sums wide
            part = slice(low, low + (1 << 13))
            np.add.at(out, col[part], value[part, None] * sums[row[part]])
        return out

    range_ = np.zeros((size, width))
    mirrored = products.select("i", "j", "n").unionByName(products.filter("i != j").select(F.col("j").alias("i"), F.col("i").alias("j"), "n"))
    dealt = mirrored.repartition(FIT_TASKS, "i").sortWithinPartitions("i", "j")
    for r in dealt.mapInArrow(sketch, "words binary, sums binary").toLocalIterator():  # a row of sums for each term, whatever the tasks
        range_[np.frombuffer(r["words"], "<i8")] += np.frombuffer(r["sums"], "<f4").reshape(-1, width)
    # Items count as much as all documents, else the corpus's common words would take all directions.
    own = gram(own_ids, own_begins, directions)
    ratio = np.linalg.norm(range_) / max(np.linalg.norm(own), 1e-12)
    range_ += own * max(ratio, 1.0)
    inner = directions.T @ range_
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    good = values > values.max() * 1e-10
    root = range_ @ (vectors[:, good] / np.sqrt(values[good]))
    left, strength, _ = np.linalg.svd(root, full_matrices=False)
    items.basis = np.ascontiguousarray(left[:, : min(rank, int((strength > 1e-9).sum()))]).astype(np.float32)
    value = (times * items.idf[col]).astype(np.float32)
    latent = _project(row, col, value, items.basis, queries)
    items.latent = latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    items.norm = np.sqrt(np.bincount(row, value * value, queries)).astype(np.float32)
    # By term the square of its weight, and the most it adds to a product with an item, as such and by the item's length.
    most, share = np.zeros(size), np.zeros(size)
    for low in range(0, size, 4096):
        product = items.basis[low : low + 4096] @ items.latent.T
        most[low : low + 4096] = product.max(axis=1)
        share[low : low + 4096] = (product / np.maximum(items.norm, 1e-12)).max(axis=1)
    items.pull = np.stack([items.idf**2, items.idf * np.maximum(most, 0), items.idf * np.maximum(share, 0)])
    items.pull = np.concatenate([items.pull, np.zeros((3, 1))], axis=1)  # the last is for terms outside the vocabulary
    return items


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bits of one long integer."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    row = (1 << len(a)) - 1
    for x in b:
        match = row & where.get(x, 0)
        row = (row + match) | (row - match)
    return len(a) - (row & (1 << len(a)) - 1).bit_count()


def holds(part: list, whole: list) -> bool:
    """Whether ``part`` stands in ``whole`` word by word."""
    return any(whole[i : i + len(part)] == part for i in range(len(whole) - len(part) + 1)) if part else False


def search(texts: list[str | None], blocks: Sequence[Items]) -> list[tuple[int, int, int, float, float, bool]]:
    """Confirmed hits: text, item, first word, cosine, share of the item covered, whether its answer is there."""
    hashes, begins = hashed(texts)
    return [hit for items in blocks for hit in [*_search_short(hashes, begins, items), *_search_block(hashes, begins, items)]] if len(hashes) else []


def _search_short(hashes: np.ndarray, begins: np.ndarray, items: Items) -> list[tuple[int, int, int, float, float, bool]]:
    """Where all words of a short item stand in a row: the first place in each text."""
    out = []
    ends = begins[1:]
    for j in items.short:
        item = items.hashed[j]
        at = np.flatnonzero(hashes == item[0])
        for k in range(1, len(item)):
            at = at[at + k < len(hashes)]
            at = at[hashes[at + k] == item[k]]
        text = np.searchsorted(ends, at, "right")
        inside = at + len(item) <= ends[text]
        for t, first in dict(zip(text[inside][::-1].tolist(), at[inside][::-1].tolist(), strict=True)).items():
            out.append((int(t), items.ids[j], int(first - begins[t]), 1.0, 1.0, True))
    return sorted(out)


def _search_block(hashes: np.ndarray, begins: np.ndarray, items: Items) -> list[tuple[int, int, int, float, float, bool]]:
    if not items.long:
        return []
    ids = items.numbered(hashes, begins)
    row, col, times, owner, low, high = _counts(ids, begins, items, telling=True)
    value = (times * items.idf[col]).astype(np.float32)
    norm = np.sqrt(np.bincount(row, value * value, len(owner)))
    latent = _project(row, col, value, items.basis, len(owner))
    product = latent @ items.latent.T
    cosine = product / np.maximum(norm, 1e-12)[:, None]
    best: dict[tuple[int, int], tuple] = {}
    for p, q in zip(*np.nonzero((cosine >= COSINE) | (product >= COSINE * items.norm)), strict=True):
        j = items.item[q]
        t, item, answer = int(owner[p]), items.hashed[j], items.said[j]
        # The item may reach over the passage's ends: compare with as much of the text around it.
        found = hashes[max(begins[t], low[p] - len(item)) : min(begins[t + 1], high[p] + len(item))]
        if np.isin(item, found).sum() < COVER_LOOSE * len(item):
            continue
        cover = covered(item, found)
        said = len(answer) >= 3 and holds(answer.tolist(), found.tolist())
        if cover >= COVER or cover >= COVER_LOOSE and said:
            key = (t, int(j))
            hit = (t, int(j), int(low[p] - begins[t]), float(cosine[p, q]), cover, said)
            if key not in best or (hit[4], hit[3]) > (best[key][4], best[key][3]):
                best[key] = hit
    return [(k[0], items.ids[k[1]], *best[k][2:]) for k in sorted(best)]


def covered(item: np.ndarray, found: np.ndarray) -> float:
    """The share of the item that the best stretch of ``found`` has as a subsequence. Stretches are three quarters longer
    than the item and begin at every quarter of it, so that any text half as long again as the item lies in one, and an
    item isn't pieced together from all over a long text."""
    n = len(item)
    step = max(1, n // 4)
    width = n + n // 2 + step
    if len(found) <= width:
        return common_subsequence(item.tolist(), found.tolist()) / n
    inside = np.concatenate([[0], np.cumsum(np.isin(found, item))])
    starts = np.arange(0, len(found) - n // 2, step)
    held = inside[np.minimum(starts + width, len(found))] - inside[starts]
    words, best = item.tolist(), 0
    for k in np.argsort(-held, kind="stable"):
        if held[k] <= best or best == n:  # no stretch has more in common than words of the item
            break
        best = max(best, common_subsequence(words, found[starts[k] : starts[k] + width].tolist()))
    return best / n


HITS = "doc_id long, item_id long, first_word long, cosine double, cover double, answer boolean"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word, cosine, cover, answer: a row for each document and item that it contains."""
    out = docs.sparkSession.createDataFrame([], HITS)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for blocks in batched(read_items(benchmark), GROUP):
        shared = docs.sparkSession.sparkContext.broadcast(fit(plain, blocks))  # a block's size is bounded

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            blocks = shared.value
            for piece in pieces(batches, 128):
                keys = piece.column("doc_id").to_pylist()
                hits = search(piece.column("text").to_pylist(), blocks)
                yield pa.RecordBatch.from_arrays([pa.array([keys[h[0]] for h in hits], pa.int64()), pa.array([h[1] for h in hits], pa.int64()), pa.array([h[2] for h in hits], pa.int64()), pa.array([h[3] for h in hits], pa.float64()), pa.array([h[4] for h in hits], pa.float64()), pa.array([h[5] for h in hits], pa.bool_())], ["doc_id", "item_id", "first_word", "cosine", "cover", "answer"])

        out = out.unionByName(plain.mapInArrow(run, HITS))
    return out


def uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns. Rows are searched where they lie."""
    for blocks in batched(read_items(benchmark), GROUP):
        shared = docs.sparkSession.sparkContext.broadcast(fit(docs.select("doc_id", "text"), blocks))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            blocks = shared.value
            for piece in pieces(batches, 128):
                keep = np.ones(piece.num_rows, bool)
                keep[[h[0] for h in search(piece.column("text").to_pylist(), blocks)]] = False
                yield piece.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
