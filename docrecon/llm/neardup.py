"""Near-duplicate documents by BagMinHash signatures, banding and exact multiset verification.

Two documents are linked if the weighted Jaccard similarity of their multisets of five-word shingles is ``THRESHOLD`` or
more; a class is a connected component of links, and its smallest document id stays.

1. Equal texts are one node from here on (told by 128 bits of their hash), so copies are never expanded into pairs.
2. BagMinHash: each shingle has Poisson processes over the weight axis cut at 0, 1, 2, 4, 8 ...; a point has a time, a
   slot and a place on the axis, and counts for a document whose weight of that shingle lies beyond its place. Each slot
   keeps its earliest point. Points come in order of time, so a shingle is left as soon as it is later than all slots.
3. Eight bits of each slot make the signature. Bands of ``ROWS`` slots are bucket keys. Buckets are counted before
   anything is gathered; a bucket of more than ``CHUNK`` nodes is cut into chunks and its chunks compared by pairs,
   each pair in a task of its own. From a block come only the links of a spanning forest, so output stays linear.
   With 32 bands of 6, a pair at similarity 0.8 is missed with probability 6e-5.
4. Linked by signatures (estimate ``LOOSE`` or more, 5 standard deviations below the threshold), nodes form loose
   groups that hold every true link. In a group of up to ``TEXT_CHUNK`` nodes all pairs are compared by their exact
   multisets. In a larger one every node is compared with the group's centre first, which joins most of a cluster of
   near copies at once; then all that the centre didn't join are compared with the whole group, in blocks of bounded
   size. Two nodes that the centre joined need no comparison, being in one class already.

Edge cases: a text of one to four words has one shingle of all its words; a null or empty text has none and is similar to
nothing but equal texts (null counts as empty). Rows that share a document id are told apart by their texts, and each is
in the class of its text. A row without an id is kept and has no class; it can link others. An empty table gives no
rows. Other columns, whatever their names, are ignored. Texts are hashed whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrecon.llm.graph import components
from docrecon.llm.ranges import pieces, shuffle_parts
from docrecon.llm.shingles import mix, multiset, occurrences
from docrecon.llm.storage import bounded, materialize

WORDS, THRESHOLD, LOOSE = 5, 0.8, 0.65
BANDS, ROWS = 32, 6
SLOTS = BANDS * ROWS
#: Most documents in one chunk of a bucket (of signatures) or of a loose group (of texts).
CHUNK, TEXT_CHUNK = 2048, 256
_U = np.uint64
_EMPTY = _U(0xFFFFFFFFFFFFFFFF)


def bag_minhash(found: np.ndarray, times: np.ndarray, begins: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """The earliest point of each slot of each document, as 64 bits of which the low 32 name the point. Documents without shingles have all bits set."""
    docs = len(begins) - 1
    table = np.full((docs, slots), _EMPTY)
    flat = table.reshape(-1)
    owner = np.repeat(np.arange(docs), np.diff(begins))
    # A process for each interval that a shingle's weight reaches into: [0, 1), [1, 2), [2, 4), [4, 8) ...
    shingle, doc, low = [found], [owner], [np.zeros(len(found), np.int64)]
    at = 1
    while (deep := np.flatnonzero(times > at)).size:
        shingle.append(found[deep])
        doc.append(owner[deep])
        low.append(np.full(len(deep), at))
        at *= 2
    level, doc, low = np.concatenate(shingle), np.concatenate(doc), np.concatenate(low)
    width = np.maximum(low, 1)
    weight = np.concatenate([times, *(times[times > 2**k] for k in range(len(shingle) - 1))])
    seed = mix(level + low.astype(np.uint64) * _U(0xD1342543DE82EF95))
    time, step = np.zeros(len(seed)), 0
    while len(seed):
        # Few shingles left: several points of each at once. Times are added up one by one either way.
        ahead = min(max(8192 // len(seed), 1), 64)
        steps = np.array([(step + 1 + k) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF for k in range(ahead)], np.uint64)
        step += ahead
        h = mix(seed[:, None] + steps)
        times_ = np.log(((h >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / -width[:, None]
        times_[:, 0] += time
        times_ = np.cumsum(times_, axis=1) if ahead > 1 else times_
        time = times_[:, -1]
        g = mix(h ^ _U(0xA5A5A5A55A5A5A5A))
        key = (times_.astype(np.float32).view(np.uint32).astype(np.uint64) << _U(32)) | (g >> _U(32))
        where = ((g & _U(0xFFFFFFFF)) * _U(slots) >> _U(32)).astype(np.int64) + (doc * slots)[:, None]
        if (wide := width > 1).any():  # the point's place within its interval must lie below the weight
            place = low[:, None] + ((mix(h ^ _U(0x3C3C3C3CC3C3C3C3)) >> _U(11)).astype(np.float64) * 2.0**-53 * width[:, None]).astype(np.int64)
            counts = ~wide[:, None] | (place < weight[:, None])
            np.minimum.at(flat, where[counts], key[counts])
        else:
            np.minimum.at(flat, where.ravel(), key.ravel())
        there = np.zeros(docs, bool)
        there[doc] = True
        latest = np.zeros(docs, np.uint64)
        latest[there] = table[there].max(axis=1) >> _U(32)
        go = key[:, -1] >> _U(32) <= latest[doc]
        seed, time, doc, low, width, weight = seed[go], time[go], doc[go], low[go], width[go], weight[go]
    return table


def signatures(texts: list[str | None]) -> list[bytes | None]:
    """Eight bits of each slot, or null for a text without shingles."""
    bags = multiset(texts, WORDS)
    table = (mix(bag_minhash(*bags)) >> _U(56)).astype(np.uint8)
    return [row.tobytes() if n else None for row, n in zip(table, np.diff(bags[2]), strict=True)]


def estimated(same: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Similarity from the number of equal slots, of which 1 in 256 agrees by chance."""
    return (same / slots - 1 / 256) / (1 - 1 / 256)


def text_key(text: Column) -> Column:
    """128 bits that tell a text (null counts as empty)."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, key (128 bits of the text), sig (null without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, 256):
            sigs = signatures(piece.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("key"), pa.array(sigs, pa.binary())], ["doc_id", "key", "sig"])

    narrow = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, key binary, sig binary")


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each band: its number and bits as one key, and the node."""
    place = _U(1) << (np.arange(ROWS, dtype=np.uint64) * _U(8))
    band = np.arange(BANDS, dtype=np.uint64) << _U(8 * ROWS)
    for piece in pieces(batches, 4096, column="sig"):
        sig = np.frombuffer(b"".join(piece.column("sig").to_pylist()), np.uint8).reshape(-1, BANDS, ROWS)
        keys = (sig.astype(np.uint64) * place).sum(axis=2, dtype=np.uint64) + band
        yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).astype(np.int64)), pa.array(np.repeat(piece.column("rep").to_numpy(), BANDS))], ["bucket", "rep"])


def blocked(rows: DataFrame, group: str, size: str, item: str, chunk: int) -> DataFrame:
    """``rows`` with a ``block``: groups up to ``chunk`` are one block; larger ones are cut into chunks by a hash of
    ``item``, and each pair of chunks is a block, so a row of a group of k chunks comes k times."""
    n = F.ceil(F.col(size) / chunk).cast("int")
    own = F.pmod(F.xxhash64(item), n).cast("int")
    pair = lambda j: F.least(own, j) * n + F.greatest(own, j)
    blocks = F.when(n <= 1, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), n - 1), pair))
    return rows.withColumn("block", F.explode(blocks)).drop(size)


def grouped(rows: DataFrame, group: str, run: Callable[[list[pa.RecordBatch]], list[tuple[int, int]]], payload: list[str]) -> DataFrame:
    """Links a, b that ``run`` finds in the rows of each (group, block). Rows stream through sorted; a block is gathered,
    which ``blocked`` has bounded, and blocks are handed over many at a time."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        last = None

        def links(blocks: list[dict]) -> pa.RecordBatch:
            found = run(blocks)
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

        kept = size = 0
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in (group, "block", *payload)]
            for g, block, *values in zip(*cols, strict=True):
                if (g, block) != last:
                    if kept > 4096 or size > 16 << 20:
                        yield links(held)
                        held, kept, size = [], 0, 0
                    held.append([])
                    last = (g, block)
                held[-1].append(values)
                kept += 1
                size += len(values[-1] or "")
        if held:
            yield links(held)

    parts = shuffle_parts(rows)
    return rows.select(group, "block", *payload).repartition(parts, group, "block").sortWithinPartitions(group, "block").mapInArrow(scan, "a long, b long")


def _alike(blocks: list[list]) -> list[tuple[int, int]]:
    """Links that join the signatures (rep, sig) in each block that are alike by their estimate, directly or by others: each
    to the smallest of its part, so that blocks of the same nodes give the same links whatever order they come in."""
    least = next(k for k in range(SLOTS + 1) if estimated(np.array(k)) >= LOOSE)
    out = []
    pairs = [b for b in blocks if len(b) == 2]
    if pairs:
        sig = np.frombuffer(b"".join(s for b in pairs for _, s in b), np.uint8).reshape(-1, 2, SLOTS)
        same = (sig[:, 0] == sig[:, 1]).sum(axis=1)
        out += [(min(b[0][0], b[1][0]), max(b[0][0], b[1][0])) for b, k in zip(pairs, same, strict=True) if k >= least]
    for block in blocks:
        if len(block) > 2:
            block = sorted(block)
            ids = np.array([r for r, _ in block])
            sig = np.frombuffer(b"".join(s for _, s in block), np.uint8).reshape(-1, SLOTS)
            rest = np.arange(len(ids))
            while len(rest):  # what is alike joins and leaves the rest
                root, front, rest = ids[rest[0]], [rest[0]], rest[1:]
                while front and len(rest):
                    at = front.pop()
                    near = (sig[rest] == sig[at]).sum(axis=1) >= least
                    out += [(int(root), x) for x in ids[rest[near]].tolist()]
                    front += rest[near].tolist()
                    rest = rest[~near]
    return out


def _linked(blocks: list[list]) -> list[tuple[int, int]]:
    """Links that join the nodes (rep, text) in each block whose exact multiset similarity reaches the threshold, directly
    or by others: each to the smallest of its part."""
    out = []
    blocks = [sorted(b) for b in blocks]
    sets = occurrences([t for b in blocks for _, t in b], WORDS)
    at = 0
    for block in blocks:
        own, at = sets[at : at + len(block)], at + len(block)
        ids, n = [r for r, _ in block], len(block)
        if n == 2:
            both = len(np.intersect1d(own[0], own[1], assume_unique=True))
            if both and both >= THRESHOLD * (len(own[0]) + len(own[1]) - both) - 1e-9:
                out.append((ids[0], ids[1]))
            continue
        sizes = np.array([len(s) for s in own])
        elements, owner = np.concatenate(own), np.repeat(np.arange(n), sizes)
        _, where, times = np.unique(elements, return_inverse=True, return_counts=True)
        shared = times[where] > 1
        column = np.cumsum(times > 1)[where[shared]] - 1
        rows, width = owner[shared], int((times > 1).sum())
        both = np.zeros((n, n), np.float32)
        slab = max(256, (1 << 22) // n)
        order = np.argsort(column, kind="stable")
        column, rows = column[order], rows[order]
        for low in range(0, width, slab):
            a, b = np.searchsorted(column, [low, low + slab])
            matrix = np.zeros((n, min(slab, width - low)), np.float32)
            matrix[rows[a:b], column[a:b] - low] = 1
            both += matrix @ matrix.T
        near = (both > 0) & (both >= THRESHOLD * (sizes[:, None] + sizes[None, :] - both) - 1e-6)
        rest = np.arange(n)
        while len(rest):
            root, front, rest = ids[rest[0]], [rest[0]], rest[1:]
            while front and len(rest):
                x = front.pop()
                hit = near[x, rest]
                out += [(root, ids[y]) for y in rest[hit]]
                front += rest[hit].tolist()
                rest = rest[~hit]
    return out


def _by_centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, component, near: whether a text reaches the threshold with its group's centre."""
    for piece in pieces(batches, 256):
        centres = piece.column("centre").to_pylist()
        distinct = {c: i for i, c in enumerate(dict.fromkeys(centres))}
        sets = occurrences([*distinct, *piece.column("text").to_pylist()], WORDS)
        near = []
        for centre, own in zip(centres, sets[len(distinct) :], strict=True):
            other = sets[distinct[centre]]
            both = len(np.intersect1d(own, other, assume_unique=True))
            near.append(bool(both) and both >= THRESHOLD * (len(own) + len(other) - both) - 1e-9)
        yield pa.RecordBatch.from_arrays([piece.column("node"), piece.column("component"), pa.array(near, pa.bool_())], ["node", "component", "near"])


def verified(groups: DataFrame) -> DataFrame:
    """Links a, b by exact multisets that make the classes of the loose groups (node, component, size, text)."""
    small = groups.filter(F.col("size") <= TEXT_CHUNK)
    links = grouped(blocked(small, "component", "size", "node", TEXT_CHUNK), "component", _linked, ["node", "text"])
    large = groups.filter(F.col("size") > TEXT_CHUNK)
    centres = large.filter("node = component").select(F.col("component").alias("c"), F.col("text").alias("centre"))
    met = materialize(large.join(centres, F.col("component") == F.col("c")).select("node", "component", "text", "centre").mapInArrow(_by_centre, "node long, component long, near boolean"), "by-centre")
    links = links.unionByName(met.filter("near AND node != component").select(F.col("node").alias("a"), F.col("component").alias("b")))

    # What is left over against the whole group: a block is a chunk of the former and a chunk of the latter.
    alone = met.filter("NOT near").select(F.col("node").alias("alone"))
    left = met.filter("NOT near").groupBy(F.col("component").alias("c")).agg(F.count("*").alias("left"))
    k, m = F.ceil(F.col("left") / TEXT_CHUNK).cast("int"), F.ceil(F.col("size") / TEXT_CHUNK).cast("int")
    open_ = large.join(left, F.col("component") == F.col("c")).drop("c")
    at = lambda seed, n: F.pmod(F.xxhash64("node", F.lit(seed)), n).cast("int")
    others = open_.withColumn("block", F.explode(F.transform(F.sequence(F.lit(0), k - 1), lambda i: i * m + at(2, m))))
    queries = open_.join(alone, F.col("node") == F.col("alone"), "left_semi").withColumn("block", F.explode(F.transform(F.sequence(F.lit(0), m - 1), lambda j: at(1, k) * m + j)))
    return links.unionByName(grouped(others.unionByName(queries), "component", _linked, ["node", "text"]))


def _classes(docs: DataFrame) -> DataFrame:
    """doc_id, key, class_id, kept of every row of ``docs``."""
    signed = materialize(sign(docs), "signatures")
    first = signed.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.min("sig").alias("sig"))
    reps = materialize(first.withColumn("rep", F.monotonically_increasing_id()), "representatives")

    some = reps.filter("sig IS NOT NULL").select("rep", "sig")
    bands = some.mapInArrow(_banded, "bucket long, rep long")
    sizes = bands.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    members = bands.join(sizes, "bucket").join(some, "rep")
    alike = grouped(blocked(members, "bucket", "size", "rep", CHUNK), "bucket", _alike, ["rep", "sig"])

    loose = materialize(components(alike), "loose-groups")
    group_sizes = loose.groupBy("component").agg(F.count("*").alias("size"))
    wanted = loose.join(group_sizes, "component").join(reps.select("rep", "key"), F.col("node") == F.col("rep")).select("key", "node", "component", "size")
    # One text of each key, joined in the tasks that read them before they are shuffled. By merge at every size: the
    # groups' share of the documents doesn't fall as the corpus grows.
    texts = docs.select(text_key(F.col("text")).alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).groupBy("key").agg(F.first("text").alias("text"))
    groups = materialize(texts.join(wanted.hint("merge"), "key").select("node", "component", "size", "text"), "loose-texts")

    classes = components(verified(groups))
    order = F.struct(F.col("first_id").isNull().alias("no_id"), "first_id", "key")
    linked = materialize(reps.select("rep", "key", "first_id").join(classes, F.col("rep") == F.col("node")).select("rep", "key", "first_id", "component"), "linked")
    best = linked.groupBy("component").agg(F.min(order).alias("best"))
    better = linked.join(best, "component").select(F.col("rep").alias("node"), F.col("best.first_id").alias("class_id"), F.col("best.key").alias("class_key"))
    labels = reps.select("key", "rep", "first_id").join(better, F.col("rep") == F.col("node"), "left")
    labels = labels.select("key", F.when(F.col("node").isNull(), F.col("first_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_key", "key").alias("class_key"))
    joined = signed.select("doc_id", "key").join(labels, "key", "left")
    named = F.col("doc_id").isNotNull()
    kept = ~named | ((F.col("doc_id") == F.col("class_id")) & (F.col("key") == F.col("class_key")))
    return joined.select("doc_id", "key", F.when(named, F.col("class_id")).alias("class_id"), F.coalesce(kept, F.lit(False)).alias("kept"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest document id of its class), kept of every row of ``docs``. Kept is the text of the
    smallest id; of several texts of that id one."""
    return _classes(docs).select("doc_id", "class_id", "kept")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates, with all their columns: of each class one row stays, and rows without
    an id stay. Equal rows are joined before they are shuffled."""
    kept = _classes(docs).filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("kept_id"), F.col("key").alias("kept_key")).distinct()
    whole = docs.select(F.col("doc_id").cast("long").alias("id"), text_key(F.col("text")).alias("key"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    each = whole.filter("id IS NOT NULL").groupBy("id", "key").agg(F.first("row").alias("row"))
    left = each.join(kept, (F.col("id") == F.col("kept_id")) & (F.col("key") == F.col("kept_key")), "left_semi")
    return left.select("row.*").unionByName(whole.filter("id IS NULL").select("row.*"))
