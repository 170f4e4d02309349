"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

A token's probability is that of its class given the tokens before it, times that of the token within its class. The
class comes from a softmax over hashed features of the context: the last token, the last two, and the skips over one and
over two. The token within its class comes from its count, smoothed by ``ALPHA``, with one share left for all unknown
tokens. The most frequent words have classes of their own, all others fall into classes by a hash of their last letters, so
an unseen token has a class too. Both factors sum to one, hence so do the probabilities of known tokens and one unknown.

Counts cover the whole training side: a task counts its documents, sums are made by token, and a document's rare tokens
meet their counts in a join. Only the ``HEAD`` most frequent tokens, a bounded table, are held by every task; they save
most of the join, and whether a token is among them doesn't change a score. The softmax is fitted by synchronous
gradients. The first, over all training documents, is taken where all classes are as likely, so that it consists of the
counts of features and classes; its step goes to smoothed log ratios of these counts. Then the documents, dealt to
``BLOCKS`` by a hash of the text, give a gradient a block, and each a step whose length the feature's count sets. Tasks hand on
sums by range of features, which are added on the executors, so that only totals of fixed size reach the driver, and how
the rows are dealt to tasks changes no weight beyond rounding.

Tokens: letters A to Z are lowered, words are runs of anything but space, tab and the line ends 0x0A to 0x0D, and each
document ends with one end token, which counts like any other.

Edge cases: a null or empty text is its end token alone. A null id is on the training side. Rows that share an id are
told apart. If there is no training document, counts are zero, N and V are 0, and every token is unknown. An empty table gives no
rows. Other columns, whatever their names, are ignored. Texts are counted and scored whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrecon.llm.ranges import pieces
from docrecon.llm.shingles import hash_words, located, mix
from docrecon.llm.storage import bounded, materialize

ALPHA = 0.1
#: Tokens held by every task; blocks of training documents that give a gradient each; buckets of features; classes.
HEAD, BLOCKS, BITS, CLASSES, OWN_CLASSES = 100_000, 4, 14, 32, 8
#: Of the first step: the part of the log ratio that each of the features takes, and the tokens that smooth it.
SHARE, PRIOR = 0.35, 10.0
#: Features in a range of weights that is summed as one. A task of the fit reads as many partitions as leave ``FIT_TASKS``
#: tasks for each core, but ``FIT_PARTS`` at most.
RANGE, FIT_TASKS, FIT_PARTS = 512, 2, 8
#: Distinct tokens that a counting task holds before it hands them on.
HELD = 300_000
END = b"\n"  # no word has a line end in it
_U = np.uint64
_SKIPS = ((1,), (1, 2), (2,), (3,))
_LETTER = np.array([c >= 128 or 97 <= c <= 122 for c in range(256)])
LOG10 = math.log(10)


def held_out(doc_id: Column, folds: int = 10) -> Column:
    """Whether a row is kept from learning: the checksum of its id as text is divisible by ``folds``. A null id never is."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("long").cast("string"), "UTF-8")) % folds == 0, F.lit(False))


def split(text: str | None) -> list[bytes]:
    """The words of a text."""
    return (text or "").encode().lower().split()


def classes_of(found: tuple, own: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """The class of each word of texts (as ``located`` has them): its own if its hash is in ``own`` (from class 1 on),
    else one by the last two of its last six bytes that are letters of some kind."""
    hashes, _, data, first, last = found
    letters, seen = np.zeros((2, len(hashes)), np.int64), np.zeros(len(hashes), np.int8)
    for back in range(1, 7):
        at = last - back
        ch = data[at]
        hit = (at >= first) & _LETTER[ch] & (seen < 2)
        letters[seen[hit], np.flatnonzero(hit)] = ch[hit]
        seen += hit
    out = OWN_CLASSES + 1 + (mix((letters[0] + 256 * letters[1] + 1).astype(_U)) % _U(classes - OWN_CLASSES - 1)).astype(np.int64)
    for k, h in enumerate(own.tolist()):
        out[hashes == _U(h)] = k + 1
    return out


def counted(docs: DataFrame) -> DataFrame:
    """token (binary), n: of all training documents, END among them. Tasks hand on sums of a bounded number of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["token", "n"])

        for piece in pieces(batches, 1024):
            texts = piece.column("text").to_pylist()
            held[END] += len(texts)
            for text in texts:
                held.update(split(text))
                if len(held) > HELD:
                    yield out()
                    held = Counter()
        if held:
            yield out()

    train = docs.filter("NOT held_out").select("text")
    return train.mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """``head`` maps the tokens that occur ``least`` times or more to their place; ``log_count`` is by place, ``total`` and
    ``distinct`` by class. ``own`` has the hashes of the words with classes of their own; class 0 is END's."""

    head: dict[bytes, int]
    least: int
    log_count: np.ndarray
    own: np.ndarray
    total: np.ndarray
    distinct: np.ndarray
    weights: np.ndarray

    @property
    def tokens(self) -> int:
        return int(self.total.sum())

    @property
    def vocabulary(self) -> int:
        return int(self.distinct.sum())


def _log_scale(total, distinct) -> np.ndarray:
    """Log10 of what smoothed counts are divided by."""
    return np.log10(np.asarray(total) + ALPHA * (np.asarray(distinct) + 1))


def contexts(texts: list[str | None], own: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token (end tokens included) of the texts laid end to end the feature buckets and the class, and where each
    text's tokens begin."""
    found = located([(t or "").encode().lower() for t in texts])
    hashes, starts = found[:2]
    count = np.diff(starts)
    begins = np.concatenate([[0], np.cumsum(count + 1)])
    n = int(begins[-1])
    owner = np.repeat(np.arange(len(texts)), count + 1)
    at = np.arange(n) - begins[owner]
    word = at < count[owner]
    kinds = np.zeros(n, np.int64)
    kinds[word] = classes_of(found, own)
    flat = np.zeros(n + 4, _U)  # the words, with room for an end token after each text
    flat[4:][word] = hashes
    out = np.empty((n, len(_SKIPS)), np.int32)
    for k, skips in enumerate(_SKIPS):
        h = np.full(n, _U(k + 1))
        for s in skips:
            h = mix(h + np.where(at >= s, flat[4 - s : n + 4 - s], _U(77 + s)))
        out[:, k] = (h >> _U(64 - bits)).astype(np.int32) + (k << bits)
    return out, kinds, begins


def _powers(weights: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The softmax's numerators: tokens by classes."""
    out = np.take(weights, at[:, 0], axis=0)
    for k in range(1, at.shape[1]):
        out += np.take(weights, at[:, k], axis=0)
    np.clip(out, -60, 60, out=out)  # the sum of 32 stays a number of 32 bits
    return np.exp(out, out=out)


def class_logs(weights: np.ndarray, at: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each token's class."""
    out, ones = np.empty(len(at)), np.ones(weights.shape[1], weights.dtype)
    for low in range(0, len(at), 8192):
        power, gold = _powers(weights, at[low : low + 8192]), kinds[low : low + 8192]
        out[low : low + 8192] = np.log(power[np.arange(len(gold)), gold]) - np.log(power @ ones)
    return out


def add_gradient(total: np.ndarray, count: np.ndarray, weights: np.ndarray | None, at: np.ndarray, kinds: np.ndarray, size: int = 4096) -> None:
    """Add to ``total`` (features by classes) the classes seen less those expected, and to ``count`` the tokens of each
    feature. Without weights nothing is expected. ``total`` must be contiguous."""
    width = total.shape[1]
    flat, along = total.reshape(-1), np.arange(width)
    for k in range(at.shape[1]):
        np.add.at(flat, at[:, k].astype(np.int64) * width + kinds, 1.0)
        np.add.at(count, at[:, k], 1)
    if weights is None:
        return
    ones = np.ones(width, weights.dtype)
    for low in range(0, len(at), size):
        part = at[low : low + size]
        p = _powers(weights, part)
        p /= (p @ ones)[:, None]
        lost = -p.astype(np.float64).ravel()
        for k in range(part.shape[1]):
            np.add.at(flat, (part[:, k].astype(np.int64)[:, None] * width + along).ravel(), lost)


def gradient(train: DataFrame, own: np.ndarray, weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """``add_gradient`` over all rows of ``train`` (text)."""
    size = (len(_SKIPS) << BITS, CLASSES)
    shared = train.sparkSession.sparkContext.broadcast((own, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, start = shared.value
        total, count = np.zeros(size), np.zeros(size[0], np.int64)
        for piece in pieces(batches, 64, 1 << 20):
            at, kinds, _ = contexts(piece.column("text").to_pylist(), frequent)
            add_gradient(total, count, start, at, kinds)
        for first in range(0, len(total), RANGE):
            hit = np.flatnonzero(count[first : first + RANGE])
            if len(hit):
                sums = total[first + hit].astype("<f4"), count[first + hit].astype("<i8")
                yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32())] + [pa.array([x.tobytes()], pa.binary()) for x in (hit.astype("<i2"), *sums)], ["first", "rows", "total", "count"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All sums of a range are in one task."""
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for first, rows, part, n in zip(*(batch.column(c).to_pylist() for c in ("first", "rows", "total", "count")), strict=True):
                total, count = sums.setdefault(first, (np.zeros((RANGE, CLASSES)), np.zeros(RANGE, np.int64)))
                hit = np.frombuffer(rows, "<i2")
                total[hit] += np.frombuffer(part, "<f4").reshape(-1, CLASSES)
                count[hit] += np.frombuffer(n, "<i8")
        for first, (total, count) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([total.astype("<f4").tobytes()], pa.binary()), pa.array([count.astype("<i8").tobytes()], pa.binary())], ["first", "total", "count"])

    parts = train.mapInArrow(run, "first int, rows binary, total binary, count binary").repartition("first")
    total, count = np.zeros(size), np.zeros(size[0], np.int64)
    for first, sums, n in zip(*parts.mapInArrow(add, "first int, total binary, count binary").toArrow().to_pydict().values(), strict=True):  # a row a range: the size of the weights
        total[first : first + RANGE] = np.frombuffer(sums, "<f4").reshape(RANGE, CLASSES)
        count[first : first + RANGE] = np.frombuffer(n, "<i8")
    shared.destroy()
    return total, count


def first_weights(total: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Weights from the counts of features and classes: the classes' own odds, and part of each feature's log ratio to them."""
    seen = total[: 1 << BITS].sum(axis=0) + 0.5  # every token has one feature of each kind
    odds = seen / seen.sum()
    return SHARE * np.log((total + PRIOR * odds) / (count[:, None] + PRIOR) / odds) + np.log(odds) / len(_SKIPS)


def fit_weights(docs: DataFrame, model: Model, blocks: int = BLOCKS) -> np.ndarray:
    """Weights of the softmax: features by classes, from all training documents."""
    train = docs.filter("NOT held_out").select("text")
    parts = train.rdd.getNumPartitions()
    tasks = max(FIT_TASKS * docs.sparkSession.sparkContext.defaultParallelism, -(-parts // FIT_PARTS))
    weights = first_weights(*gradient(train.coalesce(tasks), model.own, None))
    for block in range(blocks):
        part = train.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).coalesce(tasks)
        total, count = gradient(part, model.own, weights.astype(np.float32))
        weights += total / (count[:, None] / 2 + 2)  # the softmax's curvature is half the count at most
    return weights.astype(np.float32)


def learn(docs: DataFrame, counts: DataFrame, head: int = HEAD) -> Model:
    """The model from materialised counts."""
    # The least count of the head, from how many tokens there are of each magnitude of count (some hundred rows).
    magnitude = F.floor(F.log2("n") * 16).cast("int")
    least, room = None, head
    for r in counts.groupBy(magnitude.alias("m")).agg(F.count("*").alias("k"), F.min("n").alias("least")).orderBy(F.desc("m")).collect():
        room -= r["k"]
        if room < 0:
            break
        least = r["least"]
    least = least or 1 << 62  # nothing fits: no head
    table = counts.filter(F.col("n") >= least).toArrow()  # ``head`` rows at most
    top = sorted(zip(table.column("token").to_pylist(), table.column("n").to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    own = hash_words([word for word, _ in top[: OWN_CLASSES + 1] if word != END][:OWN_CLASSES])[0]
    words = {word: i for i, (word, _) in enumerate(top)}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, distinct = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            tokens = batch.column("token").to_pylist()
            kinds = np.zeros(len(tokens), np.int64)  # END is class 0
            kinds[[w != END for w in tokens]] = classes_of(located([w for w in tokens if w != END]), own)
            total += np.bincount(kinds, batch.column("n").to_numpy(), CLASSES).astype(np.int64)
            distinct += np.bincount(kinds, minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(total), pa.array(distinct)], ["kind", "total", "distinct"])

    total, distinct = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    summed = counts.mapInArrow(sums, "kind long, total long, distinct long").groupBy("kind").agg(F.sum("total").alias("total"), F.sum("distinct").alias("distinct"))
    for r in summed.collect():  # a row a class
        total[r["kind"]], distinct[r["kind"]] = r["total"], r["distinct"]
    model = Model(words, least, np.log10(np.array([n for _, n in top], float) + ALPHA), own, total, distinct, np.zeros((0, CLASSES), np.float32))
    model.weights = fit_weights(docs, model)
    return model


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``."""
    plain = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", held_out(F.col("doc_id")))
    counts = materialize(counted(plain), "lm-counts")
    model = learn(plain, counts)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a document with the sums over its frequent tokens, under a key of its own, and a row for each of its rare tokens."""
        from pyspark import TaskContext

        model = shared.value
        key = TaskContext.get().partitionId() << 40
        in_class = _log_scale(model.total, model.distinct)
        get = model.head.get
        for piece in pieces(batches, 256, 2 << 20):
            texts = piece.column("text").to_pylist()
            at, kinds, begins = contexts(texts, model.own)
            words = [w for t in texts for w in (*split(t), END)]
            place = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
            rare = np.flatnonzero(place < 0)
            tail = [words[i] for i in rare.tolist()]
            logs = class_logs(model.weights, at, kinds) / LOG10 - in_class[kinds]
            known = np.where(place >= 0, model.log_count[place] if len(model.log_count) else 0.0, 0.0)
            starts, n = begins[:-1], len(texts)
            ids = np.arange(key, key + n)
            key += n
            owner = np.repeat(np.arange(n), np.diff(begins))[rare]
            lone = Counter(zip(owner.tolist(), tail, strict=True))
            rows = list(lone)
            m = len(rows)
            held = piece.column("held_out").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([ids, ids[[o for o, _ in rows]] if m else np.zeros(0, np.int64)])),
                    pa.array([None] * n + [w for _, w in rows], pa.binary()),
                    pa.array([1] * n + list(lone.values()), pa.int64()),
                    pa.array(piece.column("doc_id").to_pylist() + [None] * m, pa.int64()),
                    pa.array(held + [None] * m, pa.bool_()),
                    pa.array(np.diff(begins).tolist() + [None] * m, pa.int64()),
                    pa.array(np.add.reduceat((place >= 0).astype(np.int64), starts).tolist() + [None] * m, pa.int64()),
                    pa.array(np.add.reduceat(known, starts).tolist() + [None] * m, pa.float64()),
                    pa.array(np.add.reduceat(logs, starts).tolist() + [None] * m, pa.float64()),
                ],
                ["key", "token", "times", "doc_id", "held_out", "n_tokens", "n_head", "head_logs", "model_logs"],
            )

    schema = "key long, token binary, times long, doc_id long, held_out boolean, n_tokens long, n_head long, head_logs double, model_logs double"
    parts = materialize(plain.mapInArrow(run, schema), "lm-parts")
    shared.destroy()
    tail = parts.filter("token IS NOT NULL").select("key", "token", "times")
    met = tail.join(counts.filter(F.col("n") < model.least), "token", "left")
    c = F.coalesce(F.col("n"), F.lit(0))
    rare = met.groupBy("key").agg(F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("n_rare"), F.sum(F.col("times") * F.log10(c + F.lit(ALPHA))).alias("rare_logs"))
    whole = parts.filter("token IS NULL").drop("token", "times").join(rare, "key", "left")
    logs = F.col("head_logs") + F.coalesce("rare_logs", F.lit(0.0))
    scale = float(_log_scale(model.tokens, model.vocabulary))
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("n_rare", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(scale)).alias("base_score"), (logs + F.col("model_logs")).alias("score"),
    )
