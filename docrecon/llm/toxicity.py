"""Toxic spans by a linear-chain conditional random field, document scores by its marginals.

Labels are given by document. For training, tokens get tags: in a document labelled toxic the tokens are tagged that
carry a feature (a word, prefix or suffix) found almost only in toxic documents, everything else is untagged. The field
has two tags, weights for hashed features of a token and its two neighbours, and a transition table. It is fitted by
gradient steps on the log-likelihood, whose gradient needs the forward-backward marginals. In use, the marginals of a
text's tokens give the expected number of toxic tokens, the highest marginal and what the others add; a logistic
curve on these, fitted on the same labels, gives the score. Tokens above one half are merged into spans.

``fit`` sees a bounded sample: ``SAMPLE`` labelled documents of each class, those with the smallest hashes of their ids,
of ``SAMPLE_BYTES`` of text in all at most, and whole texts of them: tags and the curve come from every token, and the
steps of the field from ``WINDOWS`` stretches of each document, drawn from everywhere in it (round tagged tokens in
toxic ones). Everything else covers every row. The model is a few megabytes whatever the corpus.

Edge cases: a null or empty text has no tokens and gets the score of no evidence. If no label, or labels of one class
only, can be learned from, all scores are that class's share (0 without labels). Null labels and labels of unknown
documents are left out; several labels of a document count as toxic if any is. Rows are scored one by one, so repeated
ids and null ids pass through; of several texts of a labelled id the least is learned from. An empty table gives no
rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrecon.llm.ranges import pieces
from docrecon.llm.storage import bounded, materialize

#: Labelled documents of each class that the model is fitted on, their bytes in all, and stretches of each, at most.
SAMPLE, SAMPLE_BYTES, WINDOWS = 2000, 64 << 20, 6
BITS = 18
SIZES = (3, 4, 5, 6, 7)
WEAK = 0.1
TOKEN = re.compile(r"[^\W\d_]+")
_KNOWN_WORDS = 200_000


def features(word: str) -> list[int]:
    """Hashed features of a lower-case token: itself, its prefixes and its suffixes."""
    names = [f"w={word}", *(f"<{word[:k]}" for k in SIZES if len(word) > k), *(f"{word[-k:]}>" for k in SIZES if len(word) > k)]
    return [zlib.crc32(n.encode()) & ((1 << BITS) - 1) for n in names]


@dataclass
class Model:
    """Scores are of the toxic tag over the other. ``own``, ``left`` and ``right`` hold a weight for each hashed feature
    of the token and of its neighbours; ``moves[a, b]`` is the weight of tag b after tag a."""

    own: np.ndarray
    left: np.ndarray
    right: np.ndarray
    bias: float
    moves: np.ndarray
    curve: np.ndarray
    flat: float | None = None  # the score of everything if there was nothing to learn from

    def __post_init__(self):
        self.words: dict[str, int] = {}
        self.table = np.zeros((1024, 3), np.float32)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("words", "table")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def _learn(self, new: list[str]) -> None:
        """Give new words rows of ``table``: what a word adds to its own score and to its neighbours'."""
        at, n = self.words, len(self.words)
        while n + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        lists = [features(w) for w in new]
        flat = np.fromiter((f for x in lists for f in x), np.int64)
        ends = np.cumsum([len(x) for x in lists])
        for k, weights in enumerate((self.own, self.left, self.right)):
            total = np.concatenate([[0.0], np.cumsum(weights[flat], dtype=np.float64)])
            self.table[n : n + len(new), k] = np.diff(np.concatenate([[0.0], total[ends]]))
        at.update(zip(new, range(n, n + len(new)), strict=True))

    def emissions(self, tokens: list[str], first: np.ndarray) -> np.ndarray:
        """The toxic tag's score of each token of texts laid end to end; ``first`` marks where a text begins."""
        fresh = set(tokens)
        if len(self.words) + len(fresh) > _KNOWN_WORDS:
            self.__post_init__()
        if new := list(fresh.difference(self.words)):
            self._learn(new)
        rows = self.table[np.fromiter(map(self.words.__getitem__, tokens), np.int64, len(tokens))]
        score = rows[:, 0].astype(np.float64) + self.bias
        inside = ~first[1:]
        score[1:] += rows[:-1, 1] * inside
        score[:-1] += rows[1:, 2] * inside
        return score


def forward_backward(emit: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of the toxic tag (steps by texts), expected moves (2 by 2) and log-likelihood normalisers.

    Two tags need one number a step: the log-odds of the toxic tag given the past, or the future. Steps run over all
    texts at once; what lies beyond a text's end leaves its numbers as they are.
    """
    steps, n = emit.shape
    past, future = np.zeros((steps, n)), np.zeros((steps, n))
    norm = np.zeros(n)
    live = np.arange(steps)[:, None] < lengths
    (m00, m01), (m10, m11) = moves
    odds = np.zeros(n)
    for t in range(steps):
        on = live[t]
        if t == 0:
            new, z = emit[0], np.zeros(n)
        else:  # log-sum over the previous tag, with the untagged path's weight as zero
            stay, rise = np.logaddexp(m00, odds + m10), np.logaddexp(m01, odds + m11)
            new, z = rise - stay + emit[t], stay
        odds = np.where(on, new, odds)
        norm += np.where(on, z, 0)
        past[t] = odds
    norm += np.where(lengths > 0, np.logaddexp(0, odds), 0)
    after = np.zeros(n)
    for t in range(steps - 2, -1, -1):
        e = emit[t + 1] + after
        new = np.logaddexp(m10, m11 + e) - np.logaddexp(m00, m01 + e)
        after = np.where(live[t + 1], new, 0.0)
        future[t] = after
    toxic = np.where(live, 1 / (1 + np.exp(-np.clip(past + future, -40, 40))), 0.0)
    # Expected moves: of each pair of steps the four joint probabilities.
    joint = np.zeros((2, 2))
    if steps > 1:
        on = live[1:]
        e, p = emit[1:] + future[1:], past[:-1]
        terms = np.stack([np.broadcast_to(m00, e.shape), m01 + e, p + m10, p + m11 + e])
        terms = np.exp(terms - terms.max(axis=0))
        joint = ((terms / terms.sum(axis=0)) * on).sum(axis=(1, 2)).reshape(2, 2)
    return toxic, joint, norm


def stream_marginals(emit: np.ndarray, first: np.ndarray, moves: np.ndarray, block: int = 256) -> np.ndarray:
    """The toxic tag's marginal of each token of texts laid end to end.

    The stream is cut into blocks that are worked on side by side. The odds that a block starts from are found by
    running up to it from some tokens before: a step of this recursion shrinks any difference of log-odds by at least
    tanh(|m00 + m11 - m01 - m10| / 4), so ``lead`` steps bring it below the rounding of the numbers themselves.
    """
    n = len(emit)
    shrink = np.tanh(abs(moves[0, 0] + moves[1, 1] - moves[0, 1] - moves[1, 0]) / 4)
    lead = n if shrink > 0.999 else min(n, int(np.ceil(np.log(1e-15) / np.log(max(shrink, 1e-6)))) + 1)
    (stay, rise), (drop, keep) = np.exp(moves)
    weight = np.exp(np.clip(emit, -60, 60))
    count = -(-n // block)
    at = np.arange(count) * block

    def run(weight: np.ndarray, new: np.ndarray, back: bool) -> np.ndarray:
        """Odds by step: of the past with the token itself, or of the future without it."""
        size = lead + count * block
        w, fresh = np.ones(size), np.ones(size, bool)
        w[lead : lead + n], fresh[lead : lead + n] = weight, new
        out, odds = np.empty((block, count)), np.ones(count)
        for t in range(-lead, block):
            here = at + lead + t
            if back:  # odds holds the token before's weight times its own future
                value = (drop + keep * odds) / (stay + rise * odds)
                value = np.where(fresh[here], 1.0, value)
                odds = np.clip(value * w[here], 1e-80, 1e80)
            else:
                value = (rise + keep * odds) / (stay + drop * odds)
                value = np.where(fresh[here], 1.0, value) * w[here]
                odds = np.clip(value, 1e-80, 1e80)
            if t >= 0:
                out[t] = value
        return out.T.reshape(-1)[:n]

    last = np.append(first[1:], True) if n else first
    total = run(weight, first, False) * run(weight[::-1], last[::-1], True)[::-1]
    return total / (1 + total)


def tokenized(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Tokens of lower-case texts laid end to end, where each text's begin (with the total at the end), and marks of first tokens."""
    each = [TOKEN.findall(t) for t in texts]
    begins = np.concatenate([[0], np.cumsum([len(e) for e in each])]).astype(np.int64)
    first = np.zeros(begins[-1], bool)
    first[begins[:-1][np.diff(begins) > 0]] = True
    return [w for e in each for w in e], begins, first


def measured(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each lower-case text, over its tokens with a marginal above ``WEAK``: log of 1 + the sum of marginals, the
    highest, and log of 1 + the sum of all but the highest; then the marginals themselves, and where each text's begin.
    Weaker marginals would add up to evidence in any text that is long enough."""
    tokens, begins, first = tokenized(texts)
    if not tokens:
        return np.zeros((len(texts), 3)), np.zeros(0), begins
    toxic = stream_marginals(model.emissions(tokens, first), first, model.moves)
    some = np.diff(begins) > 0
    starts = begins[:-1][some]
    out = np.zeros((len(texts), 3))
    strong = np.add.reduceat(np.where(toxic > WEAK, toxic, 0.0), starts)
    top = np.maximum.reduceat(toxic, starts)
    out[some, 0], out[some, 1], out[some, 2] = np.log1p(strong), top, np.log1p(np.maximum(strong - top, 0))
    return out, toxic, begins


def likeness(tokens: list[str]) -> int:
    """The least hash of a text's runs of five words, which near copies mostly share."""
    return min((zlib.crc32(" ".join(tokens[j : j + 5]).encode()) for j in range(max(1, len(tokens) - 4))), default=0)


def train(texts: list[str | None], labels: list[int], rounds: int = 8, least_steps: int = 400, seed: int = 5) -> Model:
    """Fit the field and the curve on labelled texts. Of texts alike only the first is used: near copies would lend the
    weight of many to the words of one."""
    empty = lambda flat: Model(*(np.zeros(1 << BITS, np.float32) for _ in range(3)), 0.0, np.zeros((2, 2)), np.zeros(4), flat)
    if len(set(labels)) < 2:
        return empty(float(labels[0]) if labels else 0.0)
    ids: dict[str, int] = {}
    seen_like, chosen, numbered = set(), [], []
    for i, text in enumerate(texts):
        tokens = TOKEN.findall((text or "").lower())
        if (like := likeness(tokens)) not in seen_like:
            seen_like.add(like)
            chosen.append(i)
            numbered.append(np.array([ids.setdefault(w, len(ids)) for w in tokens], np.int32))
    texts, labels = [texts[i] for i in chosen], [labels[i] for i in chosen]
    if len(set(labels)) < 2:
        return empty(float(labels[0]))
    wide, none = 1 + 2 * len(SIZES), len(ids)
    table = np.full((none + 1, wide), 1 << BITS, np.int32)  # the last column of the weights stays zero
    for i, w in enumerate(ids):
        at = features(w)
        table[i, : len(at)] = at
    del ids
    signal = tagged_features([table[np.unique(x)] for x in numbered], labels)
    tagged = signal[table].any(axis=1)
    # Windows around tagged tokens and windows of clean text, so that a step is cheap and both tags are seen.
    rng = np.random.default_rng(seed)
    chains, tags = [], []
    for x, label in zip(numbered, labels, strict=True):
        hits = np.flatnonzero(tagged[x]) if label else []
        centres = rng.permutation(hits)[:WINDOWS] if len(hits) else (rng.integers(0, len(x), WINDOWS) if len(x) else [])
        for c in centres:
            own = x[max(0, c - 8) : c + 9]
            chains.append(own)
            tags.append(tagged[own].astype(float) * label)
    model = empty(None)
    weights = np.zeros((3, (1 << BITS) + 1))
    power = np.full_like(weights, 1e-3)  # damps what is seen once or twice
    moves, move_power, bias, bias_power = np.array([[0.0, -2.0], [0.0, -1.0]]), np.full((2, 2), 1e-8), -2.0, 1e-8
    parts = max(1, len(chains) // 256)
    for _ in range(max(rounds, least_steps // parts) if chains else 0):
        for part in np.array_split(rng.permutation(len(chains)), parts):
            length = max(len(chains[i]) for i in part)
            words = np.full((length + 2, len(part)), none)
            gold = np.zeros((length, len(part)))
            lengths = np.array([len(chains[i]) for i in part])
            for j, i in enumerate(part):
                words[1 : lengths[j] + 1, j] = chains[i]
                gold[: lengths[j], j] = tags[i]
            live = np.arange(length)[:, None] < lengths
            at = [table[words[1:-1]], table[words[:-2]], table[words[2:]]]
            emit = sum(weights[k][at[k]].sum(axis=2) for k in range(3)) + bias
            toxic, joint, _ = forward_backward(emit, lengths, moves)
            miss = np.where(live, gold - toxic, 0.0) / len(part)
            for k in range(3):
                slope = np.bincount(at[k].ravel(), np.repeat(miss.ravel(), wide), minlength=(1 << BITS) + 1) - 1e-5 * weights[k]
                slope[-1] = 0
                power[k] += slope * slope
                weights[k] += 0.3 * slope / np.sqrt(power[k])
            before, after = gold[:-1], gold[1:]
            seen = np.array([[((1 - before) * (1 - after) * live[1:]).sum(), ((1 - before) * after * live[1:]).sum()], [(before * (1 - after) * live[1:]).sum(), (before * after * live[1:]).sum()]])
            slope = (seen - joint) / len(part) - 1e-3 * moves
            move_power += slope * slope
            moves += 0.1 * slope / np.sqrt(move_power)
            bias_power += miss.sum() ** 2
            bias += 0.1 * miss.sum() / np.sqrt(bias_power)
    model.own, model.left, model.right = (w[:-1].astype(np.float32) for w in weights)
    model.bias, model.moves = float(bias), moves
    x = np.concatenate([measured(model, [(t or "").lower() for t in texts[i : i + 256]])[0] for i in range(0, len(texts), 256)])
    model.curve = fit_curve(x, np.array(labels, float))
    model.__post_init__()  # forget the words
    return model


def tagged_features(docs: list[np.ndarray], labels: list[int], least: int = 4, share: float = 0.012, purity: float = 0.95) -> np.ndarray:
    """Marks of hashed features found in ``share`` of the toxic documents (``least`` at least), of which by far most documents are toxic."""
    size = (1 << BITS) + 1
    seen, toxic = np.zeros(size), np.zeros(size)
    for own, label in zip(docs, labels, strict=True):
        found = np.unique(own)
        seen[found] += 1
        if label:
            toxic[found] += 1
    dirty, clean = sum(labels), len(labels) - sum(labels)
    in_toxic, in_clean = toxic / dirty, (seen - toxic + 0.5) / clean
    out = (toxic >= max(least, share * dirty)) & (in_toxic / (in_toxic + in_clean) >= purity)
    out[-1] = False
    return out


def fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 3000, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression with classes weighed equally; the summary's parts can only raise a score."""
    share = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
    w = np.array([-1.0, 0.5, 0.5, 0.5])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -40, 40)))
        miss = share * (y - p)
        w = w + 0.5 * np.array([miss.sum(), *(miss @ x)]) - ridge * 0.1 * w
        w[1:] = np.maximum(w[1:], 0)
    return w


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a row is kept from learning: the checksum of its id as text is divisible by ``folds``. A null id never is."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("long").cast("string"), "UTF-8")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = 5) -> Model:
    """Train on a bounded sample of the labelled rows that aren't held out: of each class the ``sample`` ids with the
    smallest hashes. Only their texts come to the driver."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds)).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = None
    for label in (0, 1):
        part = known.filter(F.col("toxic") == label).orderBy(F.xxhash64("id"), "id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    ids = {r["id"]: r["toxic"] for r in chosen.collect()}  # at most 2 * sample rows
    spark = docs.sparkSession
    small = spark.createDataFrame(list(ids.items()) or [(None, None)], "id long, toxic int")
    narrow = docs.select(F.col("doc_id").cast("long").alias("own_id"), F.col("text").cast("string").alias("text"))
    rows = narrow.join(F.broadcast(small), F.col("own_id") == F.col("id")).select("id", "toxic", "text")
    first = materialize(rows.groupBy("id", "toxic").agg(F.min("text").alias("text")).withColumn("h", F.xxhash64("id")), "toxicity-sample")  # one row an id, so the sample stays bounded
    room, last = SAMPLE_BYTES, None
    for r in first.select("h", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).orderBy("h", "n").collect():
        room -= r["n"]
        if room < 0 and last is not None:
            break
        last = r["h"]
    got = first.filter(F.col("h") <= last).orderBy("id").collect() if last is not None else []
    return train([r["text"] for r in got], [r["toxic"] for r in got])


def spans(text: str, toxic: np.ndarray) -> list[dict]:
    """Start and end of runs of tokens more likely toxic than not."""
    out: list[dict] = []
    if not len(toxic) or toxic.max() < 0.5:
        return out
    last = -2
    for i, m in enumerate(TOKEN.finditer(text)):
        if toxic[i] >= 0.5:
            if last == i - 1:
                out[-1]["end"] = m.end()
            else:
                out.append({"start": m.start(), "end": m.end()})
            last = i
    return out


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list]]:
    """Pieces of the batches with the score and spans of each row's text."""
    for piece in pieces(batches, 512):
        texts = [(t or "").lower() for t in piece.column("text").to_pylist()]
        if model.flat is not None:
            yield piece, np.full(len(texts), model.flat), [[]] * len(texts)
            continue
        x, toxic, begins = measured(model, texts)
        score = 1 / (1 + np.exp(-np.clip(model.curve[0] + x @ model.curve[1:], -40, 40)))
        yield piece, score, [spans(t, toxic[a:b]) for t, a, b in zip(texts, begins[:-1], begins[1:], strict=True)]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and spans (start and end in code points of the text in lower case) of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, values, found in _scored(batches, shared.value):
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(values), pa.array(found, kind)], ["doc_id", "score", "spans"])

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, spans array<struct<start:int,end:int>>")


def clean_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose score is below one half, with all their columns. Rows are scored where they lie."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, values, _ in _scored(batches, shared.value):
            yield piece.filter(pa.array(values < 0.5))

    return bounded(docs).mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted, spans of every row of ``docs``."""
    scored = score(docs, fit(docs, labels, sample))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
