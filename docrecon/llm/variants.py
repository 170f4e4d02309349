"""Spelling variants: words one edit apart, found by bands of a bitmask of letter parities.

Each letter has a bit that tells whether the word holds it an odd number of times. An inserted or deleted letter flips one
bit and a replaced one two at most, so of three bands of bits one at least stays as it is. Words meet that agree in a band
and whose lengths differ by one at most; what meets is verified. Letters are dealt to the bands by the entropy of their
bits, so that no band is empty of information, as one of rare letters would be.

A band alone is a weak key once a vocabulary has millions of words. One edit also leaves one half of a word as it was, so
each band is split by the half that stays. Buckets thereby grow with the words that agree in half their letters and not with
the vocabulary, and no pair is lost. A pair that several keys bring together counts at the first of them.

Edge cases: a null text holds no words. A null document id counts as an empty one. Rows that repeat count as often as they
stand there. An empty table gives no words. Other columns are ignored. Texts are searched whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrecon.llm.storage import materialize

LETTERS = "".join(map(chr, [*range(0x61, 0x7B), *range(0xC0, 0x100)]))
UPPER = "".join(map(chr, range(0x41, 0x5B)))
#: Bands, and bits of each; three bands of 21 bits fit a long.
BANDS, WIDTH = 3, 21


def runs(docs: DataFrame, least: int, noise: int) -> DataFrame:
    """word: every run of letters of ``docs`` (doc_id, text) of at least ``least`` letters, A to Z in lower case. A run
    whose checksum with the document's id is divisible by ``noise`` lacks one letter."""
    found = F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least},}}"), F.lit(0)))
    low = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), found.alias("run")).select("id", F.translate("run", UPPER, UPPER.lower()).alias("run"))
    drawn = low.withColumns({"draw": F.crc32(F.concat_ws(":", "id", "run")), "size": F.length("run")}).withColumn("at", F.pmod("draw", F.col("size")).cast("int"))
    cut = F.concat(F.col("run").substr(F.lit(1), F.col("at")), F.col("run").substr(F.col("at") + 2, F.col("size")))
    return drawn.select(F.when(F.col("draw") % noise == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= least)


def vocabulary(docs: DataFrame, least: int = 7, times: int = 2, noise: int = 31) -> DataFrame:
    """word, n of the words of ``docs`` that have ``least`` letters and occur ``times`` at least."""
    return runs(docs, least, noise).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= times)


def letter_bits(words: DataFrame) -> list[int]:
    """The bit of each of ``LETTERS``: the most telling ones are dealt first, each to the band that knows least so far.

    A count for each letter comes to the driver. Letters beyond the bits share one of the least telling, which keeps every
    pair: an edit then flips fewer bits.
    """
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).groupBy("letter").count()
    total, held = max(words.count(), 1), {r["letter"]: r["count"] for r in letters.collect()}
    shares = [held.get(c, 0) / total for c in LETTERS]
    tells = [-sum(p * math.log2(p) for p in (s, 1 - s) if p > 0) for s in shares]
    known, used, bits = [0.0] * BANDS, [0] * BANDS, [0] * len(LETTERS)
    for i in sorted(range(len(LETTERS)), key=lambda i: -tells[i]):
        open_ = [b for b in range(BANDS) if used[b] < WIDTH] or list(range(BANDS))
        band = min(open_, key=lambda b: (known[b], used[b]))
        bits[i] = band * WIDTH + min(used[band], WIDTH - 1)
        known[band] += tells[i]
        used[band] += 1
    return bits


def parity_mask(word: Column, bits: list[int]) -> Column:
    """The parities of a word's letters."""
    flips = F.array(*[F.lit(1 << b).cast("long") for b in bits])
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda mask, c: mask.bitwiseXOR(F.element_at(flips, F.position(c, F.lit(LETTERS)))))


def _band(mask: Column, k: int) -> Column:
    return F.shiftrightunsigned(mask, WIDTH * k).bitwiseAND(F.lit((1 << WIDTH) - 1).cast("long"))


def _halves(word: Column, size: Column) -> tuple[Column, Column]:
    """The first and last letters of a word that a word of ``size`` letters, no more than its own, can have in common:
    half of ``size`` and the rest of it."""
    half = F.floor(size / 2).cast("int")
    return word.substr(F.lit(1), half), word.substr(F.length(word) - (size - half) + 1, size - half)


def _keyed(words: DataFrame, longer: bool) -> DataFrame:
    """The rows of each word: a row for each half and band. As the ``longer`` one a word stands for its neighbours with a
    letter less, which two of the bands suffice to find, as only one bit differs."""
    size = F.length("word") - int(longer)
    keys = []
    for side, half in enumerate(_halves(F.col("word"), size)):
        for k in range(BANDS - int(longer)):
            keys.append(F.struct(F.xxhash64(size, F.lit(side * BANDS + k), half, _band(F.col("mask"), k)).alias("key"), F.lit(side * BANDS + k).cast("byte").alias("via")))
    return words.select("word", "n", "mask", F.explode(F.array(*keys)).alias("k")).select("k.key", "k.via", "word", "n", "mask", F.lit(longer).alias("longer"))


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b, a_n, b_n of words one edit apart, each pair once; ``words`` holds word (distinct) and n.

    The conditions stand in the join, cheapest first, so that only pairs come out of it.
    """
    masked = materialize(words.withColumn("mask", parity_mask(F.col("word"), letter_bits(words))), "masks")
    left = _keyed(masked, False).drop("longer").alias("l")
    right = _keyed(masked, False).unionByName(_keyed(masked, True)).alias("r")
    differ = F.col("l.mask").bitwiseXOR(F.col("r.mask"))
    size = F.length("l.word")
    head, other = _halves(F.col("l.word"), size)[0], _halves(F.col("r.word"), size)[0]
    first = F.lit(True)  # no earlier key has both
    for k in reversed(range(BANDS)):
        first = F.when(_band(differ, k) == 0, F.col("l.via") % BANDS == k).otherwise(first)
    meets = (
        (F.col("l.key") == F.col("r.key"))
        & (F.col("l.via") == F.col("r.via"))
        & (F.bit_count(differ) <= F.when(F.col("r.longer"), 1).otherwise(2))
        & (F.length("r.word") == size + F.col("r.longer").cast("int"))
        & first
        & (F.col("r.longer") | (F.col("l.word") < F.col("r.word")))
        & ((F.col("l.via") < BANDS) == (head == other))
        & (F.levenshtein("l.word", "r.word", 1) == 1)
    )
    return left.join(right, meets).select(F.col("l.word").alias("a"), F.col("r.word").alias("b"), F.col("l.n").alias("a_n"), F.col("r.n").alias("b_n"))


def with_roots(words: DataFrame) -> DataFrame:
    """``words`` (word, form, ...) with ``root``, the last of the forms that follow from a word.

    Each round doubles how far a root lies ahead. A form occurs several times as often as its word, so the way is no
    longer than the logarithm of the largest count, and rounds are the logarithm of that.
    """
    ahead = materialize(words.filter("form IS NOT NULL").select(F.col("word").alias("from"), F.col("form").alias("to")), "forms")
    while True:
        step = ahead.select(F.col("from").alias("to"), F.col("to").alias("next"))
        if ahead.join(step, "to", "left_semi").isEmpty():
            break
        ahead = materialize(ahead.join(step, "to", "left").select("from", F.coalesce("next", "to").alias("to")), "forms")
    return words.join(ahead.select(F.col("from").alias("word"), F.col("to").alias("root")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, least: int = 7, times: int = 2, noise: int = 31, factor: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of ``vocabulary``.

    Words are near if they are one edit apart. A word's form is its near word that occurs most often (of several the
    first by code points) if it occurs ``factor`` times as often; its root is where forms lead.
    """
    words = materialize(vocabulary(docs, least, times, noise), "words")
    pairs = near_pairs(words)
    ends = F.explode(F.array(*[F.struct(F.col(x).alias("word"), F.struct((-F.col(f"{y}_n")).alias("less"), F.col(y).alias("near")).alias("best")) for x, y in ("ab", "ba")]))
    best = pairs.select(ends.alias("e")).select("e.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min("best").alias("best"))
    usual = -F.col("best.less") >= factor * F.col("n")
    found = words.join(best, "word", "left").select(
        "word", F.when(usual, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(usual, -F.col("best.less")).alias("form_n")
    )
    return with_roots(materialize(found, "variants")).select("word", "form", "root", "n", "n_near", "form_n")
