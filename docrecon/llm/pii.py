"""Personal data spans by weak supervision. DataFrame functions only; the driver does sums over a table of vote patterns.

Base spans come from four fixed patterns and are always kept. Candidates are what looser patterns find where no base
span lies: obfuscated or split e-mail addresses, addresses with a port or a zone, dotted numbers, runs of digits in groups
like a card's that the base pattern lost (two cards side by side are one run to it) or that fail its check, phone numbers
without a plus. Base spans and candidates get the same votes, none of which tells the one from the other: the form of a
true span (check digits, ranges, a domain's letters), a gazetteer (top-level domains, country and area forms, issuer
prefixes, networks in use), cue words in the context before the span, boundaries around it, and the layout of its
separators. Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is for each
kind, from where they agree and disagree; its posteriors train a logistic classifier on the features of the spans, which
then decides on the candidates. Counts cover all documents, and there are at most a few hundred patterns.

Edge cases: a null or empty text has no spans. Documents are rows: repeated ids give repeated rows, a null id stays null.
An empty table gives no rows and trains nothing. Other columns, whatever their names, are ignored. Texts are scanned whole; the patterns are
written without nested backtracking, so that long runs of digits or letters take linear time.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrecon.llm.storage import materialize

KINDS = ("email", "ip", "card", "phone")
# The base patterns, with possessive repeats where what follows can't match what is repeated, and with look-behinds
# that skip starts inside a run whose first start has failed. They find what the plain patterns find.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?(?:@|\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\[dot\]|\(dot\))\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}+(?:/[0-9]{1,2}|:[0-9]{2,5})?+(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])[0-9]{4}+[\x20.-]?[0-9]{4,6}+[\x20.-]?[0-9]{4,5}+(?:[\x20.-]?[0-9]{1,7}+)?(?![0-9])",
    "phone": r"(?<![0-9+])(?:00[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
}
#: What a text must contain for a pattern to be tried at all.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
NEEDS_LOOSE = {"email": r"\[at\]|\(at\)|@\x20|\x20@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9]{4}[\x20.-]?[0-9]{4}", "phone": r"[0-9]\)?[\x20.-][0-9]{3}"}
#: Cue words in four languages, looked for in the ``CONTEXT`` characters before a span.
CUES = {
    "email": r"(?i)e-?mail|contact|write to|kontakt|courriel|correo|adresse|@:",
    "ip": r"(?i)\bip\b|address|host|server|login|adresse|direcci",
    "card": r"(?i)card|visa|master|amex|credit|karte|carte|tarjeta|payment",
    "phone": r"(?i)phone|\btel|call|mobile|fax|telefon|anruf|appel|llam|m[oó]vil",
}
GAZETTEER = {
    "email": r"(?i)(?:\.|dot[\])])\x20?(?:com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu|ch|at|nl)$",
    "ip": r"^(?:10|127|172\.(?:1[6-9]|2[0-9]|3[01])|192\.168|[1-9][0-9]?|1[0-9]{2}|2[0-1][0-9]|22[0-3])\.",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|30|36|38|6011|65)",
    "phone": r"^(?:\+|00|\(?[2-9][0-9]{2}\)?[\x20.-])",
}
#: Separators as a true span has them: none or one kind throughout.
LAYOUT = {
    "email": r"^[^\x20\[(]+$|^[^@]+(?:\[at\][^@]+\[dot\]|\(at\)[^@]+\(dot\))[^@]+$",
    "ip": r"^(?:(?:0|[1-9][0-9]*)\.){3}(?:0|[1-9][0-9]*)(?:[/:].+)?$",
    "card": r"^[0-9]+$|^[0-9]{4}([\x20.-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$|^[0-9]{4}([\x20.-])[0-9]{6}\2[0-9]{4,5}$",
    "phone": r"^(?:\+|00|\().*[0-9]$|^[0-9]{2,4}([\x20.-])[0-9]{3,4}\1[0-9]{3,4}$",
}
CONTEXT = 24
LABELERS = ("form", "gazetteer", "cue", "bounds", "layout")
FEATURES = (*LABELERS, "separated")
_SPAN = "struct<kind:int,start:int,end:int,form:int,gazetteer:int,cue:int,bounds:int,layout:int,separated:int>"


def _found(text: Column, pattern: str, needs: str) -> Column:
    """Start and string of each match, leftmost and non-overlapping, counted in code points from 0."""
    strings = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    walk = F.aggregate(
        F.zip_with(F.slice(between, 1, F.size(strings)), strings, lambda gap, s: F.struct(F.length(gap).alias("gap"), s.alias("s"))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,s:string>>").alias("out")),
        lambda acc, m: F.struct((acc["at"] + m["gap"] + F.length(m["s"])).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + m["gap"]).alias("start"), m["s"].alias("s")))).alias("out")),
        lambda acc: acc["out"],
    )
    return F.when(text.rlike(needs) & text.rlike(pattern), walk).otherwise(F.array().cast("array<struct<start:int,s:string>>"))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.sequence(F.lit(0), F.length(digits) - 1)
    d = lambda i: F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
    worth = lambda i: F.when(i % 2 == 0, d(i)).otherwise(F.when(d(i) > 4, 2 * d(i) - 9).otherwise(2 * d(i)))
    return F.aggregate(places, F.lit(0), lambda total, i: total + worth(i)) % 10 == 0


def _octets(s: Column) -> Column:
    """Whether each dotted part is 255 at most."""
    parts = F.split(F.regexp_extract(s, r"^[0-9.]+", 0), r"\.")
    plain = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(parts, lambda p: F.when(F.length(plain(p)) <= 3, plain(p).cast("int") <= 255).otherwise(False))


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return _octets(s)
    n = F.length(_digits(s))
    if kind == "card":
        return F.when((n >= 16) & (n <= 19), _luhn(_digits(s))).otherwise(False)
    return (n >= 8) & (n <= 15) if kind == "phone" else F.lit(True)


def _form(kind: str, s: Column) -> Column:
    """Whether a span of either sort has the form of a true one."""
    n = F.length(_digits(s))
    if kind == "email":
        return s.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*+[^A-Za-z0-9].*[A-Za-z]{2,}$") & ~s.contains("..")
    if kind == "ip":
        return _octets(s)
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), _luhn(_digits(s))).otherwise(False)
    return (n >= 8) & (n <= 15)


def _described(text: Column, kind: str, match: Column) -> Column:
    """A span with its votes (1, 0, or -1 for none) and features."""
    start, s = match["start"], match["s"]
    before = F.substring(text, F.greatest(start - CONTEXT + 1, F.lit(1)), F.least(start, F.lit(CONTEXT)))
    left, right = F.substring(text, start, F.lit(1)), F.substring(text, start + F.length(s) + 1, F.lit(1))
    bounded = ~F.when(start > 0, left).otherwise("").rlike(r"[\p{L}\p{N}]") & ~right.rlike(r"[\p{L}\p{N}]")
    flag = lambda c: c.cast("int")
    return F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), start.alias("start"), (start + F.length(s)).alias("end"),
        flag(_form(kind, s)).alias("form"),
        flag(s.rlike(GAZETTEER[kind])).alias("gazetteer"),
        F.when(before.rlike(CUES[kind]), 1).otherwise(-1).alias("cue"),
        flag(bounded).alias("bounds"),
        flag(s.rlike(LAYOUT[kind])).alias("layout"),
        flag(s.rlike(r"[\x20().-]|\[|/|:")).alias("separated"),
    ).cast(_SPAN)


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base and loose: arrays of described spans. Loose spans that overlap a base span of any kind are left out."""
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for kind in KINDS:
        rows = rows.withColumn(kind, _found(text, BASE[kind], NEEDS[kind])).withColumn("loose_" + kind, _found(text, LOOSE[kind], NEEDS_LOOSE[kind]))

    def kept(kind: str) -> Column:
        return F.transform(F.filter(kind, lambda m: _valid(kind, m["s"])), lambda m: _described(text, kind, m))

    def other(kind: str) -> Column:
        return F.transform("loose_" + kind, lambda m: _described(text, kind, m))

    spans = rows.select("doc_id", F.concat(*map(kept, KINDS)).alias("base"), F.concat(*map(other, KINDS)).alias("loose"))
    apart = F.filter("loose", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return spans.select("doc_id", "base", apart.alias("loose"))


def estimate(patterns: list[tuple[tuple[int, ...], float]], rounds: int = 50) -> tuple[float, list[tuple[float, float]]]:
    """Expectation-maximisation over (votes, count): the share of true spans, and each labeler's rates of a vote of 1
    on true and on false spans. A vote below 0 says nothing. Starts from the share of votes for, and keeps the rates
    inside (0.02, 0.98), so that no single labeler can decide alone."""
    if not patterns:
        return 0.5, []
    share, rates = 0.5, [(0.8, 0.3)] * len(patterns[0][0])
    keep = lambda x: min(max(x, 0.02), 0.98)
    for _ in range(rounds):
        weights = [(votes, n, posterior(votes, share, rates)) for votes, n in patterns]
        share = keep(sum(n * p for _, n, p in weights) / sum(n for _, n, _ in weights))
        new = []
        for j in range(len(rates)):
            said = [(votes[j], n * p, n * (1 - p)) for votes, n, p in weights if votes[j] >= 0]
            yes, no = sum(t for _, t, _ in said), sum(f for _, _, f in said)
            new.append((keep((sum(v * t for v, t, _ in said) + 1.6) / (yes + 2)), keep((sum(v * f for v, _, f in said) + 0.6) / (no + 2))))
        rates = new
    return share, rates


def posterior(votes: tuple[int, ...], share: float, rates: list[tuple[float, float]]) -> float:
    """The probability that a span with these votes is true."""
    odds = math.log(share / (1 - share))
    for vote, (true, false) in zip(votes, rates, strict=True):
        if vote >= 0:
            odds += math.log(true / false) if vote else math.log((1 - true) / (1 - false))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def train(rows: list[tuple[tuple[float, ...], float, float]], steps: int = 300, rate: float = 1.0, ridge: float = 1e-3) -> list[float]:
    """Logistic regression on (features, soft label, weight): the bias and a weight for each feature."""
    if not rows:
        return []
    w = [0.0] * (len(rows[0][0]) + 1)
    total = sum(n for *_, n in rows)
    for _ in range(steps):
        slope = [ridge * x for x in w]
        for x, y, n in rows:
            z = w[0] + sum(a * b for a, b in zip(w[1:], x, strict=True))
            miss = n / total * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y)
            slope[0] += miss
            for j, v in enumerate(x):
                slope[j + 1] += miss * v
        w = [a - rate * b for a, b in zip(w, slope, strict=True)]
    return w


def learn(spans: DataFrame) -> list[list[float]]:
    """The weights of each kind's classifier, from the counts of span descriptions over all documents."""
    described = spans.select(F.inline(F.concat("base", "loose")))
    counts = described.groupBy("kind", *FEATURES).agg(F.count("*").alias("n")).collect()  # at most 4 * 2**6 rows
    weights = []
    for kind in range(len(KINDS)):
        own = sorted((tuple(r[f] for f in FEATURES), float(r["n"])) for r in counts if r["kind"] == kind)
        share, rates = estimate([(x[: len(LABELERS)], n) for x, n in own])
        weights.append(train([(tuple(max(v, 0) for v in x), posterior(x[: len(LABELERS)], share, rates), n) for x, n in own]))
    return weights


def detect(docs: DataFrame, threshold: float = 0.9) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans (base and added), n_added."""
    found = materialize(find_spans(docs), "pii-spans")
    weights = learn(found)

    def score(x: Column) -> Column:
        by_kind = [F.when(x["kind"] == k, reduce(lambda a, b: a + b, [F.greatest(x[f], F.lit(0)) * v for f, v in zip(FEATURES, w[1:], strict=True)], F.lit(w[0]))) for k, w in enumerate(weights) if w]
        return F.coalesce(*by_kind, F.lit(-30.0))

    limit = math.log(threshold / (1 - threshold))
    added = F.filter("loose", lambda x: score(x) >= limit)
    order = lambda spans: F.array_sort(F.transform(spans, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))))
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)
    joined = lambda spans: F.array_join(F.transform(order(spans), lambda x: F.concat_ws(":", name(x), x["start"], x["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(kind))).cast("long").alias("n_" + kind)

    rows = found.withColumn("added", added)
    return rows.select("doc_id", *map(count, KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))
