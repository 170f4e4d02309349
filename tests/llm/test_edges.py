"""Hot and null keys, short items, equal ids, tiny vectors, clashing columns, and what models say against plain versions."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import DOCS, WORDS, corpus, luhn

from docrecon.llm import decontam, lm, mixing, neardup, pii, ranges, sharding, tokenbin, toxicity, vecdup, warc

CLASH = ("id", "key", "tie", "row", "nth", "copies", "bucket", "shard", "spread", "block", "rep", "sample_hash", "held_out", "score")


@pytest.fixture(scope="module")
def clashing(spark):
    """Documents with columns of names that operators use themselves."""
    return spark.createDataFrame(corpus(16), DOCS).withColumns({c: F.lit(7) for c in CLASH})


def test_null_and_hot_keys_are_spread(spark):
    n = 100_000
    keys = spark.range(n).select(F.when(F.col("id") % 3 == 1, 5).when(F.col("id") % 3 == 2, F.col("id")).alias("k"), "id")
    cuts = ranges.cut_points(keys, "k", 30)
    assert len(cuts) == 29 and 9 <= sum(c is None for c in cuts) <= 11
    placed = keys.withColumn("b", ranges.bucket_of(F.col("k"), ranges.spread_of(F.col("id")), cuts, "bigint"))
    sizes = [r["count"] for r in placed.groupBy("b").count().collect()]
    assert len(sizes) >= 28 and max(sizes) < 2.5 * n / 30
    ends = [(r["b"], r["lo"], r["hi"]) for r in placed.groupBy("b").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("b").collect()]
    known = [e for e in ends if e[1] is not None]
    assert all(a[2] <= b[1] for a, b in zip(known, known[1:], strict=False)) and ends.index(known[0]) >= 9


def test_equal_rows_are_sharded_apart(spark):
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    got = sharding.balanced_shards(docs, 10).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last")).collect()
    assert len(got) == 10 and all(r["n"] == 300 and r["last"] == 299 for r in got)


def test_pieces_are_cut_by_bytes():
    import pyarrow as pa

    texts = ["a" * 10, None, "b" * 50, "", "c" * 200, "d"]
    cut = [p.column("text").to_pylist() for p in ranges.pieces(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]), 3, 60)]
    assert [x for p in cut for x in p] == texts and cut == [texts[:3], texts[3:4], texts[4:5], texts[5:]]


def test_rows_of_one_id_are_documents_of_their_own(spark):
    a, b, c = (" ".join(WORDS[k : k + 30]) for k in (0, 40, 80))
    rows = [(1, a), (1, b), (2, c), (3, a), (3, a), (None, b), (None, "lost"), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    kept = [(r["doc_id"], r["text"]) for r in neardup.deduplicated(docs).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [(1, a), (1, b), (2, c), (4, None), (None, b), (None, "lost")]))


def test_large_groups_by_their_centre(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TEXT_CHUNK", 8)
    rng, base = random.Random(3), WORDS[:200]
    near = [" ".join(base[:k] + [f"n{k}"] + base[k + 1 :]) for k in range(40)]  # all near the first
    chain = list(base)
    far = []
    for k in range(12):  # each near the one before, the last far from the first
        chain = [*chain]
        for at in rng.sample(range(200), 4):
            chain[at] = f"f{k}_{at}"
        far.append(" ".join(chain))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate([" ".join(base), *near, *far])], DOCS)
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()}
    sets = neardup.occurrences([r["text"] for r in docs.orderBy("doc_id").collect()])
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                lo, hi = sorted((root(i), root(j)))
                parent[hi] = lo
    assert got == {i: root(i) for i in range(len(sets))}


def test_short_items_and_several_stretches(spark):
    short, one = "alpha beta gamma delta epsilon", "zyzzyva"
    item = " ".join(WORDS[:24])
    decoy = " ".join(w for pair in zip(WORDS[:12][::-1], WORDS[300:312], strict=True) for w in pair)  # its words, out of order
    rows = [(0, f"x {short.upper()}, y"), (1, "alpha beta gamma delta"), (2, "epsilon alpha beta gamma delta"), (3, "a Zyzzyva!"), (4, f"{decoy} {item}"), (5, f"{item} {decoy}"), (5, f"{item} {decoy}"), (None, item), (6, " ".join([decoy] * 400) + " " + item), (7, short.replace(" ", "\n"))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).withColumns({"item_id": F.lit(1), "cover": F.lit("x")})
    bench = spark.createDataFrame([(1, short), (2, one), (3, item), (None, item)], "item_id long, text string")
    got = sorted((str(r["doc_id"]), r["item_id"]) for r in decontam.contaminated(docs, bench).collect())
    assert got == sorted([("0", 1), ("7", 1), ("3", 2), ("4", 3), ("5", 3), ("5", 3), ("None", 3), ("6", 3)])
    left = decontam.uncontaminated(docs, bench)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 2]
    only_short = decontam.contaminated(docs, bench.filter("item_id < 3")).count()
    assert only_short == 3


def test_search_against_every_stretch(spark):
    """Verbatim and paraphrased items by brute force: every window of every text, without terms or a latent space."""
    rng = random.Random(21)
    items = [" ".join(rng.choices(WORDS, k=rng.randrange(10, 40))) for _ in range(12)]
    texts = []
    for d in range(60):
        words = rng.choices(WORDS, k=rng.randrange(10, 250))
        if d % 3 == 0:
            put = items[d % 12].split()
            if d % 2:
                put = ["other" if k % 7 == 3 else w for k, w in enumerate(put)]
            words[5:5] = put
        texts.append(" ".join(words))
    want = set()
    for d, text in enumerate(texts):
        words = text.split()
        for i, item in enumerate(items):
            own = item.split()
            width = len(own) + len(own) // 2
            best = max(decontam.common_subsequence(own, words[k : k + width]) for k in range(max(1, len(words) - width + 1)))
            if best >= decontam.COVER * len(own):
                want.add((d, i))
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in enumerate(texts)], DOCS)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench).collect()} == want and len(want) >= 20


def test_scores_from_marginals_of_whole_chains(spark):
    rng = random.Random(8)
    rows = []
    for d in range(160):
        words = rng.choices([f"{a}{b}ord" for a in "abcdefgh" for b in "abcdefgh"], k=rng.randrange(30, 60))
        if d % 3 == 0:  # what tells stands at the end
            words += rng.choices(["vileling", "scumbug"], k=8)
        rows.append((d, " ".join(words), "en", "s", 0))
    docs = spark.createDataFrame([*rows, (7, "other text", "en", "s", 0)], DOCS).withColumns({"toxic": F.lit(1), "h": F.lit(2), "id": F.lit(3)})
    labels = spark.createDataFrame([(d, 1, int(d % 3 == 0)) for d in range(160)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = {(r["doc_id"], r["score"]) for r in toxicity.score(docs, model).collect()}
    scores = dict(sorted(got))
    for d, text, *_ in rows[:40]:
        tokens = text.split()
        emit = model.emissions(tokens, np.arange(len(tokens)) == 0)
        toxic = toxicity.forward_backward(emit[:, None], np.array([len(tokens)]), model.moves)[0][:, 0]
        strong = toxic[toxic > toxicity.WEAK].sum()
        x = np.array([np.log1p(strong), toxic.max(), np.log1p(max(strong - toxic.max(), 0))])
        want = 1 / (1 + math.exp(-(model.curve[0] + x @ model.curve[1:])))
        assert d == 7 or abs(scores[d] - want) < 1e-6
        assert (scores[d] >= 0.5) == (d % 3 == 0) or d == 7
    long = spark.createDataFrame([(1, "word " * 200_000 + "vileling scumbug", "en", "s", 0)], DOCS)
    assert toxicity.score(long, model).count() == 1


def test_scores_of_the_language_model(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(WORDS[:60], k=rng.randrange(1, 40))), "en", "s", 0) for i in range(120)]
    docs = spark.createDataFrame(rows, DOCS).coalesce(2).withColumns({"key": F.lit(1), "token": F.lit("x"), "n": F.lit(2)})
    plain = docs.select("doc_id", "text").withColumn("held_out", lm.held_out(F.col("doc_id")))
    counts = lm.materialize(lm.counted(plain), "test-counts")
    model = lm.learn(plain, counts)
    n = {bytes(r["token"]): r["n"] for r in counts.collect()}
    kind = lambda w: 0 if w == lm.END else int(lm.classes_of(lm.located([w]), model.own)[0])
    total, distinct = {}, {}
    for w, c in n.items():
        total[kind(w)], distinct[kind(w)] = total.get(kind(w), 0) + c, distinct.get(kind(w), 0) + 1
    got = {r["doc_id"]: r["score"] for r in lm.scores(docs).collect()}
    for i, text, *_ in rows[:25]:
        words, want = [*text.encode().split(), lm.END], 0.0
        at = lm.contexts([text], model.own)[0]
        for k, w in enumerate(words):
            votes = [sum(float(model.weights[f, c]) for f in at[k]) for c in range(lm.CLASSES)]
            want += (votes[kind(w)] - math.log(sum(map(math.exp, votes)))) / math.log(10)
            want += math.log10(n.get(w, 0) + lm.ALPHA) - math.log10(total.get(kind(w), 0) + lm.ALPHA * (distinct.get(kind(w), 0) + 1))
        assert abs(got[i] - want) < 1e-2 * max(1, abs(want))


def test_added_spans_of_personal_data(spark):
    rng = random.Random(5)

    def card(good):
        while True:
            s = "4" + "".join(rng.choices("0123456789", k=15))
            if luhn(s) == good:
                return s

    texts, true = [], set()
    for d in range(150):
        kind = d % 6
        if kind == 0:
            texts.append(f"pay with {card(True)} now")
        elif kind == 1:
            texts.append(f"part {'9' + card(False)[1:]} x")
        elif kind == 2:  # two cards side by side are one run of digits to the base pattern
            a, b = card(True), card(True)
            texts.append(f"cards {a} {b} end")
            true |= {(d, f"card:6:22"), (d, "card:23:39")}
        elif kind == 3:
            texts.append(f"write to ann{d}@mail.example.com or joe [at] site [dot] com")
            true.add((d, f"email:{texts[-1].index('joe')}:{len(texts[-1])}"))
        elif kind == 4:
            texts.append(f"host 10.0.{d}.7 not 300.400.1.{d}")
        else:
            texts.append(f"call +1 (301) 555-{1000 + d} or tel 555-123-{2000 + d}")
            true.add((d, f"phone:{texts[-1].index('555-123')}:{len(texts[-1])}"))
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in enumerate(texts)] + [(3, texts[3], "en", "s", 0), (None, texts[0], "en", "s", 0)], DOCS).withColumns({"base": F.lit(1), "loose": F.lit(2), "email": F.lit(3), "n": F.lit(4)})
    rows = pii.detect(docs).collect()
    assert len(rows) == len(texts) + 2
    from test_llm import base_spans

    added = {(r["doc_id"], s) for r in rows if r["doc_id"] is not None for s in r["spans"].split(",") if s and s not in base_spans(texts[r["doc_id"]]).split(",")}
    assert len(added) >= 0.6 * len(true) and len(added & true) >= 0.95 * len(added)
    assert sum(r["n_added"] for r in rows) >= len(added)


def test_vectors_of_all_sizes_and_labels(spark):
    schema = "vec_id long, embedding array<double>, label string, id int, key int, copies int"
    rows = [(1, [1e-200, 2e-200], "a"), (2, [1e200, 2e200], "a"), (3, [1.0, 2.0], "a"), (3, [1.0, 2.0], "a"), (4, [2.0, 1.0], "a,1.0"), (5, [1.0, 2.0, 1.0], "a"), (None, [1.0, 2.0], "a"), (6, [2.0], "a,1.0,2.0")]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], schema)
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"]) for r in vecdup.near_vectors(df).collect())
    assert got == sorted([("1", 3, 1), ("2", 3, 1), ("3", 3, 1), ("3", 3, 1), ("4", 0, 4), ("5", 0, 5), ("6", 0, 6), ("None", 0, None)])
    assert vecdup.near_vectors(df.limit(0)).count() == 0


def test_intervals_agree_however_short(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 6))
    data = [(i, [float(v) for v in centres[i % 12] + rng.normal(scale=0.02, size=6)], i % 2) for i in range(3000)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    whole = sorted(map(tuple, vecdup.near_vectors(df).collect()))
    monkeypatch.setattr(vecdup, "INTERVAL", 0)  # 512 rows each
    assert sorted(map(tuple, vecdup.near_vectors(df).collect())) == whole and sum(r[1] for r in whole) > 1000


def test_archives_of_repeated_rows_and_long_payloads(spark):
    big, long = "b" * 1500, "é" * 300_000
    rows = [(7, "http://a.b/", big), (7, "http://a.b/", big), (5, None, big), (None, "u", big), (9, "v", long), (9, "v", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"key": F.lit(1), "archive": F.lit(2), "digest": F.lit(3)})
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archive_pages(pages).collect())
    assert [g[0] for g in got] == sorted(str(r[0]) for r in rows) and {g[1] for g in got} == {1500, 600_000}
    assert ("5", 1500, "revisit", 7) in got and ("7", 1500, "response", None) in got and ("9", 600_000, "response", None) in got


def test_clashing_columns(spark, clashing):
    import public_tokenizers

    n = clashing.count()
    assert tokenbin.token_output(clashing, public_tokenizers.path("word_bpe_49k.json")).count() == n
    assert sharding.balanced_shards(clashing, 4).count() == n == mixing.mix(clashing).count()
    assert neardup.deduplicated(clashing).columns == clashing.columns == mixing.mixed_documents(clashing).columns


def test_mixing_equal_rows_and_null_ids(spark):
    rows = [(None, "same words here", "en", "a", 0)] * 300 + [(i, f"w{i} x y", "en", "b", 0) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs, group=16).collect()
    mixed = mixing.mixed_documents(docs, group=16).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in mixed} == {s: sum(r["copies"] for r in got if r["source"] == s) for s in "ab"}
    assert zlib.crc32(b"") == 0 and max(r["copies"] for r in got) <= 2


def test_blocks_of_the_same_nodes_give_the_same_links():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 256, neardup.SLOTS).astype(np.uint8)
    nodes = []
    for k in range(60):
        sig = base.copy()
        sig[rng.permutation(neardup.SLOTS)[:20]] = k
        nodes.append([k, sig.tobytes()])
    links = set()
    for _ in range(neardup.BANDS):
        links |= set(neardup._alike([[nodes[k] for k in rng.permutation(60)]]))
    assert links == {(0, k) for k in range(1, 60)}
    text = " ".join(WORDS[:60])
    links = {link for _ in range(8) for link in neardup._linked([[[int(k), text] for k in rng.permutation(9)]])}
    assert links == {(0, k) for k in range(1, 9)}


def test_runs_of_letters_need_the_model_alone():
    import public_tokenizers

    encode = tokenbin.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), 1)
    assert {"a", "z", "\xe9", "\xff"} <= encode.letters
    _, splitter, model = encode.steps
    words = ["plainword", "h\xe9t\xe9rog\xe8ne", "\xdf\xe6\xf8œ", "don't", "a1b", "x", "ŉt"]
    expected = [encode._encode(w) for w in words]
    assert [encode.__missing__(w) for w in words] == expected

    class Refuses:
        def pre_tokenize_str(self, text):
            raise AssertionError(text)

    encode.clear()
    encode.steps = (None, Refuses(), model)
    assert [encode[w] for w in words[:3]] == expected[:3]


def test_the_latent_space_is_of_all_documents(spark):
    rng = random.Random(8)
    bench = spark.createDataFrame([(i, " ".join(rng.choices(WORDS[:30], k=40))) for i in range(3)], "item_id long, text string")
    texts = [" ".join(rng.choices(WORDS[:30], k=rng.randrange(0, 150))) for _ in range(2500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    (items,) = decontam.read_items(bench)
    size = len(items.terms)
    hashes, begins = decontam.hashed(texts)
    ids = items.numbered(hashes, begins)
    owner, low, high = decontam.passages(begins)
    table = np.zeros((len(low), size), np.int64)
    for p, (a, b) in enumerate(zip(low, high, strict=True)):
        np.add.at(table[p], ids[a:b][ids[a:b] >= 0], 1)
    sums, bases = table.T @ table, []
    for parts in (1, 5):
        dealt = docs.repartition(parts)
        got = decontam.counted(dealt, [items]).filter("block = 0").toPandas()
        square = np.zeros((size, size), np.int64)
        square[got["i"], got["j"]] = got["n"]
        assert (square == np.triu(sums)).all()
        bases.append(decontam.fit(dealt, [items], rank=32)[0].basis)
    assert np.allclose(*bases, atol=1e-5)
    # Of the space of all documents, and not of some of them: the sketch's range by plain products.
    weighed = sums * items.idf[:, None] * items.idf
    held = np.trace(bases[0].T @ weighed @ bases[0])
    assert held >= 0.9 * np.sort(np.linalg.eigvalsh(weighed))[-bases[0].shape[1] :].sum()
