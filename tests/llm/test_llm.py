"""The training-data operators against brute force, on small fixtures with the edge cases of each."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from docrecon.llm import decontam, lm, mixing, neardup, pii, sharding, tokenbin, toxicity, vecdup, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}x" for i in range(400)]


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    texts = [" ".join(rng.choices(WORDS, k=rng.randrange(1, 200))) for _ in range(n)]
    texts[3] = texts[1]
    near = texts[0].split() * 2
    texts[0] = " ".join(near)
    near[7] = "other"
    texts[5] = " ".join(near)
    texts[10], texts[11], texts[12] = "", "one", "long " * 20_000
    return [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t)) for i, t in enumerate(texts)] + [(n, None, "en", "s0", 0), (None, "lost one", "en", "s1", 8), (2, texts[2], "en", "s2", 3)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_token_files(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    got = tokenbin.token_output(docs, path).orderBy("start").collect()
    at = 0
    by_id = {}
    for r in corpus():
        ids = np.array([*plain.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        by_id.setdefault(r[0], []).append((len(ids), zlib.crc32(ids.tobytes())))
    for r in got:
        assert r["start"] == at and (r["n_tokens"], r["ids_crc32"]) in by_id[r["doc_id"]]
        at += r["n_tokens"]
    keys = [r["doc_id"] for r in got]
    assert keys == sorted(keys, key=lambda k: -1 if k is None else k) and len(got) == len(corpus())
    assert tokenbin.token_output(empty, path).count() == 0


@pytest.mark.parametrize("text", ["It's A test, 12.5%% done***", "Été H̱a ΣΑΣ", "a\x1cb c", "<|endoftext|> x", "  \n", "é́ İx ﬁ"])
def test_chunks_give_the_tokenizers_ids(text):
    e = tokenbin.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), 1)
    assert e.by_chunk and next(e([text])) == np.array([*e.tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u2").tobytes()


def test_balanced_shards(docs, empty):
    got = sharding.balanced_shards(docs, 5).collect()
    rows = sorted(((r[0] if r[0] is not None else -1, len((r[1] or "").encode()) + 16) for r in corpus()))
    total, at, want = sum(s for _, s in rows), 0, []
    for key, size in rows:
        want.append((key, size, min(int((2 * at + size) * 5 / (2 * total)), 4)))
        at += size
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["shard"]) for r in got) == sorted(want)
    for shard in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert sharding.balanced_shards(empty).count() == 0


def test_mix(spark, docs, empty):
    got = mixing.mix(docs, group=4).collect()
    again = mixing.mix(docs.repartition(5), group=4).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(corpus())
    by = {}
    for r in got:
        assert r["taken"] <= 2 * r["size"]
        by.setdefault(r["source"], []).append(r)
    total = sum(r["size"] for r in got)
    targets = {s: rs[0]["target"] for s, rs in by.items()}
    assert abs(sum(targets.values()) - 1.5 * total) < 1e-6 * total
    order = sorted((s for s in by if s is not None)) + ([None] if None in by else [])
    weight, cap = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, {s: 2 * sum(r["size"] for r in by[s]) for s in order}
    open_, left, want = set(order), 1.5 * total, {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        stop = {s for s in open_ if level * weight[s] > cap[s]}
        want |= {s: cap[s] for s in stop} if stop else {s: level * weight[s] for s in open_}
        left -= sum(cap[s] for s in stop)
        open_ = open_ - stop if stop else set()
    assert all(abs(want[s] - targets[s]) < 1e-6 * total for s in order)
    for s, rs in by.items():
        assert abs(sum(r["taken"] for r in rs) - targets[s]) <= max(r["size"] for r in rs)
    mixed = mixing.mixed_documents(docs, group=4)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in got)
    assert mixing.mix(empty).count() == 0


def test_near_duplicates(spark, docs, empty):
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()}
    rows = [(i, (t or "").split()) for i, t, *_ in corpus() if i is not None]
    bags = {}
    for i, w in rows:
        bag = {}
        for s in [tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))] if w else []:
            bag[s] = bag.get(s, 0) + 1
        bags[i] = bag
    parent = {i: i for i in bags}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in bags:
        for j in bags:
            both = sum(min(n, bags[j].get(s, 0)) for s, n in bags[i].items())
            either = sum(bags[i].values()) + sum(bags[j].values()) - both
            if i < j and (bags[i] == bags[j] if not either else both >= 0.8 * either):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert {i: root(i) for i in bags} == {i: c for i, c in got.items() if i is not None}
    assert got[0] == got[5] == 0 and got[3] == 1
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == len({root(i) for i in bags}) + 1
    assert neardup.near_duplicates(empty).count() == 0


def test_signatures_estimate_weighted_similarity():
    a = " ".join(WORDS) + " " + " ".join(WORDS[:150])
    b = " ".join(WORDS[:350]) + " " + " ".join(WORDS[:40])
    x, y = neardup.occurrences([a, b])
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    s = [np.frombuffer(v, np.uint8) for v in neardup.signatures([a, b])]
    assert abs(neardup.estimated((s[0] == s[1]).sum()) - true) < 0.12


def test_large_blocks_agree_with_small_ones(spark, monkeypatch):
    base = WORDS[:60]
    rows = [(i, " ".join(base[:i] + [f"z{i}"] + base[i + 1 :]), "en", "s", 0) for i in range(40)]
    df = spark.createDataFrame(rows, DOCS)
    monkeypatch.setattr(neardup, "CHUNK", 5)
    monkeypatch.setattr(neardup, "TEXT_CHUNK", 5)
    assert {r["class_id"] for r in neardup.near_duplicates(df).collect()} == {0}


def test_warc(spark):
    big = "<p>" + "x" * 2000
    rows = [(1, "http://www.Example.com:80/a?b=1#c", big), (2, "https://sub.example.org", big), (3, None, "small"), (4, "http://www.example.com/a", None), (5, "x", "small"), (None, "http://a.b/", "é" * 600), (7, "http://a.b/", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = warc.write_archives(pages)
    got = {r["page_id"]: r for r in warc.read_archives(manifest).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {1: ("revisit", 7), 2: ("revisit", 7), 3: ("response", None), 4: ("response", None), 5: ("response", None), None: ("response", None), 7: ("response", None)}
    for i, _, html in rows:
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len((html or "").encode()), hashlib.sha1((html or "").encode()).hexdigest())
    assert got[1]["url_key"] == "com,example,www:80)/a?b=1" == warc.url_key(rows[0][1])
    found = warc.lookup(manifest, "http://a.b/")
    assert {h.get("X-Page-ID") for h, _ in found} == {None, "7"} and {len(b) for _, b in found} == {1200, len(big)}
    assert warc.lookup(manifest, "http://none/") == [] and warc.archive_pages(pages.limit(0)).count() == 0


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(int(c) for c in reversed(s))) % 10 == 0


def base_spans(text):
    good = {"email": lambda s, d: True, "ip": lambda s, d: all(int(x) <= 255 for x in s.split(".")), "card": lambda s, d: 16 <= len(d) <= 19 and luhn(d), "phone": lambda s, d: 8 <= len(d) <= 15}
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PII.items() for m in re.finditer(p, text) if good[k](m[0], re.sub("[^0-9]", "", m[0])))


def test_personal_data(spark, empty):
    texts = ["a@b.c_d@e.f x", "née 1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (301) 555-0346 +1((", None, "", "1" * 30_000 + " a" * 10 + "@" * 5000, "x😀 a.b%c@d-e.co.uk. 😀 +49 30 123456", "mail me: joe [at] site [dot] com, tel 555-123-4567", "..a@b..c a@b-.c@d.e"]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r for r in pii.detect(df).collect()}
    for i, t in enumerate(texts):
        spans = base_spans(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest(), t
        assert set(filter(None, spans.split(","))) <= set(got[i]["spans"].split(","))
        assert sum(got[i][f"n_{k}"] for k in PII) == len(list(filter(None, spans.split(","))))
    assert pii.detect(empty).count() == 0


def test_estimation_finds_the_reliable_labeler():
    share, rates = pii.estimate([((1, 1, -1, 1), 80.0), ((0, 1, -1, 0), 40.0), ((0, 0, -1, 0), 60.0), ((1, 0, -1, 1), 5.0)])
    assert pii.posterior((1, 1, -1, 1), share, rates) > 0.9 > 0.2 > pii.posterior((0, 0, -1, 0), share, rates)


def test_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 16))
    rows = [(i, base[i % 40] + rng.normal(scale=0.03 * (i // 40), size=16), i % 3 if i % 3 else i % 2) for i in range(200)]
    data = [(i, [float(v) for v in x], int(label)) for i, x, label in rows] + [(200, data_ := [float(v) for v in rows[0][1]], 0), (201, data_, None), (202, [0.0] * 16, 0), (203, None, 0), (204, [float("nan")] * 16, 1), (205, [1.0, None], 1), (206, [1.0, 0.0], 0)]
    got = {r["vec_id"]: r for r in vecdup.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")).collect()}
    good = {i: (label, np.array(v) / np.linalg.norm(v)) for i, v, label in data if i <= 200}
    parent = {i: i for i in got}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = dict.fromkeys(got, 0)
    for i, (a, x) in good.items():
        for j, (b, y) in good.items():
            if i != j and a == b and x @ y >= 0.98:
                links[i] += 1
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    assert {i: (links[i], root(i)) for i in got} == {i: (r["n_links"], r["component_id"]) for i, r in got.items()} and sum(links.values()) > 50


def test_decontamination(spark, empty):
    rng = random.Random(4)
    items = [(i, " ".join(rng.choices(WORDS, k=rng.randrange(12, 60))) + ".") for i in range(30)]
    rows, planted = [], set()
    for d in range(60):
        words = rng.choices(WORDS, k=rng.randrange(5, 300))
        if d % 4 == 0:
            item = items[d % 30][1].rstrip(".").split()
            if d % 8 == 0:  # a paraphrase: every ninth word another
                item = [("new" if k % 9 == 4 else w) for k, w in enumerate(item)]
            at = rng.randrange(len(words))
            words[at:at] = item
            planted.add((d, d % 30))
        rows.append((d, " ".join(words), "en", "s", 0))
    rows += [(100, None, "en", "s", 0), (101, "", "en", "s", 0)]
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame([*items, (99, None), (98, "too short")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench).collect()}
    assert got == planted
    assert {r["doc_id"] for r in decontam.uncontaminated(docs, bench).collect()} == {r[0] for r in rows} - {d for d, _ in planted}
    assert decontam.contaminated(empty, bench).count() == 0 and decontam.contaminated(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("n", [10, 60, 300])
def test_decontamination_finds_what_many_documents_share(spark, n):
    rng = random.Random(14)
    items = [(i, " ".join(rng.choices(WORDS, k=8 + 3 * i))) for i in range(8)]
    rows, planted = [], set()
    for d in range(n):
        words = rng.choices(WORDS, k=rng.randrange(20, 200))
        if d % 3 == 0:  # one item in a third of the rows
            words[10:10] = items[0][1].split()
            planted.add((d, 0))
        if d % 15 == 0:  # beside one that few hold
            words[30:30] = items[5][1].split()
            planted.add((d, 5))
        rows.append((d, " ".join(words), "en", "s", 0))
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench).collect()} == planted


def test_decontamination_by_many_and_long_items(spark):
    rng = random.Random(15)
    words = [f"v{i}y" for i in range(3000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(15, 60)))) for i in range(1000)] + [(1000, " ".join(rng.choices(words, k=900)))]
    rows, planted = [], set()
    for d in range(200):
        own = rng.choices(words, k=rng.randrange(20, 120))
        i = 1000 if d == 0 else d * 5
        put = items[i][1].split()
        if d % 2:  # a paraphrase: every ninth word another
            put = ["new" if k % 9 == 4 else w for k, w in enumerate(put)]
        own[10:10] = put
        planted.add((d, i))
        rows.append((d, " ".join(own), "en", "s", 0))
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench).collect()} == planted


def test_toxicity(spark, empty):
    rng = random.Random(6)
    rows = []
    for d in range(400):
        words = rng.choices([a + b + "ord" for a in "abcdefghijklmnop" for b in "abcdefghijklmnop"], k=rng.randrange(5, 80))
        if d % 4 == 0:
            for bad in rng.choices(["vileling", "vileness", "scumbug"], k=3):
                words.insert(rng.randrange(len(words)), bad)
        rows.append((d, " ".join(words), "en", "s", 0))
    docs = spark.createDataFrame([*rows, (900, None, "en", "s", 0), (901, "", "en", "s", 0)], DOCS)
    labels = spark.createDataFrame([(d, 1, int(d % 4 == 0)) for d in range(400)] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [d for d in range(400) if got[d]["held_out"]]
    assert held == [d for d in range(400) if zlib.crc32(str(d).encode()) % 5 == 0]
    assert sum(got[d]["predicted"] == (d % 4 == 0) for d in held) >= 0.97 * len(held) and got[900]["predicted"] == got[901]["predicted"] == 0
    span = next(s for d in held if d % 4 == 0 for s in [got[d]["spans"]] if s)[0]
    assert span["end"] > span["start"]
    clean = toxicity.clean_documents(docs, toxicity.fit(docs, labels))
    assert clean.columns == docs.columns and clean.count() == sum(r["predicted"] == 0 for r in got.values())
    assert toxicity.toxicity(empty, labels).count() == 0 and toxicity.toxicity(docs, labels.limit(0)).filter("score != 0").count() == 0


def test_marginals_agree_with_enumeration():
    rng = np.random.default_rng(1)
    emit, moves = rng.normal(size=7), rng.normal(size=(2, 2))
    weights = []
    for code in range(1 << 7):
        tags = [code >> t & 1 for t in range(7)]
        weights.append((np.exp(sum(e * t for e, t in zip(emit, tags, strict=True)) + sum(moves[a, b] for a, b in zip(tags, tags[1:], strict=False))), tags))
    total = sum(w for w, _ in weights)
    want = [sum(w for w, t in weights if t[i]) / total for i in range(7)]
    got, joint, norm = toxicity.forward_backward(emit[:, None], np.array([7]), moves)
    assert np.allclose(got[:, 0], want) and np.isclose(norm[0], np.log(total)) and np.isclose(joint.sum(), 6)
    stream = toxicity.stream_marginals(np.concatenate([emit, emit]), np.array([True, *[False] * 6] * 2), moves, block=4)
    assert np.allclose(stream, want * 2)


def test_language_model_learns_from_every_training_document(spark):
    rows = [(i, "a b " * 5 if i % 2 else "c d " * 5, "en", "s", 0) for i in range(8000)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    own = docs.select("text", F.col("doc_id")).withColumn("held_out", lm.held_out(F.col("doc_id")))
    # A feature that only one document has is met, whichever document it is.
    one = own.unionByName(spark.createDataFrame([(f"only{i} next{i}", i, False) for i in range(9000, 9040)], "text string, doc_id long, held_out boolean"))
    model = lm.learn(one, lm.materialize(lm.counted(one), "test-counts"))
    met = [model.weights[lm.contexts([f"only{i} next{i}"], model.own)[0][1]].any(axis=1).all() for i in range(9000, 9040)]
    assert all(met)


def test_language_model(docs, empty):
    got = lm.scores(docs).collect()
    rows = corpus()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    counts = {}
    for i, t, *_ in rows:
        for w in tokens(t) if not held(i) else ():
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), held(i), len(tokens(t)), sum(w in counts for w in tokens(t)), n, round(sum(np.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 3)) for i, t, *_ in rows)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 3)) for r in got) == want
    assert all(r["score"] < 0 for r in got) and lm.scores(empty).count() == 0


def test_rare_tokens_count_alike_outside_the_head(docs, monkeypatch):
    whole = {str(r["doc_id"]) + str(r["n_tokens"]): r["base_score"] for r in lm.scores(docs).collect()}
    monkeypatch.setattr(lm.learn, "__defaults__", (20,))
    few = {str(r["doc_id"]) + str(r["n_tokens"]): r["base_score"] for r in lm.scores(docs).collect()}
    assert whole.keys() == few.keys() and all(abs(whole[k] - few[k]) < 1e-6 * max(1, abs(whole[k])) for k in whole)


def test_extra_columns(spark):
    df = spark.createDataFrame(corpus(20), DOCS).withColumns({"id": F.lit(1), "row": F.lit("x"), "copies": F.lit(2), "bucket": F.lit(3)})
    assert mixing.mixed_documents(df).columns == df.columns and neardup.deduplicated(df).columns == df.columns


def test_language_model_is_a_function_of_the_table(docs):
    parts = [{(r["doc_id"], r["n_tokens"], round(r["base_score"], 6)): r["score"] for r in lm.scores(docs.repartition(n)).collect()} for n in (1, 7, 64)]
    for other in parts[1:]:
        assert other.keys() == parts[0].keys() and all(abs(other[k] - s) <= 1e-5 * abs(s) for k, s in parts[0].items())


def test_language_model_gradient(spark):
    texts = ["a b c a b", "b a", None, "", "c c c " * 40]
    rng = np.random.default_rng(3)
    own = lm.hash_words([b"a"])[0]
    weights = rng.normal(size=(4 << lm.BITS, lm.CLASSES)).astype(np.float32)
    train = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    for w in (None, weights):
        total, count = lm.gradient(train, own, w)
        want, seen = np.zeros(total.shape), np.zeros(len(total))
        for text in texts:
            at, kinds, _ = lm.contexts([text], own)
            for features, kind in zip(at, kinds, strict=True):
                power = np.exp(weights[features].sum(axis=0, dtype=float))
                for f in features:
                    want[f, kind] += 1
                    want[f] -= power / power.sum() if w is not None else 0
                    seen[f] += 1
        assert np.allclose(total, want, atol=1e-4) and (count == seen).all()


def test_language_model_beats_counts_on_held_out_texts(spark):
    rows = [(i, ("the cat sat on the mat " if i % 2 else "a dog ran to a tree ") * (1 + i % 3), "en", "s", 0) for i in range(600)]
    held = [r for r in lm.scores(spark.createDataFrame(rows, DOCS)).collect() if r["held_out"]]
    assert held and all(r["score"] > 0.8 * r["base_score"] for r in held)


def test_language_model_features_of_one_document_move(spark):
    rows = [("a b " * 5 if i % 2 else "c d " * 5, i, False) for i in range(500)] + [(f"only{i} next{i}", i, False) for i in range(9000, 9040)]
    own = spark.createDataFrame(rows, "text string, doc_id long, held_out boolean").repartition(5)
    model = lm.learn(own, lm.materialize(lm.counted(own), "test-counts"))
    kinds, times = np.unique(model.weights, axis=0, return_counts=True)
    unseen = kinds[times.argmax()]  # most of the buckets are empty, and alike
    for i in range(9000, 9040):
        assert (model.weights[lm.contexts([f"only{i} next{i}"], model.own)[0][1]] != unseen).any(axis=1).all()
