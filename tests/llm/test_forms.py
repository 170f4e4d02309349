"""Fill-in-middle, byte-level BPE and spelling variants against plain versions, with the edge cases of each."""

import hashlib
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from docrecon.llm import bpe, fim, queries, variants

DOCS = "doc_id long, text string, score int, n int, form string, key int, word string, ids string"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def table(spark, texts, first=0):
    """Documents of the texts, with columns of names that the operators use themselves, an equal row and a null id."""
    rows = [(first + i, t, 1, 2, "x", 3, "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0], (None, texts[-1], 1, 2, "x", 3, "y", "z")], DOCS).repartition(3)


def odd_texts():
    rng = random.Random(5)
    some = ["plain words of a text. ", "é́\U0001f600 ", "<P", "S>", "  \n\t", "\x00", "ß", "<|endoftext|", ">", "123,456 ", "don't "]
    mixed = ["".join(rng.choices(some, k=rng.randrange(1, 90))) for _ in range(150)]
    return [None, "", "a", "<P>in", "an <S> in", "<M>", "x" * 64, "y" * 128, "z" * 129, "long \U0001f600 " * 30_000, "a  <|endoftext|>  b", *mixed]


def cut_plainly(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    lo, hi = sorted((a % (n + 1), b % (n + 1)))
    if not n or any(x in text for x in ("<P>", "<S>", "<M>")) or c % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:lo], text[lo:hi], text[hi:]
    return (n, "spm", lo, hi - lo, f"<S>{s}<P>{p}<M>{m}") if d % 100 < 20 else (n, "psm", lo, hi - lo, f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(spark):
    docs = table(spark, odd_texts())
    made = fim.transform(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    rows = docs.select("doc_id", "text").collect()
    want = Counter((i, *cut_plainly(i, t), t or "") for i, t in rows)
    assert Counter(tuple(r) for r in made) == want and len({r["form"] for r in made}) == 3
    assert fim.transform(docs.limit(0)).count() == 0


def test_fill_in_middle_of_words(spark):
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (1, 63, 64, 65, 200, 700)]
    made = fim.transform(table(spark, texts), unit=r"\S+|\s+", plain=100).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    for r in made:
        assert r["back"] in texts and r["n"] == 2 * len(r["back"].split()) - 1
        parts = re.split("<[PSM]>", r["output"])[1:]
        assert all(len(re.findall(r"\S+|\s+", p)) in (r["prefix_chars"], r["middle_chars"], r["n"] - r["prefix_chars"] - r["middle_chars"]) for p in parts)


def test_merges_come_leftmost_of_the_lowest_rank():
    rng = random.Random(1)
    for _ in range(300):
        ranks, new = {}, 4
        for rank in range(12):  # pairs of single and of merged symbols
            pair = (rng.randrange(new), rng.randrange(new))
            if pair not in ranks:
                ranks[pair] = (rank, new)
                new += 1
        ids = [rng.randrange(4) for _ in range(rng.randrange(40))]
        want = list(ids)
        while found := [(ranks[p][0], k) for k, p in enumerate(zip(want, want[1:], strict=False)) if p in ranks]:
            k = min(found)[1]
            want[k : k + 2] = [ranks[want[k], want[k + 1]][1]]
        assert bpe.merged(ids, ranks) == want


def test_byte_bpe_is_the_librarys(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    docs = table(spark, [*odd_texts(), "aaaa" * 5000, " " * 3000, "\r\n\x85\xa0 　\x1c\x1f x", "I'll 's'S ''t", "éﬁ٠²"])
    encoded = bpe.encode(docs, PATH).withColumn("text", F.lit(1)).drop("text").cache()
    want = Counter((i, tuple(plain.encode(t or "", add_special_tokens=False).ids)) for i, t in docs.select("doc_id", "text").collect())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in encoded.collect()) == want
    back = bpe.decode(encoded.withColumn("more", F.lit(5)), PATH)
    assert back.columns == ["doc_id", "text", "more"]
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter((i, t or "") for i, t in docs.select("doc_id", "text").collect())
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def test_classes_of_characters_are_the_librarys():
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(PATH), bpe.coder(PATH)
    every = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000]
    for k in range(0, len(every), 4096):
        text = "".join(f"a{c}1{c}\n" for c in every[k : k + 4096])
        assert own.encode(text) == own._packed(plain.encode(text, add_special_tokens=False).ids)


def test_ids_that_no_text_gives_are_decoded(spark):
    from tokenizers import Tokenizer

    lists = [[128, 50256, 64], [100, 200, 130], [], None, [50257, -1, 65], [None, 66]]
    got = [r["text"] for r in bpe.decode(spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "k int, ids array<int>"), PATH).orderBy("k").collect()]
    plain = Tokenizer.from_file(PATH)
    assert got[:3] == [plain.decode(x, skip_special_tokens=False) for x in lists[:3]] and got[3:] == ["", plain.decode([65]), plain.decode([66])]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe.Coder(public_tokenizers.path("word_bpe_49k.json"))


def variant_texts():
    rng = random.Random(9)
    letters = "abcdeéß×ÿñ"
    base = ["".join(rng.choices(letters, k=rng.randrange(6, 13))) for _ in range(120)]
    near = []
    for w in base * 6:
        k, c = rng.randrange(len(w)), rng.choice(letters)
        near.append(rng.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :], w + c, w]))
    chain = ["stepsone"] * 2000 + ["stepsonE"] * 5 + ["stepszone"] * 150 + ["stepszones"] * 12 + ["stepszzones"] * 1 + ["aaaaaaaa"] * 3 + ["aaaaaaa"] * 3 + ["aaaaaaaaa"] * 2
    words = base * 2 + near * 2 + chain
    rng.shuffle(words)
    return [rng.choice([" ", ", ", "1", "Ā"]).join(words[k : k + 40]) for k in range(0, len(words), 40)] + [None, "", "short words", "ab" * 40_000]


def plainly(rows):
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return any(b[:k] + b[k + 1 :] == a for k in range(len(b))) if len(b) == len(a) + 1 else False

    by = {w: [x for x in words if x != w and near(w, x)] for w in words}
    form = {}
    for w, xs in by.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(by[w]), words.get(form[w])) for w, n in words.items()}


def test_spelling_variants(spark):
    docs = table(spark, variant_texts())
    got = variants.spelling_variants(docs).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == plainly(docs.select("doc_id", "text").collect())
    assert any(r["root"] != r["form"] for r in got if r["form"]) and any(r["n_near"] > 2 for r in got)
    assert variants.spelling_variants(docs.limit(0)).count() == 0


def test_letters_that_share_a_bit_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(variants, "WIDTH", 2)
    docs = table(spark, variant_texts())
    assert {tuple(r) for r in variants.spelling_variants(docs).collect()} == plainly(docs.select("doc_id", "text").collect())


def test_queries_give_the_columns_of_their_contracts(spark):
    sf = "/root/testdata/sf0.001"
    assert queries.op11_fill_in_middle(spark, sf).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert queries.op12_byte_bpe(spark, sf).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
