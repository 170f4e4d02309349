"""The corpus pipeline, stage by stage against plain versions of what each decides."""

import random
import zlib

import numpy as np
import public_tokenizers
from test_llm import DOCS

import corpus_pipeline
from docrecon.llm import decontam, neardup, toxicity


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(12)
    plain = [f"{a}{b}word" for a in "abcdefghij" for b in "klmnopqrst"]
    item = " ".join(rng.choices(plain, k=24))
    texts = [rng.choices(plain, k=rng.randrange(30, 70)) for _ in range(90)]
    for d in range(0, 90, 5):
        texts[d] += ["vileling", "scumbug", "vileling"]
    for d in (11, 12):
        texts[d] = [*texts[1]]
    texts[12][20] = "changed"
    texts[13][4:4] = item.split()
    texts[14][9:9] = ["new" if k % 9 == 4 else w for k, w in enumerate(item.split())]
    rows = [(d, " ".join(t), "en", f"s{d % 3}", 0) for d, t in enumerate(texts)] + [(90, None, "en", "s0", 0), (91, "", "en", None, 0)]
    labels = [(d, 1, int(d % 5 == 0)) for d in range(90)]
    sf = str(tmp_path)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")

    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{sf}/stage{k}")
        docs = spark.read.parquet(f"{sf}/stage{k}")
        seen.append([tuple(r) for r in docs.collect()])
        assert k == 4 or docs.columns == [c.split()[0] for c in DOCS.split(", ")]

    # Toxicity: the field trained on the same labels in one process, scored text by text.
    learned = [(d, y) for d, _, y in labels if zlib.crc32(str(d).encode()) % 5]
    model = toxicity.train([rows[d][1] for d, _ in learned], [y for _, y in learned])
    score = lambda t: 1 / (1 + np.exp(-(model.curve[0] + toxicity.measured(model, [(t or "").lower()])[0][0] @ model.curve[1:])))
    clean = [r for r in rows if score(r[1]) < 0.5]
    assert sorted(seen[0]) == sorted(clean, key=lambda r: r[0]) or sorted(map(str, seen[0])) == sorted(map(str, clean))
    assert {r[0] for r in clean} == {r[0] for r in rows} - set(range(0, 90, 5))

    # Near-duplicates: all pairs.
    sets = {r[0]: neardup.occurrences([r[1]])[0] for r in clean}
    gone = set()
    for i in sets:
        for j in sets:
            both = len(np.intersect1d(sets[i], sets[j]))
            either = len(sets[i]) + len(sets[j]) - both
            if i < j and (not either or both >= 0.8 * either):
                gone.add(j)
    left = [r for r in clean if r[0] not in gone]
    assert sorted(map(str, seen[1])) == sorted(map(str, left)) and {11, 12, 91} <= gone

    # Decontamination: the longest common subsequence with every stretch.
    own = item.split()
    holds = lambda t: any(decontam.common_subsequence(own, (t or "").split()[k : k + 36]) >= decontam.COVER * 24 for k in range(max(1, len((t or "").split()) - 35)))
    clear = [r for r in left if not holds(r[1])]
    assert sorted(map(str, seen[2])) == sorted(map(str, clear)) and {r[0] for r in left} - {r[0] for r in clear} == {13, 14}

    # Mixing: whole documents, each twice at most, every source near its target.
    size = lambda r: len((r[1] or "").split())
    assert set(seen[3]) <= set(clear) and all(seen[3].count(r) <= 2 for r in clear)
    order = sorted({r[3] for r in clear if r[3] is not None}) + ([None] if any(r[3] is None for r in clear) else [])
    total, weight = sum(map(size, clear)), {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    cap = {s: 2 * sum(size(r) for r in clear if r[3] == s) for s in order}
    target, open_, room = {}, set(order), 1.5 * total
    while open_:
        level = room / sum(weight[s] for s in open_)
        stop = {s for s in open_ if level * weight[s] > cap[s]} or None
        target |= {s: cap[s] for s in stop} if stop else {s: level * weight[s] for s in open_}
        room -= sum(cap[s] for s in stop or ())
        open_ = open_ - stop if stop else set()
    for s in order:
        assert abs(sum(size(r) for r in seen[3] if r[3] == s) - target[s]) <= max((size(r) for r in clear if r[3] == s), default=0)

    # Token ids: the library's own, document by document.
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = lambda t: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
    assert sorted((r[0], r[2], r[3]) for r in seen[4]) == sorted((r[0], len(ids(r[1])), zlib.crc32(ids(r[1]).tobytes())) for r in seen[3])
    whole = corpus_pipeline.run(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, whole)) == sorted(r[:4] for r in seen[4])
