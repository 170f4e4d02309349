"""Byte-level BPE: the words that texts hold anew are worked out together."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from docrecon.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_new_short_words_take_their_steps_together(monkeypatch):
    alone, one_by_one = [], bpe.merged
    monkeypatch.setattr(bpe, "merged", lambda ids, ranks: alone.append(len(ids)) or one_by_one(ids, ranks))
    rng = random.Random(7)
    kinds = ("abestrnio", "aé中\U0001f600", " \n\t\x1c\x85\xa0a.1'")
    texts = ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(0, 90))) for _ in range(300)]
    texts += [None, "", "a" * 64, "a" * 65, "x" * 500 + " <|endoftext|> y", "ab" * 31 + " é" * 40]
    own, library = bpe.Coder(PATH), Tokenizer.from_file(PATH)
    found = [np.frombuffer(x, own.dtype).tolist() for x in own.encode_all(texts)]
    assert found == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    alone.clear()
    bpe.Coder(PATH).encode_all(["several words that were never seen"])
    assert not alone


def test_lists_are_decoded_in_one_take():
    own = bpe.Coder(PATH)
    ids = np.frombuffer(own.encode("né 中") + own.encode("b") + own.encode("\U0001f600"), own.dtype)
    n = [len(own.encode(t)) // 4 for t in ("né 中", "b", "\U0001f600")]
    ends = np.cumsum([0, *n])
    assert list(own.decode(ids, ends)) == ["né 中", "b", "\U0001f600"]
    assert list(own.decode(np.concatenate([[-1], ids, [1 << 30]]).astype("<i4"), ends[1:2].repeat(2) + 1)) == [""]
    assert list(own.decode(ids[:0], np.array([0, 0]))) == [""]
