"""Cases of the findings on BPE and line dedup."""

from __future__ import annotations

import random

import numpy as np

from seqloom.llm import bpe
from seqloom.llm.queries import bpe_file


class Watched:
    """A tokenizers file's normaliser that counts its calls."""

    def __init__(self, real):
        self.real, self.calls = real, 0

    def normalize_str(self, text):
        self.calls += 1
        return self.real.normalize_str(text)


def test_accented_words_do_not_pass_through_the_library():
    from tokenizers import Tokenizer

    lib, model = Tokenizer.from_file(bpe_file()), bpe.PrefixBpe(bpe_file())
    memo = bpe.Chunks(model, 1000)
    normaliser = Watched(lib.normalizer)
    model.library = type("File", (), {"normalizer": normaliser, "pre_tokenizer": lib.pre_tokenizer})
    r = random.Random(3)
    plain = "aBtsé'ÉßÿÀÞØäöü.,!?)-7"
    texts = ["".join(r.choices(plain, k=r.randint(1, 12))) for _ in range(3000)] + ["SCHGEÜ!!", "d'Été", "L'ÉLÈVE'S,"]
    for t in texts:
        assert np.frombuffer(memo[t.encode()], np.int32).tolist() == lib.encode(t, add_special_tokens=False).ids, t
    assert normaliser.calls == 0
    odd = plain + "×÷ªºµ¼²\xad\x80́̈İſŉΣ<"
    for t in ("".join(r.choices(odd, k=r.randint(1, 12))) for _ in range(3000)):
        got = b"".join(memo[w] for w in t.encode().split())
        assert np.frombuffer(got, np.int32).tolist() == lib.encode(t, add_special_tokens=False).ids, t
    assert normaliser.calls > 0


def test_words_encoded_together_are_the_words_encoded_alone():
    model = bpe.PrefixBpe(bpe_file())
    r = random.Random(8)
    vocab = [t.replace("</w>", "") for t in model.library.get_vocab()]
    words = {"".join(r.choices(vocab, k=r.randint(1, 4))) for _ in range(4000)} | {"a", "é", "z" * 64, "z" * 65, "z" * 63 + "é", "tion" * 16}
    pieces = [w for w in words if w and len(w) <= bpe.LONGEST and all(c in bpe.alphabet("abcdefghijklmnopqrstuvwxyzäéñßÿ") for c in w)]
    assert len(pieces) > 1000
    assert model.encode_pieces(pieces) == [model.encode_piece(p) for p in pieces]
    assert model.encode_pieces(pieces[:1]) == [model.encode_piece(pieces[0])]
    chunks = {c for p in words for c in (p + ",", p.capitalize(), p + "é!?", p + "\xd7") if p} | {",", "!!", "Été.", "é,"}
    memo, alone = bpe.Chunks(model, 100), bpe.Chunks(bpe.PrefixBpe(bpe_file()), 100)
    for _ in range(2):
        got = memo.of([c.encode() for w in chunks for c in w.split()])
        assert all(ids == alone[c] for c, ids in got.items())
    assert memo.of([]) == {}
