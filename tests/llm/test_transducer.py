"""The streaming transducer against the library, whatever pieces a text arrives in, and what it holds meanwhile."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tesserae.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["the cat", " it's", "\n\n", "  ", "日本", " é", "🙂", "xyz" * 40, " 12", "!!", "\t", " word", "'ll", "<|endoftext|>", "<|endof", "text|>", "\x85", "　", "12345678" * 9, " ", "\r\n", "?!" * 40]


def ids_of(text, sizes, rng):
    machine, out, at, most = bpe.Transducer(bpe.encoder(PATH)), [], 0, 0
    while at < len(text):
        n = rng.choice(sizes)
        out += machine.feed(text[at : at + n], at + n >= len(text))
        at += n
        most = max(most, len(machine.held) + (len(machine.machine.buffer) if machine.machine else 0))
    return np.frombuffer(b"".join(out), "<i4").tolist(), most


@pytest.mark.parametrize("held", [4, 40, bpe.HELD])
def test_any_pieces_give_the_librarys_ids(monkeypatch, held):
    monkeypatch.setattr(bpe, "HELD", held)
    library, rng = Tokenizer.from_file(PATH), random.Random(held)
    for _ in range(400):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30)))
        want = library.encode(text, add_special_tokens=False).ids
        assert ids_of(text, [1, 2, 5, 30, 200], rng)[0] == want
        assert bpe.encoder(PATH).encode(text).tolist() == want


@pytest.mark.parametrize("text", ["ab" * 300_000, " " * 200_000 + "a", "\n" * 150_001, "7" * 200_000, "!?" * 100_000 + "<|endoftext|>", "日本語" * 60_000, "x" * 100_000 + "　" * 90_000 + " y", "a b " * 100_000])
def test_long_runs_in_constant_memory(text):
    rng = random.Random(3)
    want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    got, most = ids_of(text, [4096], rng)
    assert got == want
    assert most <= bpe.HELD + 4096 + 4 * bpe.vocabulary(PATH).window
    assert bpe.encoder(PATH).encode(text).tolist() == want
