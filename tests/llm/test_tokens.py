"""The remembering encoder against the plain one, on texts made to trip it."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from spindrift.llm import tokens
from spindrift.llm.common import utf8_view

ALPHABET = [*"abzAZ éßñÉ×÷ΩσΣ中1٣ \n\t\x0b\x1c 　̸́.,!?;:#$%&*<>|'’", "<|endoftext|>", "'s", "'ll", "!!", "word", "<|startoftext|>", " the", " ", " "]


def made(seed, n):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 30))) for _ in range(n)]


def agree(encoder, plain, texts):
    ids, off = encoder.encode(*utf8_view(pa.array(texts)))
    for k, t in enumerate(texts):
        assert ids[off[k] : off[k + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_like_the_plain_encoder(name, monkeypatch):
    path = public_tokenizers.path(name)
    encoder, plain = tokens.Encoder(path), Tokenizer.from_file(path)
    agree(encoder, plain, made(1, 4000))
    agree(encoder, plain, made(2, 2000))
    # Few keys, so that pieces clash and have to be told apart by their bytes.
    weak, calls = tokens.mix64, []

    def clashing(h):
        calls.append(1)
        return weak(h) & np.uint64(0xFFF) if len(calls) % 3 else weak(h)

    monkeypatch.setattr(tokens, "mix64", clashing)
    agree(tokens.Encoder(path), plain, made(3, 300))
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    agree(encoder, plain, made(4, 300))


def test_only_a_bytewise_tokenizer_gets_words_directly():
    assert tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json")).bytewise
    assert not tokens.Encoder(public_tokenizers.path("word_bpe_49k.json")).bytewise
