"""Texts that are split into runs at once get the ids that the tokenizer gives them."""

from __future__ import annotations

import random

from strikeplane.llm import packing
from strikeplane.llm.queries import tokenizer_path

ODD = ["don't", "x's", " ", "  ", "\n", "\t\r\n", "_", "a_b", "12", "1½", "é", "Ça", "naïve,", "\x1f", "\xa0", "\x85", "日本", "-->", "'", "''re", "<|endoftext|>", "²", "ß9", "\xad", "\x00", "ǅ", "x" * 90]


def test_ids_are_the_tokenizers():
    encoder, rng = packing.Encoder(tokenizer_path()), random.Random(1)
    for n in range(4000):
        text = "".join(rng.choice(ODD) + rng.choice(["", " ", "  ", "\n"]) for _ in range(n % 12))
        assert encoder.encode(text) == encoder.raw(text), repr(text)


def test_words_with_signs_share_one_entry():
    encoder = packing.Encoder(tokenizer_path())
    encoder.encode("one two, two. two; two")
    assert sum("two" in run for run in encoder.runs) == 1
