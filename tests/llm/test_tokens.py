"""Token counts of long texts: equal to whole encodings, with work in proportion to the text."""

from __future__ import annotations

import base64
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm.packing import ByteBpe
from quillspark.llm.token_counts import PieceCounter
from quillspark.llm.token_counts import tokenizer_path as path

MODEL = path("piece_bpe_32k.model")
r = random.Random(9)
N = 1 << 19
LONG = {
    "rare characters": lambda: "".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(N)),
    "frequent characters": lambda: "".join(r.choice("的一是不了人我在有他这中大来上国个到说们为子和你地出道也时年") for _ in range(N)),
    "kana with marks": lambda: "".join(r.choice(["か", "が", "が", "ハ", "パ", "ー"]) for _ in range(N)),
    "one letter": lambda: "a" * N,
    "base64": lambda: base64.b64encode(bytes(r.randrange(256) for _ in range(N * 3 // 4))).decode(),
    "lines": lambda: "\n".join("x" * 50 for _ in range(N // 51)),
    "prose": lambda: " ".join(r.choice("the quick brown fox jumped over lazy dogs".split()) for _ in range(N // 5)),
}


@pytest.mark.parametrize("name", LONG)
def test_long_texts_at_registered_settings(name):
    counter, text = PieceCounter(MODEL), LONG[name]()
    encoded, bounds = [0], counter._bounds

    def counted(text, start, end):
        encoded[0] += end - start
        return bounds(text, start, end)

    counter._bounds = counted
    assert counter.long_count(text) == len(counter.sp.encode(text))
    assert encoded[0] <= 4 * len(text)


PARTS = ["é", "e", "́", " ", "  ", "ﬁ", "㍿", "한", "ᄀ", "ᅡ", "か", "゙", "​", "x", "th", "ing", "\n", "\t", "😀", "的", "一", "A", "▁", "1", "ab", "ͅ", "ſ", "İ"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=150))
def test_short_chunks(parts):
    counter = PieceCounter(MODEL, 40, 5)
    text = "".join(parts)
    assert counter.counts([text]) == [len(counter.sp.encode(text))]


@pytest.mark.parametrize("n", [(1 << 20) - 1, 1 << 20])
def test_ids_on_both_sides_of_the_encoders(n):
    b = ByteBpe(path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"))
    text = ("Große words, 123 numbers\n\tand  spaces; 漢字 😀 " * (n // 40 + 1))[:n]
    assert len(text) == n and b.ids(text) == b.slow.encode(text, add_special_tokens=False).ids
