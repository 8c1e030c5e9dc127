"""Runs without a blank take memory in proportion to their length, and get the library's ids."""

import tracemalloc
from array import array

import numpy as np
import pytest

from peakloom.llm import pieces


@pytest.mark.parametrize("n", [20_000, 200_000])
def test_long_run_without_blanks(n):
    import sentencepiece

    path = pieces.public_pieces()
    text = "".join(np.random.default_rng(5).choice(list("abcdefghijklmnopqrstuvwxyz\t\n0123456789é中"), n))
    model = pieces.Model(path)
    tracemalloc.start()
    try:
        ids = model.encode([text, text[: n // 2] + "x"])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 40_000_000 + 1000 * n / 2
    assert array("i", ids[0]).tolist() == sentencepiece.SentencePieceProcessor(model_file=path).encode(text)
    assert model.decode(ids[0]) == text
