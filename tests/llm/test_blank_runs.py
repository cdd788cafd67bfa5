"""Runs of blanks and long units are merged as the library merges them, in n log n steps."""

import random
import time

import numpy as np
import pytest


@pytest.fixture(scope="module")
def both():
    import sentencepiece

    from tessera.llm import pieces as p

    return sentencepiece.SentencePieceProcessor(model_file=p.model_path()), p.Pieces(p.model_path())


def _ids(m, text):
    from tessera.llm import pieces as p

    return np.frombuffer(m.encode(p.normal(text, True)), "<u4").tolist()


@pytest.mark.parametrize("n", [2, 15, 16, 17, 63, 64, 65, 200, 4000, 4096, 4097, 5001, 10_007])
def test_blanks(both, n):
    sp, m = both
    for text in (" " * n, " " * n + "word", "a" + " " * n + "b\n" + " " * (n // 2) + "c"):
        assert _ids(m, text) == sp.encode(text)


def test_merges_are_the_same_by_either_way(both):
    _, m = both
    rng = random.Random(7)
    for _ in range(300):
        s = "".join(rng.choice("▁▁▁aeinrstho") for _ in range(rng.randint(1, 64)))
        assert m.merges(s) == m.merges_by_heap(s)


@pytest.mark.parametrize("text", [" " * 100_000 + "x", (" " * 500 + "x") * 200, "ab" * 50_000, "=" * 100_000])
def test_long_runs_take_no_square_of_time(both, text):
    began = time.time()
    _ids(both[1], text)
    assert time.time() - began < 5
