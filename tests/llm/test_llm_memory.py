"""The classifier turns few bytes of text into arrays at once, with the same measures and features."""

import random

import numpy as np
import pyarrow as pa

from refledger.llm import quality


def test_a_batch_read_in_parts_is_the_same(monkeypatch):
    rng = random.Random(4)
    texts = [None if i % 17 == 3 else "" if i % 13 == 5 else " ".join(rng.choice(["Tree", "tree,", "of", "LIFE!", "<b>", "--", "9", "naïve"])
             for _ in range(rng.randint(1, 60))) for i in range(300)]
    column = pa.array(texts)
    sizes, one = [], quality.read_part

    def noted(part, before):
        sizes.append(part.nbytes)
        return one(part, before)

    monkeypatch.setattr(quality, "read_part", noted)
    monkeypatch.setattr(quality, "AT_ONCE", 1 << 40)
    whole = quality.read(column)
    assert len(sizes) == 1
    for most in (3000, 200):
        sizes.clear()
        monkeypatch.setattr(quality, "AT_ONCE", most)
        parts = quality.read(column)
        assert len(sizes) > 5
        for name in ("n_words", "measures", "word_hash", "stems", "pair_row", "pair_word"):
            assert np.array_equal(getattr(whole, name), getattr(parts, name)), name
    assert quality.read(pa.array([], pa.string())).measures.shape == (0, len(quality.MEASURES))
