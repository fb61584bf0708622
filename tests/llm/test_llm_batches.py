"""What a task holds at once is bounded by bytes: rows handed to Python, weights of the classifier, pieces of the tokenizer."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from refledger.llm import quality, token_file
from refledger.llm.common import BATCH_BYTES, arrow_map


def test_python_gets_few_bytes_at_once(spark):
    docs = spark.range(0, 6000, 1, 1).select("id", F.repeat(F.lit("word "), 1000).alias("text"))  # 30 MB in one partition

    def sizes(batch):
        # a slice of a larger batch keeps the batch's buffers
        return pa.RecordBatch.from_arrays([pa.array([batch["text"].get_total_buffer_size()]), pa.array([batch.num_rows])], names=["size", "n"])

    got = arrow_map(docs, sizes, "size long, n long").collect()
    assert sum(r.n for r in got) == 6000
    assert max(r["size"] for r in got) < 3 * BATCH_BYTES


@pytest.mark.parametrize("used", [0, 1, 40])
def test_weights_by_place_are_the_weights(used):
    rng = np.random.default_rng(used)
    weights = np.zeros((100, 2), np.float32)
    weights[rng.permutation(100)[:used]] = rng.normal(size=(used, 2))
    places = np.flatnonzero(weights.any(1))
    for wanted in (rng.integers(0, 100, (30, 4)), np.arange(100), np.zeros((0, 4), np.int64)):
        got = quality.weights_at(places, weights[places], wanted)
        assert got.dtype == weights.dtype and np.array_equal(got, weights[wanted])


def test_the_tokenizer_remembers_no_more_than_it_may(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["often " * 5 + f"once{i} other{i}" for i in range(200)] + ["often naïve often", "", None]
    want = [token_file.Tokens(path).tokenizer.encode(t or "", add_special_tokens=False).ids + [token_file.END] for t in texts]
    for most in (200_000, 1, 0):
        monkeypatch.setattr(token_file, "REMEMBER", most)
        tokens = token_file.Tokens(path)
        for _ in range(2):
            ids, n = tokens.batch(pa.array(texts))
            assert ids.tolist() == sum(want, []) and n.tolist() == list(map(len, want))
            assert len(tokens.known) <= most
        assert most < 2 or " often" in tokens.known
