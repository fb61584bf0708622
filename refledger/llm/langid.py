"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a word (ASCII-lower-cased, its preceding blank included) forwards and backwards, and
labels every position with log-probabilities of the languages.  A document's probabilities pool those of all its
positions.  The state starts anew at each word, so equal words have equal outputs: a batch of documents runs each
of its distinct words once and weighs it by its count.  Training is backpropagation through time in numpy on the
words of a bounded sample of labelled documents (``sample``, the smallest hashes); prediction covers whole texts.

Defined results: ``und`` with score 0 for a null text, one without letters, or where nothing could be learned; ties go to
the first language by code point; documents without lang or id are predicted like others; repeated rows are
separate rows; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refledger.functions.shipping import ship_by_value
from refledger.llm.common import arrow_map, crc32_text, hash_share, in_part, no_null_text, only, range_hashes, split_words

ship_by_value(__name__)

#: Bound of the training sample in documents, the longest run of bytes the network carries its state over.
SAMPLE, RUN = 3000, 24
LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Network:
    """Parameters of both directions (0 forwards, 1 backwards) and of the output layer."""
    langs: list[str]
    emb: np.ndarray   # (2, 256, 3H): byte -> gate inputs (update, reset, candidate)
    rec: np.ndarray   # (2, H, 3H)
    out: np.ndarray   # (2H + 1, languages)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def direction(emb: np.ndarray, rec: np.ndarray, codes: np.ndarray, mask: np.ndarray, keep: bool = False):
    """States of one direction over (time, words) byte codes; masked steps hand the state on."""
    steps, n = codes.shape
    hidden = rec.shape[0]
    h = np.zeros((n, hidden), np.float32)
    states = np.empty((steps, n, hidden), np.float32)
    tape = []
    for t in range(steps):
        x = emb[codes[t]]
        a = x[:, :2 * hidden] + h @ rec[:, :2 * hidden]
        gates = sigmoid(a)
        z, r = gates[:, :hidden], gates[:, hidden:]
        rh = r * h
        c = np.tanh(x[:, 2 * hidden:] + rh @ rec[:, 2 * hidden:])
        new = h + z * (c - h)
        m = mask[t][:, None]
        new = np.where(m, new, h)
        if keep:
            tape.append((h, z, r, rh, c))
        h = new
        states[t] = h
    return states, tape


def backward(emb, rec, codes, mask, tape, d_states):
    """Gradients of one direction by backpropagation through time."""
    hidden = rec.shape[0]
    d_emb, d_rec = np.zeros_like(emb), np.zeros_like(rec)
    d_h = np.zeros_like(d_states[0])
    for t in range(len(tape) - 1, -1, -1):
        h, z, r, rh, c = tape[t]
        m = mask[t][:, None]
        total = d_h + d_states[t]
        d_new = np.where(m, total, 0)
        d_prev = np.where(m, 0, total)
        d_c = d_new * z * (1 - c * c)
        d_z = d_new * (c - h) * z * (1 - z)
        d_prev = d_prev + d_new * (1 - z)
        d_rh = d_c @ rec[:, 2 * hidden:].T
        d_r = d_rh * h * r * (1 - r)
        d_prev += d_rh * r
        gates = np.concatenate([d_z, d_r], 1)
        d_prev += gates @ rec[:, :2 * hidden].T
        d_rec[:, :2 * hidden] += h.T @ gates
        d_rec[:, 2 * hidden:] += rh.T @ d_c
        np.add.at(d_emb, codes[t], np.concatenate([gates, d_c], 1))
        d_h = d_prev
    return d_emb, d_rec


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(-1, keepdims=True)
    return x - np.log(np.exp(x).sum(-1, keepdims=True))


def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(time, words) codes and mask; both directions read the same layout, one of them reversed."""
    size = max(map(len, words))
    codes = np.zeros((size, len(words)), np.uint8)
    mask = np.zeros((size, len(words)), bool)
    for i, w in enumerate(words):
        codes[:len(w), i] = np.frombuffer(w, np.uint8)
        mask[:len(w), i] = True
    return codes, mask


def train(words: list[bytes], labels: np.ndarray, weights: np.ndarray, langs: list[str], hidden: int = 12,
          steps: int = 400, size: int = 384, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam on batches of words drawn by weight; every position of a word is a target."""
    rng = np.random.default_rng(seed)
    params = {
        "emb": rng.normal(0, 0.3, (2, 256, 3 * hidden)).astype(np.float32),
        "rec": rng.normal(0, 1 / np.sqrt(hidden), (2, hidden, 3 * hidden)).astype(np.float32),
        "out": rng.normal(0, 0.1, (2 * hidden + 1, len(langs))).astype(np.float32)}
    first, second = ({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2))
    chosen = rng.choice(len(words), size=(steps, size), p=weights / weights.sum())
    for step in range(steps):
        pick = chosen[step]
        codes, mask = padded([words[i] for i in pick])
        target = labels[pick]
        fw, fw_tape = direction(params["emb"][0], params["rec"][0], codes, mask, True)
        bw, bw_tape = direction(params["emb"][1], params["rec"][1], codes[::-1], mask[::-1], True)
        both = np.concatenate([fw, bw[::-1], np.ones((*mask.shape, 1), np.float32)], 2)
        d = np.exp(log_softmax(both @ params["out"]))
        d[:, np.arange(size), target] -= 1
        d *= mask[:, :, None] / mask.sum()
        d_both = d @ params["out"].T
        grads = {"out": np.einsum("tnh,tnl->hl", both, d)}
        pairs = [backward(params["emb"][0], params["rec"][0], codes, mask, fw_tape, d_both[:, :, :hidden]),
                 backward(params["emb"][1], params["rec"][1], codes[::-1], mask[::-1], bw_tape,
                          d_both[::-1, :, hidden:2 * hidden])]
        grads["emb"], grads["rec"] = (np.stack(g) for g in zip(*pairs))
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        pace = rate * min(1.0, 2 * (1 - step / steps) + 0.02)
        for k, g in grads.items():
            g = g / max(1.0, norm)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            params[k] -= pace * (first[k] / (1 - 0.9**(step + 1))) / (
                np.sqrt(second[k] / (1 - 0.999**(step + 1))) + 1e-8)
    return Network(langs, params["emb"], params["rec"], params["out"])


def word_scores(net: Network, words: list[bytes], lanes: int = 4096) -> np.ndarray:
    """Sum of the position log-probabilities of each word (words of one batch are near in length)."""
    out = np.zeros((len(words), len(net.langs)))
    order = np.argsort([len(w) for w in words], kind="stable")
    for lo in range(0, len(order), lanes):
        part = order[lo:lo + lanes]
        codes, mask = padded([words[i] for i in part])
        fw, _ = direction(net.emb[0], net.rec[0], codes, mask)
        bw, _ = direction(net.emb[1], net.rec[1], codes[::-1], mask[::-1])
        hidden = net.rec.shape[1]
        logits = fw @ net.out[:hidden] + bw[::-1] @ net.out[hidden:2 * hidden] + net.out[-1]
        out[part] = (log_softmax(logits) * mask[:, :, None]).sum(0)
    return out


def runs_of(data: np.ndarray, bounds: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words longer than ``RUN`` bytes in pieces of at most that, and the row of each piece."""
    rows = np.repeat(np.arange(len(counts)), counts)
    sizes = bounds[:, 1] - bounds[:, 0]
    n = -(-sizes // RUN)
    index = np.repeat(np.arange(len(bounds)), n)
    nth = np.arange(len(index)) - np.repeat(np.cumsum(n) - n, n)
    lo = bounds[index, 0] + nth * RUN
    return np.stack([lo, np.minimum(lo + RUN, bounds[index, 1])], 1), rows[index]


def distinct_runs(data: np.ndarray, bounds: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct pieces and, for each piece, the place of its equal."""
    _, at, same = np.unique(range_hashes(data, bounds), return_index=True, return_inverse=True)
    raw = data.tobytes()
    return [b" " + raw[a:b] for a, b in bounds[at]], same


def learn(docs: DataFrame, sample: int = SAMPLE, modulus: int = 4, remainder: int = 2, **options) -> Network | None:
    """Network from labelled documents outside the held-out part; None without any.

    The sample is the ``sample`` documents with the smallest hashes, taken whole; each language weighs the same.
    """
    rows = only(docs, "doc_id", "text", "lang").filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~in_part(F.col("doc_id"), modulus, remainder))
    # cut by hash first: the sort that bounds the sample sees little more than the sample
    near = rows.filter(hash_share(F.struct("doc_id", "text"), 1.2 * sample / max(1, rows.count())))
    taken = near.orderBy(F.xxhash64("doc_id", "text"), "doc_id", "lang", "text").limit(sample).select("text", "lang").toArrow()
    if not taken.num_rows:
        return None
    data, bounds, counts = split_words(no_null_text(taken["text"].combine_chunks()))
    if not len(bounds):
        return None
    langs = sorted(set(taken["lang"].to_pylist()), key=lambda s: s.encode())
    label = np.array([langs.index(x) for x in taken["lang"].to_pylist()])
    bounds, rows_of = runs_of(data, bounds, counts)
    words, same = distinct_runs(data, bounds)
    pairs, n = np.unique(same * len(langs) + label[rows_of], return_counts=True)
    of = pairs % len(langs)
    weight = np.sqrt(n) / np.bincount(of, np.sqrt(n), len(langs))[of]
    return train([words[i] for i in pairs // len(langs)], of, weight, langs, **options)


def identify(docs: DataFrame, net: Network | None, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(net)  # the parameters, of fixed size

    def predict(batch: pa.RecordBatch) -> pa.RecordBatch:
        net = sent.value
        ids = batch["doc_id"].to_pylist()
        lettered = [bool(t) and bool(LETTER.search(t)) for t in batch["text"].to_pylist()]
        best, score = ["und"] * len(ids), [0.0] * len(ids)
        data, bounds, counts = split_words(no_null_text(batch["text"]))
        if net is not None and len(bounds):
            bounds, rows_of = runs_of(data, bounds, counts)
            words, same = distinct_runs(data, bounds)
            sums = word_scores(net, words)
            sizes = np.array([len(w) for w in words])
            total = np.bincount(rows_of, sizes[same], len(ids))
            pooled = np.stack([np.bincount(rows_of, sums[same, k], len(ids)) for k in range(len(net.langs))], 1)
            # pooled per position, sharpened as if a document had up to 50 independent positions
            p = np.exp(log_softmax(pooled / np.maximum(total, 1)[:, None] * np.minimum(total, 50)[:, None]))
            top = p.argmax(1)
            for i, ok in enumerate(lettered):
                if ok:
                    best[i], score[i] = net.langs[top[i]], float(p[i, top[i]])
        held = [crc32_text(i) % modulus == remainder for i in ids]
        return pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(held, pa.bool_()), pa.array(best, pa.string()), pa.array(score, pa.float64())],
            names=["doc_id", "held_out", "lang_pred", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return arrow_map(only(docs, "doc_id", "text"), predict,
                     f"doc_id {kind}, held_out boolean, lang_pred string, score double")
