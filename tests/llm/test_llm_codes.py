"""Ball k-means codes against k-means that compares every part with every entry."""

import hashlib

import numpy as np
import pytest

from refledger.llm import ball_codes


def brute(rows, parts=8, k=16, rounds=6):
    ok = [(i, [int(np.floor(4096 * float(np.float32(x)))) for x in e], label) for i, e, label in rows
          if e and all(x is not None and np.isfinite(x) for x in e)]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([r[1] for r in ok], np.int64).reshape(len(ok), parts, -1)
    book = x[:k].transpose(1, 0, 2).copy()
    for i in range(rounds + 1):
        d = ((x[:, :, None] - book[None]) ** 2).sum(-1)
        at, error = d.argmin(-1), d.min(-1).sum(-1)
        for p in range(parts if i < rounds else 0):
            for j in range(book.shape[1]):
                if (at[:, p] == j).any():
                    book[p, j] = x[at[:, p] == j, p].sum(0) // (at[:, p] == j).sum()
    sha = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    by = {}
    for r, e in zip(ok, error):
        by[r[2]] = by.get(r[2], 0) + int(e)
    return sorted([(r[0], "".join(f"{v:02x}" for v in a), int(e), by[r[2]], sha) for r, a, e in zip(ok, at, error)], key=repr)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").selectExpr(
        "*", "1 AS x", "'c' AS code", "2 AS error", "3 AS stats", "4 AS n", "5 AS sum")


def found(df):
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


@pytest.mark.parametrize("spread, n", [(0.05, 600), (0.5, 600), (0.0, 40), (0.3, 9)])
def test_equals_full_comparison(spark, spread, n):
    rng = np.random.default_rng(n)
    base = rng.normal(size=(7, 32))
    rows = [(int(i), [float(v) for v in base[i % 7] + spread * rng.normal(size=32)], int(i % 3) if i % 5 else None) for i in range(n)]
    rows += [(3, rows[3][1], 1), (None, rows[1][1], None), (n + 5, rows[2][1], 2)]
    assert found(ball_codes.compressed(spark, vectors(spark, rows).repartition(5))) == brute(rows)


def test_dropped_rows_ties_and_other_lengths(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 2)] * 8, 0) for i in range(6)]
    bad = [(9, None, 0), (10, [nan] * 8, 0), (11, [inf] + [0.0] * 7, 0), (12, [None] + [0.0] * 7, 1), (13, [], 1)]
    odd = [(20, [1.0] * 16, 5), (21, [1.0] * 3, 5)]
    got = found(ball_codes.compressed(spark, vectors(spark, good + bad + odd)))
    assert [r[:4] for r in got if r[0] >= 20] == [(20, None, None, None), (21, None, None, None)]
    assert sorted([r for r in got if r[0] < 20], key=repr) == brute(good)
    assert found(ball_codes.compressed(spark, vectors(spark, [(1, [1.0] * 7, 0)])))[0][:4] == (1, None, None, None)
    assert found(ball_codes.compressed(spark, vectors(spark, good + bad).filter("vec_id > 8"))) == []
    assert found(ball_codes.compressed(spark, vectors(spark, good).filter("false"))) == []


def test_too_large_component_is_an_error(spark):
    with pytest.raises(Exception, match="beyond"):
        ball_codes.compressed(spark, vectors(spark, [(1, [3e38] * 8, 0)])).collect()


def test_balls_skip_work_and_stay_exact():
    rng = np.random.default_rng(0)
    x = rng.integers(-4000, 4000, size=(5000, 4))
    book = rng.integers(-4000, 4000, size=(16, 4))
    book[5] = book[4]
    at, error = ball_codes.nearest(x, book)
    step = rng.integers(-60, 60, size=book.shape) * (np.arange(16) % 3 == 0)[:, None]
    far = np.array([error[at == i].max(initial=0) for i in range(16)])
    new = book + step
    step2 = (step ** 2).sum(1)
    balls = ball_codes.Balls(new, np.array([ball_codes.sum_root(int(a), int(b)) for a, b in zip(far, step2)]), step2 > 0)
    got_at, got_error = balls.reassigned(x, at, error)
    want_at, want_error = ball_codes.nearest(x, new)
    assert (got_at == want_at).all() and (got_error == want_error).all()
    still = ball_codes.Balls(book, far, np.zeros(16, bool))
    assert all(still.stable) and sum(map(len, balls.near)) < 16 * 15
