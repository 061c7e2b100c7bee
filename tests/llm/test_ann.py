import numpy as np
import pytest

from lexiquarry.llm import ann

SCHEMA = "vec_id long, embedding array<float>, score string, bucket int"


def brute(rows, k, every):
    rows = [(i, v) for i, v, *_ in rows if i is not None and v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = np.array([np.float32(v).astype(float) for _, v in rows])
    out = {}
    for i, v in rows:
        if i % every == 0:
            s = np.zeros(len(x))
            for d in range(16):
                s += float(np.float32(v[d])) * x[:, d]
            out[i] = sorted([(-a, j) for a, (j, _) in zip(s, rows) if j != i])[:k]
    return out


def rows_of(n, seed=0, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, 16)) * 2
    return [(i, (centres[i % 12] + spread * rng.standard_normal(16)).tolist(), None, 1) for i in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_recall_scores_and_order(spark, monkeypatch, small):
    if small:  # many blocks, a bucket that is split, several query blocks
        monkeypatch.setattr(ann, "BLOCK", 64)
        monkeypatch.setattr(ann, "QUERY_BLOCK", 8)
    rows = rows_of(1500)
    rows += [(5000 + i, rows[0][1], None, 1) for i in range(300)]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, SCHEMA), 10, 20).collect():
        got.setdefault(r.query_id, []).append(r)
    want = brute(rows, 10, 20)
    assert set(got) == set(want)
    hits = 0
    score = {i: np.float32(v).astype(float) for i, v, *_ in rows}
    for q, found in got.items():
        found.sort(key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, 11))
        keys = [(-r.score, r.vec_id) for r in found]
        assert keys == sorted(keys) and q not in {r.vec_id for r in found}
        assert all(abs(r.score - score[q] @ score[r.vec_id]) < 1e-9 for r in found)
        hits += len({r.vec_id for r in found} & {j for _, j in want[q]})
    assert hits >= 0.9 * 10 * len(want)
    assert [r.vec_id for r in got[0]] == [j for _, j in want[0]]  # equal vectors: smaller ids first


def test_edges(spark):
    odd = [(20, None, None, 1), (40, [0.0] * 16, None, 1), (60, [float("nan")] + [1.0] * 15, None, 1), (80, [float("inf")] + [1.0] * 15, None, 1), (100, [None] + [1.0] * 15, None, 1), (120, [1.0], None, 1), (None, [1.0] * 16, None, 1), (140, [], None, 1)]
    rows = rows_of(6) + odd
    got = ann.nearest(spark.createDataFrame(rows, SCHEMA), 20, 20).collect()
    assert sorted((r.query_id, r.vec_id) for r in got) == [(0, i) for i in range(1, 6)]
    assert ann.nearest(spark.createDataFrame([], SCHEMA)).collect() == []
    assert ann.nearest(spark.createDataFrame(odd, SCHEMA)).collect() == []
    assert ann.nearest(spark.createDataFrame([(0, [1.0, 2.0], None, 1)], SCHEMA)).collect() == []
    twice = ann.nearest(spark.createDataFrame([(0, [1.0, 2.0], None, 1), (0, [1.0, 2.0], None, 1), (1, [3.0, 1.0], None, 1), (1, [3.0, 1.0], None, 1)], SCHEMA)).collect()
    assert [tuple(r) for r in twice] == [(0, 1, 1, 5.0)]


def test_visits_in_order_of_success():
    rng = np.random.default_rng(5)
    for target in (0.2, 0.7, 0.95):
        left, right = (np.log(rng.dirichlet(np.ones(n) * 0.4) + 1e-9) for n in (16, 32))
        floor = ann.probes(left, right, target)
        each = np.sort((left[:, None] + right[None]).ravel())[::-1]
        want = int(np.searchsorted(np.cumsum(np.exp(each)), target - 1e-7)) + 1
        assert abs(int((each >= floor).sum()) - want) <= 1


def test_success_is_the_share_of_neighbours():
    """Vectors at one angle to the query lie in buckets about as often as estimated."""
    rng = np.random.default_rng(6)
    h = ann.Hashes(64, 1.0, 6, rng.standard_normal((500, 64)) / 8)
    q = rng.standard_normal((1, 64))
    q /= np.linalg.norm(q)
    side = rng.standard_normal((40_000, 64))
    side -= (side @ q.T) * q
    near = 0.6 * q + 0.8 * side / np.linalg.norm(side, axis=1, keepdims=True)
    left, right = h.success(h.aimed(q), 0, 0.6)
    told = np.exp(left[0][:, None] + right[0][None])
    a, b = h.codes(h.lifted(near), 0)
    got = np.bincount(a * 8 + b, minlength=64).reshape(8, 8) / len(near)
    assert abs(told.sum() - 1) < 1e-9 and np.abs(told - got).max() < 0.04 and np.corrcoef(told.ravel(), got.ravel())[0, 1] > 0.97


def test_visited_share_falls_as_the_table_grows(spark):
    share = []
    for n in (2000, 16_000):
        rng = np.random.default_rng(1)
        centres = rng.standard_normal((n // 40, 16)) * 2
        vectors = centres[np.arange(n) % len(centres)] + 0.3 * rng.standard_normal((n, 16))
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
        rows = [(i, v.tolist(), None, 1) for i, v in enumerate(vectors)]
        found, visits = ann.search(spark.createDataFrame(rows, SCHEMA), 10, 100)
        got, want = {}, brute(rows, 10, 100)
        for r in found.collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        recall = np.mean([len(got[q] & {j for _, j in w}) / 10 for q, w in want.items()])
        assert recall >= 0.9
        share.append(visits.share)
    assert share[1] < 0.6 * share[0] and share[1] < 0.15
