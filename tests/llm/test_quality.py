import random
import zlib

import numpy as np
import pyarrow as pa

from lexiquarry.llm import quality
from lexiquarry.llm.wordbytes import slices

SCHEMA = "doc_id long, text string, score string, held_out int"


def corpus(n=400):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        w = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 7))) for _ in range(60)]
        good = rng.random() < 0.7
        docs.append((i, " ".join(w) if good else " ".join(x.upper() + "!!" for x in w), None, None))
        labels.append((i, int(good), "x"))
    return docs, labels


def test_held_out_and_edges(spark):
    docs, labels = corpus()
    odd = [(900, None, None, None), (901, "", None, None), (902, " \n", "s", 1), (903, "ABC!! " * 40_000, None, None), (None, "abc def", None, None), (0, docs[0][1], None, None)]
    d = spark.createDataFrame(docs + odd, SCHEMA)
    lab = spark.createDataFrame(labels + [(900, 1, "x"), (None, 1, "y"), (5, None, "z"), (3, 7, "q"), (4, labels[4][1], "dup")], "doc_id long, quality int, text string")
    model = quality.fit(d, lab)
    got = {r.doc_id: r for r in quality.score(d, model).collect()}
    assert len(got) == len(docs) + 5
    right = [got[i].predicted == good for i, good, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(right) > 50 and np.mean(right) > 0.97
    assert all(r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert got[900].score == got[901].score and got[903].predicted == 0
    kept = quality.score(d, model, keep=True)
    assert kept.columns == d.columns and kept.count() == sum(r.predicted for r in quality.score(d, model).collect())


def test_nothing_to_learn(spark):
    d = spark.createDataFrame([(1, "abc", None, None)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score(d, quality.fit(d, none)).first().score == 0.5
    assert quality.score(d.limit(0), quality.fit(d.limit(0), none)).collect() == []


def test_scores_of_slices_equal_single_texts():
    rng = np.random.default_rng(0)
    model = quality.QualityModel(rng.standard_normal(1 << quality.BITS).astype(np.float32), 0.1)
    texts = ["a b  c", "", "word", "é ü x x x", None, " lead", "tail \n", "abc" * 50]
    one = [model.scores(b, o)[0] for t in texts for _, b, o in slices(pa.array([t], pa.string()))]
    many = np.concatenate([model.scores(b, o) for _, b, o in slices(pa.array(texts))])
    assert np.allclose(one, many)


M64, M32 = (1 << 64) - 1, (1 << 32) - 1


def finish(x):
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = ((x ^ (x >> shift)) * by) & M64
    return x


def plain_bag(text):
    """Buckets of words, word pairs and character n-grams, one by one."""
    out, top = [], 64 - quality.BITS
    b = text.encode()
    white = (32, 9, 10, 11, 12, 13)
    w, word = [], []
    for c in [*b, 32]:
        if c in white:
            if word:
                w.append(finish((sum((x + 1) * pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i, x in enumerate(word)) + len(word)) & M64))
            word = []
        else:
            word.append(c)
    out += [x >> top for x in w]
    out += [0 if x == y else finish((x * 3 + y) & M64) >> top for x, y in zip(w, w[1:])]
    for n in (2, 3, 4):
        for i in range(len(b) - n + 1):
            gram = [32 if c in white else c for c in b[i : i + n]]
            if 32 in gram[1:-1] or gram == [32, 32]:
                continue
            h = n
            for c in gram:
                h = ((h + c) * 0x9E3779B1) & M32
                h ^= h >> 15
            out.append(h >> (32 - quality.BITS))
    return out


def test_features_and_scores_equal_a_plain_version():
    rng = np.random.default_rng(3)
    model = quality.QualityModel(rng.standard_normal(1 << quality.BITS).astype(np.float32), -0.3)
    texts = ["Two words two words", "", "  lead and  trail ", "ü 日本 x", "a a a b", "x", "tab\tand\nline\r\n", "12 34!! ??"]
    for t in texts:
        bag = plain_bag(t)
        got = [i for ids, lo, hi in quality.features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])) for i in ids[int(lo[0]) : int(hi[0])].tolist()]
        assert sorted(got) == sorted(bag), t
        want = 1 / (1 + np.exp(-(sum(float(model.weight[i]) for i in bag) / max(1, len(bag)) - 0.3)))
        assert abs(model.scores(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0] - want) < 1e-6


def test_training_follows_the_slope(monkeypatch):
    """The steps of train are those that differences of the loss give, for one small network."""
    monkeypatch.setattr(quality, "EPOCHS", 2)
    sample = [("1", "good words here"), ("0", "BAD!! BAD!!"), ("1", "other good ones"), ("0", "###")]
    got = quality.train(sample, 1.0)
    bags = [np.unique(plain_bag(t), return_counts=True) for _, t in sample]
    bags = [(u, c / c.sum()) for u, c in bags]
    y = [int(lab) for lab, _ in sample]
    rng = np.random.default_rng(quality.SEED)
    e = rng.uniform(-1 / quality.DIM, 1 / quality.DIM, (1 << quality.BITS, quality.DIM)).astype(np.float32).astype(float)
    out, bias = np.zeros((2, quality.DIM)), np.zeros(2)

    def loss(v, out, bias, label):
        z = out @ v + bias
        return np.log(np.exp(z - z.max()).sum()) + z.max() - z[label]

    def slope(f, x):
        g = np.zeros(x.size)
        for i in range(x.size):
            d = np.zeros(x.size)
            d[i] = 1e-5
            g[i] = (f(x + d.reshape(x.shape)) - f(x - d.reshape(x.shape))) / 2e-5
        return g.reshape(x.shape)

    for k in range(8):
        if k % 4 == 0:
            order = rng.permutation(4)
        i = int(order[k % 4])
        (u, c), label = bags[i], y[i]
        v, rate = c @ e[u], quality.RATE * (1 - k / 8)  # both classes weigh 1 here
        dv = slope(lambda x: loss(x, out, bias, label), v)
        dout, dbias = slope(lambda x: loss(v, x, bias, label), out), slope(lambda x: loss(v, out, x, label), bias)
        out, bias = out - rate * dout, bias - 0.1 * rate * dbias
        e[u] -= rate * min(len(u), 400) ** 0.5 * np.outer(c, dv)
    assert np.allclose(got.weight, e @ (out[1] - out[0]), atol=1e-4) and abs(got.bias - (bias[1] - bias[0])) < 1e-4
