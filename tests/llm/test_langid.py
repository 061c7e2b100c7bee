import random
import zlib

import numpy as np
import pyarrow as pa

from lexiquarry.llm import langid
from lexiquarry.llm.wordbytes import slices

SCHEMA = "doc_id long, text string, lang string, letter string, score string"
SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ein", "ung", "ü"]}


def corpus(n=160):
    rng = random.Random(1)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        out.append((i, " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 5))) for _ in range(40)), lang, None, None))
    return out


def held(i, parts=3):
    return zlib.crc32(str(i).encode()) % parts


def test_held_out_accuracy_and_edges(spark):
    rows = corpus()
    odd = [(900, None, "aa", None, None), (901, "", None, None, None), (902, "123 ... !!", "bb", None, None), (903, "kalomitu " * 30_000, None, None, None), (None, "einung schein", "bb", None, None), (904, "ka" * 500, "aa", "x", "y"), (904, "ka" * 500, "aa", "x", "y")]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    got = {r.doc_id: r for r in langid.identify(df, langid.fit(df)).collect()}
    right = [got[i].lang_pred == lang for i, _, lang, *_ in rows if held(i) == 1]
    assert len(right) > 20 and np.mean(right) > 0.97
    assert all(got[i].held_out == (held(i) == 1) for i, *_ in rows)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[900].score == 0
    assert got[903].lang_pred == "aa" and got[None].lang_pred == "bb" and not got[None].held_out
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = langid.accepted(df, langid.fit(df))
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == set(got) - {900, 901, 902}


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", None, None, None)], SCHEMA)
    assert [r.lang_pred for r in langid.identify(df, langid.fit(df)).collect()] == ["und"]
    assert langid.identify(df.limit(0), langid.fit(df.limit(0))).collect() == []


def plain_gru(gru, xs):
    """One sequence, one unit of the state at a time."""
    k, out = gru.h, []
    h = [0.0] * k
    act = lambda x: x / (1 + abs(x))
    for b in xs:
        g = [sum(h[i] * float(gru.u[i, j]) for i in range(k)) for j in range(3 * k)]
        a = [float(v) for v in gru.w[b]]
        z = [(1 + act(a[j] + g[j])) / 2 for j in range(k)]
        r = [(1 + act(a[k + j] + g[k + j])) / 2 for j in range(k)]
        c = [act(a[2 * k + j] + r[j] * g[2 * k + j]) for j in range(k)]
        h = [h[j] + z[j] * (c[j] - h[j]) for j in range(k)]
        out.append(h)
    return out


def test_pooling_equals_brute_force():
    rng = np.random.default_rng(3)
    model = langid.LanguageModel(["a", "b", "c"], hidden=4)
    for p in (model.ahead.w, model.ahead.u, model.back.w, model.back.u, model.out):
        p += rng.standard_normal(p.shape).astype(np.float32)
    texts = ["kalo mi einung", "", "ÜBER " + "x" * 130 + " tu\n日本語" * 20, "mi", "a" * 96, "b" * 97, " \t\n", None]
    got = [p for _, b, o in slices(pa.array(texts, pa.string())) for p in model.documents(b, o)]
    assert len(got) == len(texts)
    for text, p in zip(texts, got):
        low = [c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()]
        want = []
        for at in range(0, len(low), langid.CORE):
            size = -(-min(langid.CORE, len(low) - at) // langid.STEP) * langid.STEP
            x = [low[i] if 0 <= i < len(low) else langid.EDGE for i in range(at - langid.CONTEXT, at + size + langid.CONTEXT)]
            ahead = plain_gru(model.ahead, x[: langid.CONTEXT + size])[langid.CONTEXT :]
            back = plain_gru(model.back, x[langid.CONTEXT :][::-1])[::-1][:size]
            for i in range(size):
                if at + i < len(low) and low[at + i] not in (32, 9, 10, 11, 12, 13):
                    z = np.array([*ahead[i], *back[i]]) @ model.out + model.bias
                    want.append(np.exp(z) / np.exp(z).sum())
        assert np.allclose(p, np.mean(want, axis=0) if want else 0, atol=1e-4)


def test_a_word_is_labelled_by_what_stands_around_it():
    """gem is a word of both languages: its neighbours tell, across spaces."""
    rng = random.Random(8)
    own = {"aa": ["oka", "olo", "omi"], "bb": ["usch", "uein", "ubun"]}
    text = lambda lang, n: " ".join("gem" if i % 2 else rng.choice(own[lang]) for i in range(n))
    model = langid.train([(lang, text(lang, 400)) for lang in own for _ in range(4)])
    share = {}
    for lang in own:
        t = text(lang, 31).encode()
        x = np.frombuffer(t[:96], np.uint8)[None]
        p = model.probabilities(x)[:, 0]
        at = [i + j for i in range(20, 70) if t[i : i + 3] == b"gem" for j in range(3)]
        share[lang] = p[at].mean(axis=0)
    assert share["aa"][0] > 0.9 and share["bb"][1] > 0.9


def test_mixed_languages_are_kept(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    model = langid.fit(df)
    mixed = spark.createDataFrame([(1, rows[0][1] + " " + next(r[1] for r in rows if r[2] != rows[0][2])[: len(rows[0][1]) // 2], None, None, None)], SCHEMA)
    assert langid.accepted(mixed, model).count() == 1


def test_sample_does_not_depend_on_order(spark):
    from lexiquarry.llm.samples import labelled_sample

    docs = [(i % 50, f"text {i}") for i in range(200)] + [(60, "z " * 100_000), (61, None), (None, "x")]
    labels = [(i % 50, str(i % 50 % 2)) for i in range(100)] + [(7, "0"), (60, "1"), (61, "1"), (None, "1"), (62, None)]
    got = []
    for seed in (1, 2):
        rng = random.Random(seed)
        rng.shuffle(docs), rng.shuffle(labels)
        d = spark.createDataFrame(docs, "id long, text string").repartition(seed + 2)
        got.append(labelled_sample(d, spark.createDataFrame(labels, "id long, label string").repartition(3), 1000, 2000))
    assert got[0] == got[1] and len(got[0]) == 50  # all but 7, which has two labels
    assert max(len(t) for _, t in got[0]) == 65_536


def test_gradients():
    model = langid.LanguageModel(["a", "b", "c"], hidden=3)
    rng = np.random.default_rng(0)
    x, y = rng.integers(97, 100, (4, 5)), np.array([0, 1, 2, 0])
    params = [model.ahead.w, model.ahead.u, model.back.w, model.back.u, model.out, model.bias]
    for i, p in enumerate(params):  # in double precision, to compare with differences
        params[i] = p.astype(np.float64)
    model.ahead.w, model.ahead.u, model.back.w, model.back.u, model.out, model.bias = params

    def loss():
        return -np.log(model.probabilities(x)[:, np.arange(4), y]).mean()

    for p, d in zip(params, model.step(x, y)):
        at = np.unravel_index(np.argmax(np.abs(d)), d.shape)
        keep = p[at]
        p[at] = keep + 1e-3
        up = loss()
        p[at] = keep - 1e-3
        slope = (up - loss()) / 2e-3
        p[at] = keep
        assert abs(slope - d[at]) < 1e-3 + 0.02 * abs(slope)
