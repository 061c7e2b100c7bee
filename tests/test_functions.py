import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiquarry.functions import columns as C
from lexiquarry.operators.soft import LADDER, Pattern, effective_threshold, reached_threshold, walk
from lexiquarry.operators.tokenizers import TOKENIZERS
from lexiquarry.plugins import Plugins
from lexiquarry.sources.vectors import EMBEDDINGS
from lexiquarry.timing import Stopwatches

from .plain_search import best_score


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_softmin_goldens(spark):
    lit = F.lit
    got = value(spark, F.array(C.softmin(lit(1.0), lit(0.7)), C.softmin(lit(0.8), lit(0.8)), C.softmin(lit(0.8), lit(0.6)), C.softmin(lit(0.9), lit(0.7), lit(0.6)), C.softmin_fold(F.array(lit(0.6), lit(0.9), lit(0.7))), C.softmin()))
    assert got == pytest.approx([0.7, 0.733706, 0.586407, 0.562621, 0.562621, 1.0], abs=1e-6)


def plain_softmin(*sims):
    return 1 - math.log(1 + sum(1e4 ** (1 - s) - 1 for s in sims), 1e4)


@given(st.lists(st.floats(0, 1), min_size=2, max_size=5))
def test_softmin_bounds_and_associativity(sims):
    whole = plain_softmin(*sims)
    assert whole <= min(sims) + 1e-9
    assert plain_softmin(plain_softmin(*sims[:-1]), sims[-1]) == pytest.approx(whole, abs=1e-9)


def test_vectors(spark):
    v = F.array(F.lit(3.0), F.lit(4.0))
    assert value(spark, C.l2_normalize(v)) == pytest.approx([0.6, 0.8])
    assert value(spark, C.similarity(v, F.array(F.lit(-1.0), F.lit(0.0)))) == 0
    assert value(spark, C.dot(v, v)) == 25
    assert value(spark, C.edit_multiplier(F.lit(2.0), 4.0)) == pytest.approx(math.exp(-0.5))


def test_trio_index_is_dense(spark):
    t = 6
    rows = [x for x in itertools.product(range(t), repeat=3) if sum(x) < t]
    got = [r.i for r in spark.createDataFrame(rows, "a int, b int, c int").select(C.trio_index("a", "b", "c", t).alias("i")).collect()]
    assert sorted(got) == list(range(t * (t + 1) * (t + 2) // 6))


def test_gram_keys_sort_like_ids(spark):
    rng = random.Random(1)
    rows = [tuple(rng.choice([0, 1, 255, 65536, 2**19]) for _ in range(3)) for _ in range(200)]
    got = spark.createDataFrame(rows, "a int, b int, c int").select("a", "b", "c", C.gram_key("a", "b", "c").alias("k"), C.gram_token(C.gram_key("a", "b", "c"), 1).alias("b2")).collect()
    assert [tuple(r)[:3] for r in sorted(got, key=lambda r: r.k)] == sorted(rows)
    assert all(r.b == r.b2 for r in got)


def test_runs_and_places(spark):
    arr = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<int>")
    assert value(spark, C.contains_run(arr(1, 2, 3, 4), arr(2, 3)))
    assert not value(spark, C.contains_run(arr(1, 2, 3), arr(1, 3)))
    assert not value(spark, C.contains_run(arr(1), arr(1, 1)))
    assert value(spark, C.contains_run(arr(1), arr()))
    assert value(spark, C.sorted_place(arr(2, 5, 5), F.lit(5))) == 1 and value(spark, C.sorted_place(arr(2), F.lit(3))) == -1
    df = spark.createDataFrame([("héllo", "llo"), ("abc", "x")], "t string, p string")
    assert [r.x for r in df.select(C.byte_find("t", "p").alias("x")).collect()] == [3, -1]
    assert C.format_eta(61) == "01:01" and C.format_eta(3661) == "1:01:01"


def test_plugins_and_timers():
    some = Plugins("test kind")
    some.add("a", item=1)
    some.add("b", "c")(2)
    with pytest.raises(LookupError, match="there already"):
        some.add("a", item=2)
    with pytest.raises(LookupError, match="unknown test kind 'd'"):
        some["d"]
    assert some == {"a": 1, "b": 2, "c": 2}
    import lexiquarry.operators.tokenizers as TK

    assert {"fasttext", "gensim", "llama", "transformers"} <= set(TOKENIZERS) and {"fasttext", "gensim", "llama", "transformers"} <= set(EMBEDDINGS)
    assert TK.fasttext_tokenizer("fasttext-el-vectors") is TK.MOSES and TK.fasttext_tokenizer("fasttext-ja-vectors") is TK.CHARACTERS and TK.fasttext_tokenizer("fasttext-fr-vectors") is TK.WORDS
    with pytest.raises(ValueError):
        TK.fasttext_tokenizer("other")
    assert TOKENIZERS["llama"]("m.json") == TK.SubwordTokenizer("m.json") == TK.tokenizer_of({"path": "m.json", "lower": False})
    t = Stopwatches()
    with t["x"]:
        pass
    assert t["x"].calls == 1 and set(t.report()) == {"x"}


def test_levels():
    assert len(LADDER) == 43 and LADDER[-1] == 0.20
    assert [effective_threshold(x) for x in (0.65, 0.45, 0.1, 0.995)] == [0.70, 0.45, 0.20, 0.99]
    assert reached_threshold([1.0, 0.75, 0.5], 2, 0.45) == 0.70 and reached_threshold([1.0], 2, 0.45) == 0.45


def test_best_score_by_enumeration():
    rng = random.Random(3)
    for _ in range(150):
        m, n = rng.randrange(1, 4), rng.randrange(1, 6)
        sims = [{w: round(rng.random(), 2) for w in range(4) if rng.random() < 0.6} for _ in range(m)]
        insert, delete = {w: round(rng.random(), 2) for w in range(4) if rng.random() < 0.6}, [round(rng.random(), 2) for _ in range(m)]
        seq = [rng.randrange(4) for _ in range(n)]

        def go(i, j, gap, picked, mult):
            if i == m:
                return plain_softmin(*picked) * mult if j == n else 0.0
            best = go(i + 1, j, 0, picked, mult * delete[i])
            if j < n and seq[j] in sims[i]:
                best = max(best, go(i + 1, j + 1, 0, [*picked, sims[i][seq[j]]], mult))
            if 0 < j < n and gap < 3 and seq[j] in insert:
                best = max(best, go(i, j + 1, gap + 1, picked, mult * insert[seq[j]]))
            return best

        want = go(0, 0, 0, [], 1.0)
        got = best_score(seq, sims, insert, delete, 0.05)
        assert got == pytest.approx(want if want >= 0.05 else 0.0, abs=1e-9)


def test_walk_scores_all_prefixes():
    rng = random.Random(4)
    for _ in range(60):
        m = rng.randrange(1, 4)
        sims = [{w: round(rng.random(), 2) for w in range(5) if rng.random() < 0.6} for _ in range(m)]
        insert, delete = {w: round(rng.random(), 2) for w in range(5) if rng.random() < 0.6}, [round(rng.random(), 2) for _ in range(m)]
        rows = [[rng.randrange(5) for _ in range(12)] for _ in range(40)]
        level = rng.choice([0.05, 0.3, 0.6])
        p = Pattern(sims, insert, delete, level)
        got = {tuple(h): (c, x) for heads, cs, xs in walk(p, np.array(rows), np.arange(1, 41)) for h, c, x in zip(heads.tolist(), cs.tolist(), xs.tolist())}
        want: dict = {}
        for i, r in enumerate(rows):
            for n in range(1, p.length + 1):
                want[tuple(r[:n])] = want.get(tuple(r[:n]), 0) + i + 1
        want = {s: (n, round(best_score(list(s), sims, insert, delete, level), 9)) for s, n in want.items()}
        want = {s: x for s, x in want.items() if x[1] > 0}
        assert got.keys() == want.keys()
        assert all(got[s][0] == n and got[s][1] == pytest.approx(x, abs=2e-9) for s, (n, x) in want.items())
        assert {s[0] for s in got} <= p.firsts
