import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiquarry import cli
from lexiquarry.operators import grams as G
from lexiquarry.operators import kwic as K
from lexiquarry.operators import ranges
from lexiquarry.operators import tokens as TK
from lexiquarry.operators import vectors as V
from lexiquarry.operators.pruning import skyline, suppress_containing
from lexiquarry.operators.soft import effective_threshold
from lexiquarry.operators.tokenizers import LETTERS, WORDS
from lexiquarry.plans.index import Index, PhraseTooLong, UnknownWord
from lexiquarry.sources.text import corpus
from lexiquarry.streaming.counts import token_frequency_stream

from .plain_search import best_score

WORD_LIST = [f"w{i}" for i in range(12)]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A corpus of few words, with vectors of which some are alike, as an index on disk."""
    rng = random.Random(4)
    texts = [" ".join(rng.choices(WORD_LIST, weights=range(12, 0, -1), k=rng.randrange(0, 30))) for _ in range(60)]
    docs = corpus(spark.createDataFrame([(3 * i, t.replace(" ", "\n", 1) if i % 3 else t) for i, t in enumerate(texts)] + [(500, None)], "doc_id long, text string"))
    gen = np.random.default_rng(2)
    base = gen.standard_normal((14, 4))
    base[1] = base[0] + 0.3 * base[1]
    base[3] = base[2] + 0.4 * base[3]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<double>")
    path = f"{tmp_path_factory.mktemp('index')}/ix"
    index = Index.build(spark, docs, vectors, path, LETTERS)
    words = [w for t in texts for w in t.split()]
    return index, words, base, path, docs, vectors


def ids_of(index):
    return {r.token: r.tok for r in index.vocab.collect()}


def test_stream_and_windows(spark, small):
    index, words, *_ = small
    ids = ids_of(index)
    stream = [ids.get(w, index.cap - 1) for w in words]
    assert [r.tok for r in index.stream.orderBy("pos").collect()] == stream
    padded = stream + [index.cap - 1] * 11
    want = Counter(tuple(padded[i : i + 12]) for i in range(len(stream)))
    assert Counter({tuple(r)[:12]: r.cnt for r in index.grams.collect()}) == want
    ranks = {r["pos"]: r["rank"] for r in G.suffix_ranks(index.windows).collect()}
    order = sorted(range(len(stream)), key=lambda i: (padded[i : i + 12], i))
    assert ranks == {p: k for k, p in enumerate(order)}
    assert [r["rank"] for r in G.sparse_index(G.suffix_ranks(index.windows), 100).orderBy("rank").collect()] == list(range(0, len(stream), 100))


def test_windows_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(G, "BUCKET", 16)
    stream = spark.createDataFrame([(i, (i * i) % 7) for i in range(100)], "pos long, tok int")
    got = {r["pos"]: tuple(r)[1:] for r in G.windows(stream, 9).collect()}
    seq = [(i * i) % 7 for i in range(100)] + [8] * 11
    assert got == {i: tuple(seq[i : i + 12]) for i in range(100)}


def test_prefix_sums_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranges, "ROWS_PER_RANGE", 10)
    rng = random.Random(1)
    rows = [(k, rng.randrange(9)) for k in rng.sample(range(10_000), 400)]
    got = {r.k: r.s for r in ranges.with_prefix_sums(spark.createDataFrame(rows, "k long, v long"), "k", {"s": "v"}).collect()}
    acc, want = 0, {}
    for k, v in sorted(rows):
        want[k], acc = acc, acc + v
    assert got == want and len(ranges.split_points(spark.createDataFrame(rows, "k long, v long"), "k")) > 20


def test_exact_counts(spark, small):
    index, words, *_ = small
    ids = ids_of(index)
    for phrase in ("w0", "w0 w1", "w1 w0 w2"):
        p = phrase.split()
        want = sum(words[i : i + len(p)] == p for i in range(len(words)))
        assert index.count(phrase).first().match_count == want
    patterns = [(i, [ids[w] for w in rng]) for i, rng in enumerate((["w0"], ["w0", "w1"], ["w9", "w9", "w9", "w9"]))]
    got = {r.query_id: r.match_count for r in G.exact_counts(index.grams, spark.createDataFrame(patterns, "query_id long, ids array<int>")).collect()}
    rev = {v: k for k, v in ids.items()}
    assert got == {i: sum(words[j : j + len(p)] == [rev[x] for x in p] for j in range(len(words))) for i, p in patterns}


def test_guards(small):
    index = small[0]
    with pytest.raises(UnknownWord):
        index.count("w0 nothing")
    with pytest.raises(PhraseTooLong):
        index.count(" ".join(["w0"] * 13))


def context(data: bytes, lo: int, hi: int, padding: int):
    left = data[max(0, lo - padding) : lo].decode(errors="ignore")
    right = data[hi : hi + padding].decode(errors="ignore")
    a = left.rpartition("\n")[2].lstrip(" ")
    b = right.partition("\n")[0].rstrip(" ")
    if "\n" not in left and a and lo > padding:
        a = "..." + a
    if "\n" not in right and b and hi + padding < len(data):
        b += "..."
    return a, data[lo:hi].decode().replace("\n", " "), b


def test_contexts(spark):
    texts = ["über the cat sat on the mat", "and the\ncat ran", "", "the cat", "cat é the"]
    docs = corpus(spark.createDataFrame([(10 * i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "vec_id long, embedding array<double>")
    index = Index.plan(docs, vectors, WORDS)
    data = "\n".join(texts).encode()
    words, at = [], []
    import re

    for m in re.finditer(rb"[^\s]+", data):
        words.append(m[0].decode())
        at.append(m.start())
    for phrase, padding in (("the cat", 9), ("cat cat", 30), ("the", 5)):
        p = phrase.split()
        spots = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        got = index.contexts(phrase, 50, padding).collect()
        want = sorted(context(data, at[i], at[i + len(p) - 1] + len(p[-1]), padding) for i in spots)
        assert sorted((r.left, r["match"], r.right) for r in got) == want and [r.n for r in got] == list(range(1, len(spots) + 1))
    picks = K.sampled_ranks(715, 10)
    assert len(set(picks)) == 10 and picks[0] == K.START % 715 and K.sampled_ranks(0, 5) == []


def test_whitening(spark, small):
    index, words, base, *_ = small
    ids = ids_of(index)
    n = len(base)
    freq = np.zeros(n)
    for w in words:
        freq[ids.get(w, n - 1)] += 1
    p = freq / freq.sum()
    mu = p @ base
    cov = (base - mu).T @ np.diag(p) @ (base - mu)
    want = np.einsum("ij,jk,ik->i", base - mu, np.linalg.inv(cov), base - mu)
    got = {r.tok: r.norm for r in index.norms.collect()}
    for i in range(n):
        assert got[i] == (pytest.approx(want[i], rel=1e-6) if freq[i] else V.NEVER)
    raw = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<double>")
    none = V.whitened_norms(raw, spark.createDataFrame([], "tok int, freq long"))
    assert {r.norm for r in none.collect()} == {V.NEVER}


def brute(index, words, base, phrase, k, level):
    """Every sequence of the corpus, scored by the plain rules."""
    ids = ids_of(index)
    cap, floor, threshold = index.cap, max(0.2, level), effective_threshold(level)
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    pat = [ids[w] for w in phrase.split()]
    norm = {r.tok: r.norm for r in index.norms.collect()}
    sims = [{j: max(0.0, float(unit[i] @ unit[j])) for j in range(cap - 1) if unit[i] @ unit[j] >= floor} for i in pat]
    low = sorted(norm[j] for j in range(cap - 1))[:51]
    coef = low[next((i - 1 for i in range(1, min(50, len(low))) if low[i] >= 1e10), min(50, len(low) - 1))] * len(pat) / 5
    insert = {j: math.exp(-norm[j] / coef) for j in range(cap - 1) if math.exp(-norm[j] / coef) >= floor}
    delete = [math.exp(-norm[i] / coef) for i in pat]
    stream = [ids.get(w, cap - 1) for w in words]
    seqs = Counter(tuple(stream[i : i + n]) for n in range(1, 13) for i in range(len(stream) - n + 1))
    found = {s: round(best_score(list(s), sims, insert, delete, threshold), 9) for s in seqs}
    found = {s: x for s, x in found.items() if x >= threshold}
    inside = lambda a, b: any(a[i : i + len(b)] == b for i in range(len(a) - len(b) + 1))
    kept = [s for s in found if not any(t != s and inside(s, t) and (found[t], [-x for x in t]) > (found[s], [-x for x in s]) for t in found)]
    rev = {v: w for w, v in ids.items()}
    kept.sort(key=lambda s: (-found[s], s))
    return [(i + 1, found[s], seqs[s], " ".join(rev[t] for t in s)) for i, s in enumerate(kept[:k])]


@pytest.mark.parametrize("phrase, level", [("w0 w1", 0.45), ("w2 w0 w5", 0.30), ("w3", 0.2), ("w1 w2 w0 w4", 0.5)])
def test_soft_search(small, phrase, level):
    index, words, base, *_ = small
    got = [tuple(r) for r in index.search(phrase, 20, level).collect()]
    want = brute(index, words, base, phrase, 20, level)
    assert [g[0] for g in got] == [w[0] for w in want] and len(got) > 0
    assert sorted((round(g[1], 7), g[2], g[3]) for g in got) == sorted((round(w[1], 7), w[2], w[3]) for w in want)
    if index.count(phrase).first().match_count:
        assert got[0][1:] == (1.0, index.count(phrase).first().match_count, phrase)
    for _, _, n, text in got:
        assert index.count(text).first().match_count == n


def test_search_is_monotone_and_batched(small, monkeypatch):
    index = small[0]
    low, high = ({r.phrase for r in index.search("w0 w1", None, x).collect()} for x in (0.3, 0.6))
    from lexiquarry.operators import soft
    from lexiquarry.plans import index as plans

    plain = [tuple(r) for r in index.search("w0 w1", 20, 0.3).collect()]
    whole = sorted(map(tuple, index.search("w0 w1", None, 0.3).collect()))
    assert whole[:20] == plain and [r[0] for r in whole] == list(range(1, len(whole) + 1))
    assert [tuple(r) for r in Index.load(index.docs.sparkSession, small[3]).cached().search("w0 w1", 20, 0.3).collect()] == plain
    monkeypatch.setattr(plans, "DIRECT_ROWS", 0)  # triples first
    assert [tuple(r) for r in index.search("w0 w1", 20, 0.3).collect()] == plain
    monkeypatch.setattr(soft, "LITERALS", 0)  # joins instead of literals
    monkeypatch.setattr(soft, "ROWS", 50)
    monkeypatch.setattr(soft, "HELD", 5)
    monkeypatch.setattr(plans, "STEP_ROWS", 1)  # one level after the other
    monkeypatch.setattr(plans, "STEP", 1)
    assert [tuple(r) for r in index.search("w0 w1", 20, 0.3).collect()] == plain
    batch = index.search_batch([(1, "w0 w1"), (2, "unknown"), (3, "w3"), (4, "w2 w0 w5"), (5, " ".join(["w0"] * 13))], 20, 0.3).collect()
    for q, phrase in ((1, "w0 w1"), (3, "w3"), (4, "w2 w0 w5")):
        assert [(r.rank, r.score, r.match_count, r.phrase) for r in batch if r.query_id == q] == [tuple(r) for r in index.search(phrase, 20, 0.3).collect()]
    assert {r.query_id for r in batch} == {1, 3, 4} and low and high
    assert index.search_batch([]).collect() == [] and len(index.search("w0 w1", 20, 0.3, max_runtime=0.0).collect()) <= 20


def test_substitution_fixture(spark):
    """gold and silver at cosine 0.8, all else orthogonal; adjacency runs across lines."""
    lines = ["gold medal", "silver medal", "the gold medal , the silver medal", "gold olympic medal"]
    docs = corpus(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    rows = TK.token_rows(TK.document_tokens(docs, WORDS))
    vocab = {r.token: r.tok for r in TK.vocabulary(rows, 7).collect()}
    vec = {t: [float(i == k) for i in range(8)] for k, t in enumerate(sorted(vocab.values()))}
    g, s = vocab["gold"], vocab["silver"]
    vec[s] = [0.8 * a for a in vec[g]]
    vec[s][7] = 0.6
    vectors = spark.createDataFrame([(t, v) for t, v in vec.items()] + [(6, [0.0] * 8)], "vec_id long, embedding array<double>")
    index = Index.plan(docs, vectors, WORDS)
    from lexiquarry.operators import soft

    pattern = index.vectors.where(F.col("vec_id").isin(g, vocab["medal"])).select(F.when(F.col("vec_id") == g, 0).otherwise(1).alias("idx"), "embedding")
    found = soft.match_only(index.grams, V.similar_words(pattern, index.vectors, 0.45, index.cap), 2, 0.45)
    got = {r.phrase: (round(r.score, 4), r.match_count) for r in soft.render(found, index.vocab).collect()}
    assert got == {"gold medal": (1.0, 2), "silver medal": (0.8, 2)}


def test_skyline_and_containment(spark):
    df = spark.createDataFrame([("a", 1.0, 0.2), ("a", 0.5, 0.5), ("a", 0.5, 0.4), ("a", 0.5, 0.5), ("a", 0.1, 0.1), ("b", 0.3, 0.3)], "g string, sim double, mult double")
    assert sorted(map(tuple, skyline(df, "g").collect())) == [("a", 0.5, 0.5), ("a", 1.0, 0.2), ("b", 0.3, 0.3)]
    df = spark.createDataFrame([([1, 2, 3], 0.5), ([2, 3], 0.6), ([1, 2], 0.4), ([9], 0.9), ([2], 0.55)], "seq array<int>, score double")
    assert sorted(r.seq for r in suppress_containing(df).collect()) == [[2], [2, 3], [9]]


def test_insert_costs(spark):
    norms = spark.createDataFrame([(i, float(i + 1)) for i in range(100)], "tok int, norm double")
    coef, cut = V.coefficient(norms, 100, 5)
    assert (coef, cut) == (51.0, V.NO_CUT)
    assert V.insert_words(norms, 100, coef, cut, 0.5).count() == sum(math.exp(-(i + 1) / 51) >= 0.5 for i in range(99))
    assert V.norm_cut(norms, 100, rank=1) == V.NO_CUT and V.norm_cut(spark.range(6000).selectExpr("cast(id as int) tok", "cast(id as double) norm"), 6000, rank=4) == 116.0
    few = spark.createDataFrame([(0, 1.0), (1, 1e10), (2, 1e10)], "tok int, norm double")
    assert V.coefficient(few, 3, 5)[0] == 1.0


def test_reload_and_command_line(spark, small, capsys):
    index, words, _, path, *_ = small
    again = Index.load(spark, path)
    assert again.count("w0 w1").first() == index.count("w0 w1").first()
    assert Index.meta(spark, path)["tokens"] == len(words)
    assert cli.main(["search", "--index", path, "w0 w1"]) == 0
    out = capsys.readouterr().out
    assert "| Rank | Score" in out and "w0 w1" in out
    assert cli.main(["exact", "--index", path, "w0", "--display", "2"]) == 0
    assert "(only 2 are displayed)" in capsys.readouterr().out
    assert cli.main(["search", "--index", path, "none"]) == 1


def test_command_line_build(spark, small, tmp_path):
    _, words, _, _, _, vectors = small
    (tmp_path / "c.txt").write_text("\n".join(" ".join(words[i : i + 20]) for i in range(0, 400, 20)))
    vectors.write.parquet(f"{tmp_path}/v")
    assert cli.main(["index", f"file://{tmp_path}/c.txt", "--vectors", f"{tmp_path}/v", "--index", f"{tmp_path}/ix", "--tokenizer", "letters"]) == 0
    assert Index.load(spark, f"{tmp_path}/ix").count("w0").first().match_count == words[:400].count("w0")


def test_prefix_filter_is_pushed_down(small):
    index = small[0]
    plan = index.grams.where(G.prefix_is([0, 1]))._jdf.queryExecution().explainString(index.grams.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(t0,0)" in plan and "EqualTo(t1,1)" in plan


def test_stream_counts(spark, tmp_path):
    spark.createDataFrame([(1, "a b a"), (2, "b")], "doc_id long, text string").write.parquet(f"{tmp_path}/in")
    src = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in")
    q = token_frequency_stream(src, LETTERS).writeStream.outputMode("complete").format("memory").queryName("counts_test").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.token: r.freq for r in spark.table("counts_test").collect()} == {"a": 2, "b": 2}
