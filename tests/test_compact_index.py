"""A compact index holds what the whole one does, on a fraction of the disk."""

import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from lexiquarry.operators import coded as CD
from lexiquarry.operators import kwic as K
from lexiquarry.operators.tokenizers import LETTERS
from lexiquarry.plans import queries as Q
from lexiquarry.plans.index import Index, PhraseTooLong, Staged, UnknownWord

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["w0", "w1", "w2", "w3", "w4", "w5", "zz"]) for _ in range(rng.choice([0, 1, 2, 5, 40]))) for _ in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(200, None), (201, "w0 w1"), (202, "")], "doc_id long, text string").repartition(5)
    docs = docs.fillna("")
    vectors = spark.createDataFrame([(i, [float(x) for x in np.random.default_rng(i).standard_normal(5) + 1]) for i in range(8)], "vec_id long, embedding array<double>")
    path = str(tmp_path_factory.mktemp("both"))
    return Index.build(spark, docs, vectors, f"{path}/a", LETTERS), Index.build(spark, docs, vectors, f"{path}/b", LETTERS, compact=True)


def bag(df):
    return Counter(map(tuple, df.collect()))


def test_tables(both):
    whole, compact = both
    for name in ("vocab", "stream", "starts", "windows", "grams"):
        assert bag(getattr(compact, name).select(getattr(whole, name).columns)) == bag(getattr(whole, name)), name
    norms = [dict(x.norms.select("tok", "norm").collect()) for x in both]
    assert norms[0] == pytest.approx(norms[1])
    assert compact.report() == whole.report()
    ids = [[0, 2], [1]]
    assert bag(compact.windows_of(ids)) == Counter({r: n for r, n in bag(compact.windows).items() if r[1] in ids[0] and r[2] in ids[1]})


def test_searches(both):
    whole, compact = both
    for index in (compact, compact.cached()):
        for p in ("w0", "w0 w1", "w2 w1 w0 w3", "w0 w1 w2 w3 w4 w0"):
            assert index.count(p).collect() == whole.count(p).collect()
            assert [tuple(r) for r in index.contexts(p, 10, 30).collect()] == [tuple(r) for r in whole.contexts(p, 10, 30).collect()] if whole.count(p).first()[0] else True
        for k in (3, 200, None):
            assert sorted(map(tuple, index.search("w0 w1", k, 0.3).collect())) == sorted(map(tuple, whole.search("w0 w1", k, 0.3).collect()))
        batch = [(1, "w0 w1"), (2, "w3"), (3, "none")]
        assert bag(index.search_batch(batch, 20, 0.3)) == bag(whole.search_batch(batch, 20, 0.3))


def test_parts_small_batches(spark, both, monkeypatch):
    """Parts that end within a document's next tokens, empty parts, and ids that come twice."""
    rows = [(0, 5, [1, 2]), (1, 5, [3]), (2, None, [7]), (3, 6, []), (4, 9, list(range(20))), (5, 7, [4])]
    table = spark.createDataFrame(rows, "row long, doc_id long, toks array<int>")
    coded = CD.ordered(table).cache()
    placed = CD.placed(coded, CD.parts(coded, 99))
    want = [7, 1, 2, 3, 4, *range(20)]
    assert [r.tok for r in CD.stream(placed).orderBy("pos").collect()] == want
    padded = want + [98] * 11
    assert {tuple(r)[0]: tuple(r)[1:] for r in CD.windows(placed).collect()} == {i: tuple(padded[i : i + 12]) for i in range(len(want))}
    assert bag(CD.triples(placed)) == Counter({(*t, n): 1 for t, n in Counter(tuple(padded[i : i + 3]) for i in range(len(want))).items()})


def test_queries_index_is_small(spark):
    """The index behind the registered queries took some eight times the documents' bytes."""
    index = Q._index(spark, SF)
    files = {Path(f.removeprefix("file://")) for t in (index.coded, index.starts, index.vocab) for f in t.inputFiles()}
    assert sum(f.stat().st_size for f in files) < 2 * Path(f"{SF}/documents.parquet").stat().st_size


def test_prefix_queries_read_triples(spark):
    """prefix_exists and prefix_missing ask the triples, not all windows with their twelve ids."""
    for f in (Q.prefix_exists, Q.prefix_missing):
        plan = f(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "t2#" in plan and "t11#" not in plan


def test_packed_triples(spark, monkeypatch):
    """Packs give back what they got in few bytes; ranges are disjoint, sorted and whole, however small."""
    rng = np.random.default_rng(5)
    keys, n = np.unique(rng.integers(0, 1 << 40, 50_000)), rng.integers(1, 3, 50_000)
    pack = CD.pack(keys, n[: len(keys)])
    assert len(pack) < 6 * len(keys)
    back = CD.unpack(pack, len(keys))
    assert (back[0] == keys).all() and (back[1] == n[: len(keys)]).all()
    top = np.array([0, 1, (1 << 63) - 1])
    assert CD.unpack(CD.pack(top, top), 3)[0].tolist() == top.tolist()
    monkeypatch.setattr(CD, "RANGE", 64), monkeypatch.setattr(CD, "DRAWN", 16), monkeypatch.setattr(CD, "HELD", 50)
    docs = [(i, rng.integers(0, 9, int(rng.integers(0, 30))).tolist(), [8] * 11) for i in range(60)]
    rows = spark.createDataFrame(docs, "doc_id long, toks array<int>, ahead array<int>").repartition(4)
    want = Counter(tuple((t + a)[i : i + 3]) for _, t, a in docs for i in range(len(t)))
    got = CD.triples(rows)
    assert bag(got) == Counter({(*t, c): 1 for t, c in want.items()})
    parts = [p for p in got.rdd.map(tuple).glom().collect() if p]
    assert len(parts) > 3 and all(p == sorted(p) for p in parts)
    ends = sorted((p[0][:3], p[-1][:3]) for p in parts)
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))
    assert CD.triples(rows.limit(0)).collect() == []


def test_continuations_shuffle_no_triples(spark):
    """The one prefix goes to the triples, whatever Spark makes of their sizes."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        got = Q.continuations(spark, SF)
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
        index = Q._index(spark, SF)
        a, b = index.ids(["on", "the"])
        assert bag(got) == Counter(tuple(r) for r in index.starts.where(f"t0 = {a} and t1 = {b}").select("t0", "t1", "t2", "cnt").collect())
    finally:
        spark.conf.set(key, before)


@pytest.fixture
def fresh(spark, tmp_path, monkeypatch):
    """The registered queries' index, not yet built, and what of it is written."""
    monkeypatch.setattr(Q, "_BUILT", {})
    monkeypatch.setattr(Q, "scratch", lambda spark, name: f"{tmp_path}/{name}")
    return lambda: {p.name for p in tmp_path.glob("index/*")}


def test_edit_costs_reads_words_alone(spark, fresh):
    """Norms are made of words and counts: ids of the documents and their triples were written for them as well."""
    assert Q.edit_costs(spark, SF).count()
    assert Q.index_report(spark, SF).count() == 1
    assert fresh() == {"words", "vocab", "norms"}


@pytest.mark.parametrize("name", ["exact_count", "kwic_sample", "soft_search_match_only", "soft_search_topk"])
def test_questions_of_one_phrase_write_no_triples(spark, fresh, name):
    """The distinct triples took the most disk of all, and one phrase was all they were asked for."""
    rows = bag(getattr(Q, name)(spark, SF))
    assert rows and "starts" not in fresh() and "coded" in fresh()
    Q._index(spark, SF).starts.count()
    assert "starts" in fresh() and bag(getattr(Q, name)(spark, SF)) == rows


def test_staged(spark, both, tmp_path):
    """Tables that are written one by one are those of the index that is built at once."""
    whole, compact = both
    docs, vectors = compact.docs, spark.createDataFrame([(i, [float(x) for x in np.random.default_rng(i).standard_normal(5) + 1]) for i in range(8)], "vec_id long, embedding array<double>")
    staged = Staged(spark, docs, vectors, str(tmp_path), LETTERS)
    assert dict(staged.norms.select("tok", "norm").collect()) == pytest.approx(dict(whole.norms.select("tok", "norm").collect()))
    assert bag(staged.freq) == bag(whole.starts.groupBy("t0").sum("cnt"))
    assert staged.report() == whole.report()
    places = [[0, 2], [1, 7], [3, 4, 7]]
    got = bag(staged.triples_of(places).groupBy("t0", "t1", "t2").sum("cnt"))
    assert got == Counter({r: n for r, n in bag(whole.starts.select("t0", "t1", "t2", "cnt")).items() if all(r[i] in p for i, p in enumerate(places))})
    for p in ("w0", "w0 w1", "w2 w1 w0 w3", "w0 w1 w2 w3 w4 w0"):
        assert staged.count(p).collect() == whole.count(p).collect()
        assert staged.contexts(p, 10, 30).collect() == whole.contexts(p, 10, 30).collect() if whole.count(p).first()[0] else True
    for k in (3, 200):
        assert staged.search("w0 w1", k, 0.3).collect() == whole.search("w0 w1", k, 0.3).collect()
    with pytest.raises(UnknownWord):
        staged.count("none")
    with pytest.raises(PhraseTooLong):
        staged.ids(["w0"] * 13)
    assert not (tmp_path / "starts").exists()
    for name in ("vocab", "stream", "starts", "windows", "grams"):
        assert bag(getattr(staged, name).select(getattr(whole, name).columns)) == bag(getattr(whole, name)), name
    batch = [(1, "w0 w1"), (2, "w3"), (3, "none")]
    assert bag(staged.search_batch(batch, 20, 0.3)) == bag(whole.search_batch(batch, 20, 0.3))
    assert sorted(map(tuple, staged.search("w0 w1", None, 0.3).collect())) == sorted(map(tuple, whole.search("w0 w1", None, 0.3).collect()))


def test_contexts_move_no_documents(spark, fresh, monkeypatch):
    """kwic_sample put all ids by document in order and ranked all hits in a window: now the documents' ends alone are
    ordered, and the hits that share their next ids with a shown one are all that leaves the tasks."""
    given, ordered = [], CD.ordered
    monkeypatch.setattr(CD, "ordered", lambda rows: given.append(rows) or ordered(rows))
    want = [tuple(r) for r in Q.kwic_sample(spark, SF).collect()]
    assert len(want) == 10 and len(given) == 1 and fresh() == {"words", "vocab", "coded", "edges", "edges_parts"}
    assert given[0].selectExpr("max(size(toks))").first()[0] <= 2 * CD.AHEAD < Q._index(spark, SF).coded.selectExpr("max(size(toks))").first()[0]
    monkeypatch.setattr(K, "SORTED_AT_ONCE", 12)
    sent, read = [], K.at_ranks
    monkeypatch.setattr(K, "at_ranks", lambda found, *a: read(lambda p: sent.append(found(p)) or sent[-1], *a))
    assert [tuple(r) for r in Q.kwic_sample(spark, SF).collect()] == want
    assert len(sent) > 2 and not any(re.search("(?<!Broadcast)Exchange", df._jdf.queryExecution().executedPlan().toString()) for df in sent)


def test_ranks_of_equal_hits(spark, tmp_path, monkeypatch):
    """Copies of one text have equal windows, of which the document and the place decide."""
    texts = ["a b a b", "a b", "", "b a b c " * 4] * 4 + ["a b a " * 5] * 12 + ["c a"]
    docs = spark.createDataFrame([(7 * i % 79 - 9, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(6)], "vec_id long, embedding array<double>")
    staged = Staged(spark, docs, vectors, str(tmp_path), LETTERS)
    stream = [r.tok for r in staged.stream.orderBy("pos").collect()]
    wide, ids = [*stream, *[5] * 11], staged.ids(["a", "b"])
    hits = sorted((tuple(wide[i : i + 12]), i) for i in range(len(stream)) if wide[i : i + 2] == ids)
    want = [(i + 1, hits[r][1]) for i, r in enumerate(K.sampled_ranks(len(hits), 4))]
    monkeypatch.setattr(K, "SORTED_AT_ONCE", 3)
    assert [(r.n, r.pos) for r in staged.contexts("a b", 4, 30).collect()] == want
    assert K.sampled_positions(staged.windows_of, ids, 4, len(hits)) == want


def test_pieces_are_all_windows(spark, tmp_path):
    """Windows within documents and those that run into the next are all there, once, with the documents' own places."""
    rng = random.Random(4)
    lens = [0, 1, 2, 10, 11, 12, 13, 21, 22, 23, 24, 60] * 4
    rng.shuffle(lens)
    rows = [(i, 100 - i, [rng.randrange(9) for _ in range(n)]) for i, n in enumerate(lens)]
    table = spark.createDataFrame(rows, "row long, doc_id long, toks array<int>").repartition(3).cache()
    edges = CD.ordered(CD.folded(table)).cache()
    placed = CD.placed(edges, CD.parts(edges, 9))
    docs = sorted(rows, key=lambda r: r[1])
    wide = [t for _, _, toks in docs for t in toks] + [8] * 11
    starts = [sum(len(d[2]) for d in docs[:k]) for k in range(len(docs))]
    assert {r.row: r.start for r in placed.collect()} == {d[0]: s for d, s in zip(docs, starts)}
    want = Counter((i, *wide[s + i : s + i + 12], d[1], d[0]) for d, s in zip(docs, starts) for i in range(len(d[2])))
    assert bag(CD.windows(CD.pieces(table, placed, CD.AHEAD), (), ("doc_id", "row"))) == want
    triples = Counter(tuple(wide[i : i + 3]) for i in range(len(wide) - 11))
    assert bag(CD.triples(CD.pieces(table, placed, 2))) == Counter({(*t, n): 1 for t, n in triples.items()})
