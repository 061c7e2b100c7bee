import random
from collections import Counter

from lexiquarry.plans.queries import QUERIES


def tables(spark, path, texts, vectors, passages=()):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(vectors)], "vec_id long, embedding array<double>").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def ids_of(texts, cap):
    words = [w for t in texts for w in t.split()]
    rank = {w: i for i, (w, _) in enumerate(sorted(Counter(words).items(), key=lambda x: (-x[1], x[0])))}
    return [min(rank[w], cap - 1) for w in words]


def test_containment_takes_all_ids(spark, tmp_path):
    rng = random.Random(8)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(90)], weights=[90 - i for i in range(90)], k=25)) for _ in range(50)] + ["always these three"] * 60 + ["rare pair here"] * 3
    for cap in (70, 200):
        ids = ids_of(texts, cap)
        wide = [*ids, cap - 1, cap - 1]
        score = Counter()
        for n in (1, 2, 3):
            for i in range(len(ids)):
                score[tuple(wide[i : i + n])] += 2.0 ** (n - 1)
        runs = lambda q: {q[i:j] for i in range(len(q)) for j in range(i + 1, len(q) + 1)} - {q}
        want = {(" ".join(map(str, q)), s) for q, s in score.items() if not any((-score[o], o) < (-s, q) for o in runs(q) if o in score)}
        got = [tuple(r) for r in QUERIES["containment_suppress"](spark, tables(spark, tmp_path / str(cap), texts, cap)).collect()]
        assert len(got) == len(want) and set(got) == want
        assert any(int(p.split()[0]) >= 40 for p, _ in got) and any(len(p.split()) == 3 for p, _ in got)


def test_pairs_and_triples_are_whole(spark, tmp_path):
    rng = random.Random(3)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(400)], weights=[400 - i for i in range(400)], k=600)) for _ in range(20)]
    passages = [" ".join(t.split()[5:8]) for t in texts[:20]] + ["w399 w398 w397"]
    cap = 350
    path = tables(spark, tmp_path, texts, cap, passages)
    ids = ids_of(texts, cap)
    wide = [*ids, cap - 1, cap - 1]
    pairs, triples = ({tuple(wide[i : i + n]) for i in range(len(ids))} for n in (2, 3))
    assert {tuple(r) for r in QUERIES["bigram_set"](spark, path).collect()} == pairs
    got = QUERIES["trigram_set"](spark, path).collect()
    assert {tuple(r)[:3] for r in got} == triples and len({r.idx for r in got}) == len(triples)
    rows = QUERIES["ngram_trichotomy"](spark, path).collect()
    for r in rows:
        t = (r.t0, r.t1, r.t2)
        assert r.pair_state == (0 if max(t[:2]) >= cap // 2 else 1 + (t[:2] in pairs))
        assert r.triple_state == (0 if sum(t) >= cap else 1 + (t in triples))
    assert len({r.pair_state for r in rows}) > 1 and len({r.triple_state for r in rows}) > 1
