import random
import re

from lexiquarry.llm.graph import components
from lexiquarry.llm.jaccard import jaccard_components

SCHEMA = "doc_id long, text string, component_id string, node string"


def brute(data, k, num, den):
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())

    sets = [(i, grams(t)) for i, t in data]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and den * len(a & b) >= num * len(a | b):
                up[root(x)] = root(y)
    low = {}
    for x in range(len(sets)):
        low[root(x)] = min(low.get(root(x), 1 << 60), sets[x][0])
    return sorted((i, len(s), low[root(x)]) for x, (i, s) in enumerate(sets))


def check(spark, data, k, num, den):
    got = jaccard_components(spark.createDataFrame([(i, t, "x", None) for i, t in data], SCHEMA), k, num, den).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(data, k, num, den)


def family(rng, size, edits, length=60):
    vocab = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocab) for _ in range(length)]
    out = []
    for _ in range(size):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            at = rng.randrange(len(w))
            kind = rng.randrange(3)
            w[at : at + 1] = [] if kind == 0 else [rng.choice(vocab)] if kind == 1 else [w[at], rng.choice(vocab)]
        out.append(" ".join(w))
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    texts = [t for n in (40, 25, 12, 3) for t in family(rng, n, 5)] + family(rng, 30, 2, 9) + family(rng, 30, 1, 4)
    texts += ["", None, "  \n", "one", "One two", "one two", "ONE\ttwo three", "é É", "É é"]
    line = " ".join(f"shared{i}" for i in range(12))
    texts += [line + " " + t for t in family(rng, 30, 60)]
    rng.shuffle(texts)
    data = list(enumerate(texts))
    check(spark, data, 3, 90, 100)
    check(spark, data, 5, 80, 100)


def test_edge_cases(spark):
    check(spark, [], 3, 90, 100)
    check(spark, [(4, None), (5, "")], 3, 90, 100)
    long = " ".join(f"q{i}" for i in range(30_000))
    check(spark, [(3, long), (2, long + " tail"), (9, "a b c"), (8, "a b c"), (8, "a b c")], 3, 90, 100)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95)], "a long, b long")
    got = {r.v: r.c for r in components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 90, 90: 90, 95: 90}
