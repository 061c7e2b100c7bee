import math
import random
import re

import numpy as np

from lexiquarry.llm import decontam
from lexiquarry.llm.decontam import ItemIndex, clean, contaminated, in_order, indexes, item_words, split_item

DOCS = "doc_id long, text string, item_id string, score int"
ITEMS = "item_id long, text string"


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def setup(seed=1, n_items=30, n_docs=150):
    rng = random.Random(seed)
    common, rare = ["the", "of", "and", "is", "was", "ist", "ü"], [f"w{i}" for i in range(900)]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else rng.choice(rare)
    items = [(i, " ".join(word() for _ in range(rng.randrange(8, 40))).capitalize() + ".") for i in range(n_items)] + [(77, "Who was it really then? The w1 w2 w3"), (78, "w5 w6")]
    docs = []
    for d in range(n_docs):
        w = [word() for _ in range(rng.randrange(0, 400))]
        if rng.random() < 0.5:
            leak = rng.choice(items)[1].split()
            for _ in range(rng.randrange(6)):
                leak[rng.randrange(len(leak))] = word()
            at = rng.randrange(len(w) + 1)
            w[at:at] = leak
        docs.append((d, " ".join(w), None, None))
    return docs, items


def brute(docs, items):
    """Every run of twice the item's length, at every word of every text."""
    items = sorted({(i, t) for i, t in items if words_of(t)}, key=str)
    w = [words_of(t) for _, t in items]
    if not w:
        return {}
    mean, df = sum(map(len, w)) / len(w), {}
    for x in w:
        for t in set(x):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(1 + (len(w) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    gain = [{t: idf[t] * x.count(t) * 2.2 / (x.count(t) + 1.2 * (0.25 + 0.75 * len(x) / mean)) for t in x} for x in w]
    out = {}
    for d, text, *_ in docs:
        tokens = words_of(text)
        for k, (i, t) in enumerate(items):
            whole, q = sum(gain[k].values()), split_item(t)
            if sum(gain[k][x] for x in set(tokens) & set(gain[k])) < 0.5 * whole - 1e-9:
                continue
            for lo in range(len(tokens)):
                part = tokens[lo : lo + 2 * len(w[k])]
                score = sum(gain[k][x] for x in set(part) & set(gain[k])) / whole
                if score < 0.5 - 1e-9:
                    continue
                in_q, in_a = lcs(w[k][:q], part), lcs(w[k][q:], part)
                if in_q >= 0.8 * q - 1e-9 and in_a >= 0.8 * (len(w[k]) - q) - 1e-9:
                    out[d, i] = max(out.get((d, i), 0), score)
    return out


def test_against_brute_force(spark):
    docs, items = setup()
    odd = [(900, None, None, None), (901, "", "x", 1), (902, items[3][1] * 1, None, 1), (903, ("filler " * 30_000) + items[4][1], None, 1), (902, items[3][1], None, 1)]
    extra = [(500, None), (501, " .. "), (3, items[3][1]), (None, "w1 w2 w3 w4")]
    d, b = spark.createDataFrame(docs + odd, DOCS), spark.createDataFrame(items + extra, ITEMS)
    rows = contaminated(d, b).collect()
    want = brute(docs + odd, items + extra)
    assert {(r.doc_id, r.item_id) for r in rows} == set(want) and len(want) > 30
    assert len(rows) == len(want) + sum(i == 902 for i, _ in want)
    assert all(abs(r.score - want[r.doc_id, r.item_id]) < 1e-9 and min(r.question_share, r.answer_share) >= 0.8 for r in rows)
    text = {i: words_of(t) for i, t, *_ in docs + odd}
    for r in rows:
        assert text[r.doc_id][r.first_word] in words_of(dict(items + extra)[r.item_id])
    kept = clean(d, b)
    assert kept.columns == d.columns
    dirty = {i for i, _ in want}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, *_ in docs + odd if i not in dirty)


def test_several_indexes_give_the_same(spark, monkeypatch):
    docs, items = setup(2)
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    want = brute(docs, items)
    monkeypatch.setattr(decontam, "INDEX_BYTES", 1500)
    assert len(list(indexes(b))) > 2
    assert {(r.doc_id, r.item_id) for r in contaminated(d, b).collect()} == set(want)
    assert contaminated(d.limit(0), b).collect() == [] and contaminated(d, b.limit(0)).collect() == []
    assert clean(d, b.limit(0)).count() == len(docs)


def test_other_items_change_no_hits(spark, monkeypatch):
    short = "where stands the amber Velden clock tower"
    rng = random.Random(6)
    far = " ".join(w + " " + " ".join(f"f{rng.randrange(5000)}" for _ in range(60)) for w in short.split())
    near = " ".join(w + " filler" for w in short.split())
    docs = [(1, far, None, None), (2, near, None, None), (3, "before it " + short + " after it", None, None)]
    items = [(1, short), *((i, " ".join(f"g{rng.randrange(9000)}" for _ in range(12))) for i in range(2, 30))]
    long_item = (99, " ".join(f"h{rng.randrange(9000)}" for _ in range(400)))
    found = lambda items: sorted((r.doc_id, r.item_id) for r in contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect())
    assert found(items) == [(2, 1), (3, 1)] == sorted(brute(docs, items))
    assert found(items + [long_item]) == [(2, 1), (3, 1)]
    docs.append((4, "x " * 900 + long_item[1] + " y" * 900, None, None))
    assert found(items + [long_item]) == [(2, 1), (3, 1), (4, 99)]
    monkeypatch.setattr(decontam, "INDEX_BYTES", 900)
    assert found(items + [long_item]) == [(2, 1), (3, 1), (4, 99)]


def test_wand_equals_full_scores(monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK", 3)
    rng = random.Random(8)
    items = [(i, " ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(2)) for _ in range(rng.randrange(2, 9)))) for i in range(80)]
    df = {}
    for _, t in items:
        for x in np.unique(item_words(t)).tolist():
            df[x] = df.get(x, 0) + 1
    for tau in (0.3, 0.5, 0.9):
        index = ItemIndex(items, df, len(items), 5.0, tau)
        for _ in range(100):
            terms = sorted(rng.sample(range(len(index.vocab)), rng.randrange(1, 14)))
            score = {}
            for t in terms:
                for k, x in zip(index.items[t], index.impacts[t]):
                    score[k] = score.get(k, 0) + x
            got = index.retrieve(terms)
            assert sorted(k for k, _ in got) == sorted(k for k, x in score.items() if x >= tau - 1e-9)
            assert all(abs(x - score[k]) < 1e-12 for k, x in got)


def test_in_order_and_split():
    rng = random.Random(9)
    for _ in range(200):
        a, b = [rng.randrange(5) for _ in range(rng.randrange(9))], [rng.randrange(5) for _ in range(rng.randrange(15))]
        places = {}
        for k, w in enumerate(b):
            places[w] = places.get(w, 0) | 1 << k
        assert in_order(a, places) == lcs(a, b)
    assert split_item("Who is it? A b") == 3 and split_item("a b c d e f g h") == 6 and split_item("one") == 1 and split_item("a?") == 1
