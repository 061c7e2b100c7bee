import random
import re

import numpy as np

from lexiquarry.llm.licenses import BASE, TEMPLATES, LicenseIndex, SuffixAutomaton, chain, scan_licenses

SCHEMA = "doc_id long, text string, labels string, score int"


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base_of(text):
    w = words_of(text)
    return sorted((i, label) for p, label in BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split())


def test_matching_statistics():
    rng = random.Random(4)
    seqs = [[rng.randrange(4) for _ in range(rng.randrange(1, 14))] for _ in range(6)]
    sa = SuffixAutomaton(seqs)
    for _ in range(60):
        text = [rng.randrange(5) for _ in range(30)]
        for i, (s, n) in enumerate(sa.statistics(text)):
            want = max(k for k in range(i + 2) if k == 0 or any(text[i + 1 - k : i + 1] == q[j : j + k] for q in seqs for j in range(len(q))))
            assert n == want
            if n:
                assert sa.ends[s] == {(a, j + n - 1) for a, q in enumerate(seqs) for j in range(len(q) - n + 1) if q[j : j + n] == text[i + 1 - n : i + 1]}


def test_chains():
    assert chain([(0, 0, 4), (6, 5, 3)]) == [(0, 8, 7)]
    assert sorted(chain([(0, 0, 4), (500, 5, 3)])) == [(0, 3, 4), (500, 502, 3)]
    assert chain([(0, 0, 4), (3, 3, 3)]) == [(0, 5, 6)]


def test_base_places_equal_brute_force(spark):
    rng = random.Random(6)
    pool = "cc by BY-NC general public license License, all rights reserved Reserved. the GNU é 4.0 x".split()
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(30))) for _ in range(300)] + ["", None, "CC-BY\ncc_by ccby", "all rights", "reserved cc by"]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)).collect()}
    for i, t in enumerate(texts):
        want = base_of(t)
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words_of(t)), len(want))
        assert (r.first_word, r.last_word) == ((want[0][0], want[-1][0]) if want else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in want}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_templates_with_edits(spark):
    rng, rows = random.Random(7), []
    for i, (label, text) in enumerate(TEMPLATES):
        w = text.split()
        if len(w) > 20:
            del w[rng.randrange(len(w))]
            w.insert(rng.randrange(len(w)), "inserted")
        rows.append((i, "some words before " + " ".join(w).upper() + " and after " * 50, None, None))
    rows += [(100, "released into the wild under no license", None, None), (101, "of the and the of this to any " * 3000, None, None), (None, "Released under the MIT License.", None, None)]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, (label, _) in enumerate(TEMPLATES):
        assert label in got[i].labels.split(","), (label, got[i])
        assert any(s.label == label and s.share >= 0.6 and s.first >= 2 for s in got[i].spans)
    assert got[100].labels == "" and got[101].labels == "" and got[None].labels == "mit"
    assert scan_licenses(spark.createDataFrame([], SCHEMA)).collect() == []


def plain_spans(text, index):
    """Matches by comparing every place of the text with every place of every sequence, chained by plain dynamic
    programming over all earlier matches."""
    seqs = [words_of(p) for p, _ in BASE] + [words_of(t) for _, t in TEMPLATES]
    w = words_of(text)
    longest = [{} for _ in range(len(w) + 1)]  # end -> {(sequence, its start): words}
    for k, s in enumerate(seqs):
        row = [0] * len(s)
        for i, x in enumerate(w):
            row = [(row[j - 1] if j else 0) + 1 if x == y else 0 for j, y in enumerate(s)]
            longest[i] |= {(k, j - n + 1): n for j, n in enumerate(row) if n}
    top = [max(x.values(), default=0) for x in longest]
    out = set()
    for k in range(len(BASE), len(seqs)):
        found = sorted({(i - n + 1, p, n) for i, x in enumerate(longest[:-1]) for (q, p), n in x.items() if q == k and n == top[i] >= 3 and top[i + 1] != n + 1}, key=lambda m: (m[0] + m[2], m))
        best, spans = [], {}
        for t, p, n in found:
            own = (n, t, len(best))
            for (u, q, m), (covered, first, start) in zip(found, best):
                skip = max(0, u + m - t, q + m - p)
                if u < t and q < p and skip < n and t + skip - u - m <= 16 and p + skip - q - m <= 16 and covered + n - skip > own[0]:
                    own = (covered + n - skip, first, start)
            best.append(own)
            if own[2] not in spans or own[0] > spans[own[2]][2]:
                spans[own[2]] = (own[1], t + n - 1, own[0])
        out |= {(index.labels[k], a, b, min(1.0, c / len(seqs[k]))) for a, b, c in spans.values() if c >= 0.6 * len(seqs[k])}
    return sorted(out)


def test_spans_equal_plain_chains():
    rng, index = random.Random(12), LicenseIndex()
    texts = ["", "of the"]
    for _ in range(120):
        w = []
        for _ in range(rng.randrange(1, 4)):
            t = rng.choice(TEMPLATES)[1].split()
            for _ in range(rng.randrange(6)):
                at = rng.randrange(len(t))
                t[at : at + rng.randrange(3)] = rng.choice([[], ["the"], ["license", "and"], ["zzz"] * rng.randrange(20)])
                t = t or ["x"]
            w += [*t, *rng.choices(["the", "license", "of", "x", "software"], k=rng.randrange(8))]
        texts.append(" ".join(w))
    buf = [t.encode() for t in texts]
    off = np.cumsum([0, *map(len, buf)])
    got = list(index.scan(np.frombuffer(b"".join(buf), np.uint8), off))
    assert sum(len(spans) for *_, spans in got) > 100
    for text, (n, base, spans) in zip(texts, got):
        assert n == len(words_of(text)) and base == base_of(text)
        assert [s[:3] for s in spans] == [s[:3] for s in plain_spans(text, index)], text
        assert np.allclose([s[3] for s in spans], [s[3] for s in plain_spans(text, index)])
