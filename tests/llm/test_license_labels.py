"""Which licence a notice is, where licences share their wording."""

import random

from lexiquarry.llm.licenses import MIN_WORDS, TEMPLATES, counted, scan_licenses

SCHEMA = "doc_id long, text string"


def plain_counted(spans):
    fit = [s for s in spans if s[4] >= MIN_WORDS or s[3] == 1.0]

    def beaten(a, b):
        common = len(set(range(a[1], a[2] + 1)) & set(range(b[1], b[2] + 1)))
        return a[0] != b[0] and 2 * common > min(a[2] - a[1] + 1, b[2] - b[1] + 1) and (b[3], b[4]) > (a[3], a[4])

    return [a for a in fit if not any(beaten(a, b) for b in fit)]


def test_counted_equals_all_comparisons():
    rng = random.Random(5)
    for _ in range(400):
        spans = []
        for _ in range(rng.randrange(12)):
            a = rng.randrange(30)
            spans.append((rng.choice("abc"), a, a + rng.randrange(2, 15), rng.choice([0.6, 0.8, 1.0]), rng.randrange(3, 9)))
        assert sorted(counted(spans)) == sorted(plain_counted(spans))


def test_each_notice_has_its_own_label_alone(spark):
    rows = [(i, f"before {text} after") for i, (_, text) in enumerate(TEMPLATES)]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, (label, text) in enumerate(TEMPLATES):
        assert {s.label for s in got[i].spans} == {label}, (text, got[i].spans)
        assert got[i].score == 1.0


def test_common_words_are_no_notice(spark):
    rows = [(0, "the album was released under the name of its label"), (1, "licensed under the Foo License"), (2, "licensed under the"), (3, "licensed under the MIT license"), (4, None), (5, "")]
    got = {r.doc_id: (r.labels, r.score) for r in scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: ("", 0.0), 1: ("", 0.0), 2: ("", 0.0), 3: ("mit", 1.0), 4: ("", 0.0), 5: ("", 0.0)}


def test_notices_in_a_row_all_count(spark):
    whole = " ".join(t for _, t in TEMPLATES)
    got = scan_licenses(spark.createDataFrame([(0, whole), (1, whole)], SCHEMA)).collect()
    assert all({s.label for s in r.spans} == {x for x, _ in TEMPLATES} for r in got) and got[0].spans == got[1].spans
