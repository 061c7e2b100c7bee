"""The pipeline's language stage drops what is in no learned language, and nothing else."""

import random

from corpus_pipeline import keep_identified

SCHEMA = "doc_id long, text string, lang string"
SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ein", "ung", "ü"]}


def test_nonsense_is_dropped(spark):
    rng = random.Random(6)
    words = lambda parts, n: " ".join("".join(rng.choices(parts, k=rng.randrange(2, 6))) for _ in range(n))
    clean = [(i, words(SYLLABLES[lang], rng.randrange(3, 60)), lang) for i in range(160) for lang in [rng.choice("ab") * 2]]
    clean.append((200, clean[0][1] + " " + next(t for _, t, lang in clean if lang != clean[0][2]), None))
    clean.append((201, " ".join(f"{w} {rng.randrange(10**15)} +1 (887) 555-{rng.randrange(10**4)}" for w in clean[1][1].split()[:6]), None))
    odd = ["abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "αβγδεζηθικλμνξοπρστυ", "абвгдежзийклмноп", "的一是不了人我在有他这中大来"]
    bad = [(300 + 10 * i + j, words(letters, 30), None) for i, letters in enumerate(odd) for j in range(5)]
    bad += [(400, None, "aa"), (401, "", "aa"), (402, "12 34 !!", "bb")]
    df = spark.createDataFrame(clean + bad, SCHEMA)
    assert sorted(map(tuple, keep_identified(spark, df, "").collect())) == sorted(clean)


def test_one_language(spark):
    rng = random.Random(7)
    word = lambda parts: "".join(rng.choices(parts, k=3))
    clean = [(i, " ".join(word(SYLLABLES["aa"]) for _ in range(30)), "aa") for i in range(60)]
    df = spark.createDataFrame([*clean, (90, " ".join(word(["x", "q", "w", "j"]) for _ in range(30)), None)], SCHEMA)
    assert sorted(map(tuple, keep_identified(spark, df, "").collect())) == clean
