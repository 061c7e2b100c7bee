import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece

from lexiquarry.llm.pieces import ALPHA, LEAST, PieceModel, decode_ids, segment
from lexiquarry.llm.wordbytes import slices

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, ids string, n_pieces int"
TEXTS = ["Hello world", "", None, " lead", "trail ", "two  spaces   three", "new\nline\r\n\ttab", "▁literal ▁▁ x", "日本語 текст 🙂🙂 \U0010ffff", "x" * 3000, " ", "a", "\0", "é" * 20, "antidisestablishmentarianism " * 300]


def draw(m, texts, seeds):
    out = []
    for lo, b, o in slices(pa.array(texts, pa.string())):
        per, ids = m.sample(b, o, np.array(seeds[lo : lo + len(o) - 1], np.int64))
        out += [x.tolist() for x in np.split(ids, np.cumsum(per)[:-1])]
    return out


def paths(m, sp, text):
    """All segmentations of a short text and their shares, by recursion."""
    chars = "▁" + text.replace(" ", "▁")
    known = {sp.id_to_piece(i): i for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}

    def go(at):
        if at == len(chars):
            return [((), 1.0)]
        out = []
        for n in range(1, 17):
            p = chars[at : at + n]
            if len(p) == n and p in known:
                out += [((known[p], *rest), np.exp(max(ALPHA * sp.get_score(known[p]), LEAST)) * w) for rest, w in go(at + n)]
        return out

    found = go(0)
    total = sum(w for _, w in found)
    return {p: w / total for p, w in found}


def test_draws_follow_the_lattice():
    m, sp = PieceModel(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    for text in ("the cat", "hello", "aaaa"):
        want, n = paths(m, sp, text), 20_000
        got = Counter(map(tuple, draw(m, [text] * n, list(range(n)))))
        assert set(got) <= set(want)
        for p, share in want.items():
            assert abs(got[p] / n - share) < 4 * (share * (1 - share) / n) ** 0.5 + 1e-4


def test_seeds_and_batches():
    m = PieceModel(PATH)
    seeds = list(range(len(TEXTS)))
    whole = draw(m, TEXTS, seeds)
    assert whole == [draw(m, [t], [s])[0] if t else [] for t, s in zip(TEXTS, seeds)]
    assert draw(m, ["some longer words here"] * 2, [1, 2])[0] != draw(m, ["some longer words here"], [2])[0]


def test_round_trip(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", None, 1), (3, " lead", None, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = segment(df, PATH).collect()
    assert len(got) == len(rows) and all(r.lossless for r in got)
    assert all(r.n_pieces == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    text = sorted(((r.doc_id, r.text) for r in decode_ids(segment(df, PATH), PATH).collect()), key=str)
    assert text == sorted(((i, t or "") for i, t, *_ in rows), key=str)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.ids)
    assert by[3][0] == by[3][1] and by[1] == [[]] and by[2] == [[]]
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert sp.decode(by[0][0]) == "Hello world"
    assert segment(df.limit(0), PATH).collect() == []
