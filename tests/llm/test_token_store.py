import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lexiquarry.llm import store
from lexiquarry.llm.common import scratch
from lexiquarry.llm.token_store import Encoder, Places, Reader, Writer, read_tokens, token_store, tokens_at, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "plain words here", "", None, " lead", "trail ", "two  spaces", "tab\t end \n\n x", "it's we'll 'tis  'S", "\0 nul \0", "a b <|endoftext|> c",
    "ünïcödé 日本語 text 🙂🙂", "x" * 300 + " " + "y" * 5000, "  nbsp  ", "line\nline\r\n next", "1234 5678,90 !!! ?? #$%", " ", "  ", "\n",
]


def plain():
    t = Tokenizer.from_file(PATH)
    return lambda x: t.encode(x or "", add_special_tokens=False).ids + [0]


def test_encoder_equals_plain_encoding():
    rng, enc = random.Random(3), Encoder(PATH, 0)
    texts = TEXTS + ["".join(rng.choice(" ab\n\t.é'9") for _ in range(rng.randrange(40))) for _ in range(400)]
    ref = plain()
    for lo in range(0, len(texts), 37):
        part = [x or "" for x in texts[lo : lo + 37]]
        size, tokens = enc.encode(part)
        want = [ref(x) for x in part]
        assert size.tolist() == [len(w) for w in want]
        assert tokens.tolist() == [i for w in want for i in w]
    enc.uses[:] = 5
    enc._forget()
    assert enc.encode(["plain words here"])[1].tolist() == ref("plain words here")


def test_codes_give_any_token():
    rng = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 5000):
        tokens = (2 ** rng.uniform(0, 31, n)).astype(np.uint32)
        w = Writer()
        w.add([7], np.array([n]), tokens)
        r = Reader(b"".join(bytes(p) for p in w.parts()))
        assert r.tokens == n and r.ids == [7]
        assert (r.range(0, n) == tokens).all() and (r.access(np.arange(n)) == tokens).all()
        for _ in range(20):
            lo, hi = sorted(rng.integers(0, n + 1, 2).tolist())
            assert (r.range(lo, hi) == tokens[lo:hi]).all()


def test_store(spark):
    rows = [(100 - i, t, i) for i, t in enumerate(TEXTS)] + [(None, "no id", 0), (500, "same", 1), (500, "same", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start long")
    ref, at, want = plain(), 0, []
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = ref(t)
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_store(df, PATH).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert token_store(df.limit(0), PATH).collect() == []
    written = write_tokens(df, scratch(spark, "t"), PATH, file_bytes=400)
    files = written.orderBy("part", "seq").collect()
    assert len(files) > 3 and sum(f.docs for f in files) == len(rows)
    readers = [Reader(store.get(f.uri)) for f in files]
    ids = [i for r in readers for i in r.ids]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert [readers[1].document(k).tolist() for k in range(readers[1].documents)] == [ref(dict((a, b) for a, b, _ in rows)[i]) for i in readers[1].ids]
    assert sorted(map(str, map(tuple, read_tokens(written).collect()))) == sorted(map(str, got))
    whole = [int(t) for r in readers for k in range(r.documents) for t in r.document(k)]
    spots = [0, 1, 7, len(whole) - 1, len(whole), -1, None, 7, *range(0, len(whole), 97)]
    found = tokens_at(written, spark.createDataFrame([(i, "x") for i in spots], "place long, token string")).collect()
    assert sorted(map(tuple, found)) == sorted((i, whole[i]) for i in spots if i is not None and 0 <= i < len(whole))


def test_one_token_is_read_by_its_bytes(tmp_path):
    tokens = (2 ** np.random.default_rng(2).uniform(0, 31, 3000)).astype(np.uint32)
    w = Writer()
    w.add([1, None, 3], np.array([1000, 0, 2000]), tokens)
    uri = f"file://{tmp_path}/x.dac"
    store.put(uri, w.parts())
    p = Places(uri)
    assert [p.start(k) for k in range(4)] == [0, 1000, 1000, 3000]
    assert [p.token(i) for i in range(0, 3000, 7)] == tokens[::7].tolist()


def test_ranges_split_null_ids_and_repeated_rows(spark):
    rows = [(None, "text %d" % (i % 5)) for i in range(300)] + [(7, "the same")] * 300 + [(8, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    written = write_tokens(df, scratch(spark, "t"), PATH, file_bytes=300)
    files = written.orderBy("part", "seq").collect()
    assert max(f.docs for f in files) < 150 and len({f.part for f in files}) > 4 and sum(f.docs for f in files) == len(rows)
    ids = [i for f in files for i in Reader(store.get(f.uri)).ids]
    assert ids == [None] * 300 + [7] * 300 + [8]
