import json

import pytest
from pyspark.sql import functions as F

from lexiquarry.operators.tokenizers import LETTERS, MOSES, MOSES_SPLIT, WORDS
from lexiquarry.operators import tokens as TK
from lexiquarry.sources import text as S
from lexiquarry.sources import vectors as V


@pytest.mark.parametrize("data", [b"", b"hello world\n", b"hello world", b"line one\nline two", b"a\n\nb\n\n\nc\n", b"".join(b"line %d\n" % i for i in range(10_000)), "héllo wörld\n日本語テスト\ncafé naïve\n".encode()])
def test_line_starts(spark, tmp_path, data):
    (tmp_path / "f.txt").write_bytes(data)
    got = [(r.line_id, r.byte_start) for r in S.text_files(spark, f"file://{tmp_path}/f.txt").collect()]
    starts = [0] + [i + 1 for i, b in enumerate(data) if b == 10 and i + 1 < len(data)] if data else []
    assert sorted(got) == list(enumerate(starts))


def test_line_table_of_documents(spark):
    docs = S.corpus(spark.createDataFrame([(2, "ü\n\nx"), (1, None), (5, "end\n")], "doc_id long, text string"))
    got = sorted((r.doc_id, r.line_no, r.byte_start, r.text) for r in S.line_table(docs).collect())
    assert got == [(1, 0, 0, ""), (2, 0, 1, "ü"), (2, 1, 4, ""), (2, 2, 5, "x"), (5, 0, 7, "end"), (5, 1, 11, "")]


def test_json_lines_and_lists(spark, tmp_path):
    (tmp_path / "f.jsonl").write_text("\n".join(json.dumps({"text": t}) for t in ("a b", "ü")))
    assert sorted(r.text for r in S.read_json_lines(spark, f"file://{tmp_path}/f.jsonl", "/text").collect()) == ["a b", "ü"]
    (tmp_path / "q.txt").write_text("machine learning  \n\n物理\n")
    assert [(r.query_id, r.phrase) for r in S.query_list(spark, f"file://{tmp_path}/q.txt").orderBy("query_id").collect()] == [(0, "machine learning"), (2, "物理")]


def test_samples(spark):
    docs = spark.createDataFrame([(i, "日本語 text " * 5) for i in range(20)], "doc_id long, text string")
    assert all(len(r.chunk) == 7 for r in S.random_chunks(docs, 7, 1.0).collect())
    assert S.estimate_tokens(docs, WORDS).first().tokens == 200
    a = S.synthetic_lines(spark, 50, 5, ["x", "y"]).collect()
    assert a == S.synthetic_lines(spark, 50, 5, ["x", "y"]).collect() and all(len(r.text.split()) == 5 for r in a)


def test_tokenizers(spark):
    f = lambda t, x: spark.range(1).select(t.tokens(F.lit(x)).alias("w")).first().w
    assert f(WORDS, "Héllo, wörld! it's") == ["héllo", ",", "wörld", "!", "it", "'", "s"]
    assert f(LETTERS, "a-b 日本 3.5") == ["a", "b", "日本", "3", "5"]
    assert f(MOSES, "It's 3.5 well-known... ok") == ["it", "'s", "3.5", "well-known", "...", "ok"]
    assert f(MOSES_SPLIT, "well-known") == ["well", "-", "known"]
    assert f(WORDS, "  ") == []


def test_spans_and_ids(spark):
    docs = S.corpus(spark.createDataFrame([(1, "  the quick the"), (2, "héllo wörld"), (3, ""), (4, "Unknown THE")], "doc_id long, text string"))
    vocab = spark.createDataFrame([(0, "the", 3), (1, "quick", 1), (2, "héllo", 1), (3, "wörld", 1)], "tok int, token string, freq long")
    got = sorted(map(tuple, TK.encode_with_spans(docs, vocab, 5).collect()))
    assert got == [(1, 0, 0, 2), (1, 1, 1, 6), (1, 2, 0, 12), (2, 0, 2, 0), (2, 1, 3, 7), (4, 0, 4, 0), (4, 1, 0, 8)]
    back = TK.decode(spark.createDataFrame([(0,), (4,)], "tok int"), vocab).collect()
    assert {r.tok: r.token for r in back} == {0: "the", 4: "<unk>"}


def test_vocabulary_order_and_cap(spark):
    rows = spark.createDataFrame([(w,) for w in "b b a a c d d d".split()], "token string")
    assert [(r.tok, r.token, r.freq) for r in TK.vocabulary(rows, 4).orderBy("tok").collect()] == [(0, "d", 3), (1, "a", 2), (2, "b", 2)]


def test_embedding_flavours(spark, tmp_path):
    spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 2.0])], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/v")
    path = f"{tmp_path}/v"
    assert {r.vec_id: r.embedding for r in V.EMBEDDINGS["gensim"](spark, path).collect()}[2] == [0.0, 0.0]
    assert V.EMBEDDINGS["transformers"](spark, path).where("vec_id = 0").first().embedding == pytest.approx([0.6, 0.8])
    assert V.EMBEDDINGS["plain"](spark, path).count() == 2
    ids = spark.createDataFrame([(1,)], "tok long")
    assert V.gather(ids, V.plain(spark, path)).first().embedding == [0.0, 2.0]
