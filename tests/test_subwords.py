"""Subword tokenizers against the libraries' own calls."""

import pytest
from pyspark.sql import functions as F

from lexiquarry.cli import tokenizer_named
from lexiquarry.operators.tokenizers import MOSES, WORDS, SubwordTokenizer, pieces_of, tokenizer_of
from lexiquarry.operators.tokens import token_spans
from lexiquarry.plans.index import Index

public = pytest.importorskip("public_tokenizers")
TEXTS = ["", None, "   ", "Tokenization of uncommon wordings", "  the\tquick\n brown", "héllo wörld 🧪 日本語テスト", "the the <|endoftext|> the", "x" * 5000]


def test_pieces_keep_white_space_and_parts_of_characters_out():
    assert list(pieces_of("a  b", [(0, 1), (1, 3), (3, 4)])) == [("", "a"), ("  ", "b")]
    assert list(pieces_of("aé b", [(0, 1), (1, 2), (1, 2), (2, 4)])) == [("", "a"), ("", "é"), (" ", "b")]
    assert list(pieces_of("", [])) == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_spans_tell_the_text_again(spark, name):
    tokenizer = SubwordTokenizer(public.path(name))
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    found = {}
    for r in token_spans(docs, tokenizer).orderBy("doc_id", "tok_idx").collect():
        found.setdefault(r.doc_id, []).append((r.byte_off, r.token))
    for i, text in enumerate(TEXTS):
        whole = (text or "").encode()
        spans = found.get(i, [])
        assert all(whole[at : at + len(t.encode())] == t.encode() for at, t in spans)
        assert [at for at, _ in spans] == sorted({at for at, _ in spans})
        assert "".join(t for _, t in spans) == "".join((text or "").split())


def test_same_pieces_as_the_library(spark):
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    plain = [t for t in TEXTS if t and t.isascii() and t.strip()]
    docs = spark.createDataFrame([(t,) for t in plain], "text string")
    got = {r.text: r.w for r in docs.select("text", SubwordTokenizer(path).tokens(F.col("text")).alias("w")).collect()}
    for t in plain:
        pieces = [model.decode([i], skip_special_tokens=False).strip() for i in model.encode(t, add_special_tokens=False).ids]
        assert got[t] == [p for p in pieces if p]


def test_index_by_pieces(spark, tmp_path):
    tokenizer = tokenizer_named("llama", public.path("byte_bpe_50k.json"))
    docs = spark.createDataFrame([(0, "uncommon wordings here"), (1, "some uncommon wordings"), (2, "")], "doc_id long, text string")
    vectors = spark.createDataFrame([(i, [float(i == k) for k in range(12)]) for i in range(12)], "vec_id long, embedding array<double>")
    Index.build(spark, docs, vectors, str(tmp_path / "i"), tokenizer)
    index = Index.load(spark, str(tmp_path / "i"))
    assert index.tokenizer == tokenizer
    assert index.count("wordings").first().match_count == 2
    rows = index.contexts("wordings").collect()
    assert [r.match for r in rows] == ["wordings"] * 2


def test_plug_ins_by_name():
    assert tokenizer_named("") is WORDS and tokenizer_named("gensim") is MOSES
    assert tokenizer_of({"token": "a", "gap": "b", "lower": False}).token == "a"
