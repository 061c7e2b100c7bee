"""Vectors in published formats, named vocabularies, standard input, bounds on tokens, option files."""

import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiquarry import cli
from lexiquarry.operators.tokenizers import LETTERS, MOSES, MOSES_SPLIT, WORDS
from lexiquarry.plans.index import Index
from lexiquarry.sources import text as S
from lexiquarry.sources import vectors as V

LINES = "the 1 0 0.5\n. . . -1e-3 2 3 \ngold 0 1 0\ngold 9 9 9\n"
ROWS = [(0, "the", [1.0, 0.0, 0.5]), (1, ". . .", [-1e-3, 2.0, 3.0]), (2, "gold", [0.0, 1.0, 0.0]), (3, "gold", [9.0, 9.0, 9.0])]


def rows_of(df):
    return sorted((r.vec_id, r.word, r.embedding) for r in df.collect())


@pytest.mark.parametrize("head", ["", "4 3\n"])
def test_lines_of_a_word_and_numbers(spark, tmp_path, head):
    (tmp_path / "v.vec").write_text(head + LINES)
    assert rows_of(V.EMBEDDINGS["plain"](spark, f"file://{tmp_path}/v.vec")) == ROWS
    last = rows_of(V.EMBEDDINGS["fasttext"](spark, f"file://{tmp_path}/v.vec"))[-1]
    assert last == (4, None, [0.0, 0.0, 0.0])


def test_empty_file_of_vectors(spark, tmp_path):
    (tmp_path / "v.vec").write_text("")
    assert V.EMBEDDINGS["gensim"](spark, f"file://{tmp_path}/v.vec").count() == 0


def test_a_folder_with_names_and_a_matrix(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_ROWS", 3)
    table = np.random.default_rng(1).normal(size=(10, 4)).astype(np.float32)
    np.save(tmp_path / "embedding.npy", table)
    (tmp_path / "vocab.json").write_text(json.dumps({"a": 0, "ü": 1, "日本": 9}, ensure_ascii=False))
    got = rows_of(V.EMBEDDINGS["plain"](spark, str(tmp_path)).fillna("", ["word"]))
    assert [g[2] for g in got] == table.astype(float).tolist()
    assert {g[0]: g[1] for g in got if g[1]} == {0: "a", 1: "ü", 9: "日本"}
    np.save(tmp_path / "flat.npy", table.reshape(-1))
    with pytest.raises(ValueError):
        V.EMBEDDINGS["plain"](spark, str(tmp_path / "flat.npy"))


@pytest.mark.parametrize("kind", ["F32", "F16", "BF16", "F64"])
def test_tensors(spark, tmp_path, kind):
    table = np.array([[1.0, -2.0], [0.5, 0.0], [3.0, 4.0]], np.float32)  # exact in each type
    raw = {"F32": table, "F16": table.astype(np.float16), "F64": table.astype(np.float64), "BF16": (table.view(np.uint32) >> 16).astype(np.uint16)}[kind].tobytes()
    header = json.dumps({"other": {"dtype": "U8", "shape": [3], "data_offsets": [0, 3]}, "model.embed_tokens.weight": {"dtype": kind, "shape": [3, 2], "data_offsets": [3, 3 + len(raw)]}}).encode()
    (tmp_path / "m.safetensors").write_bytes(len(header).to_bytes(8, "little") + header + b"abc" + raw)
    got = V.EMBEDDINGS["plain"](spark, str(tmp_path / "m.safetensors")).orderBy("vec_id").collect()
    assert [r.embedding for r in got] == table.astype(float).tolist()
    with pytest.raises(ValueError):
        V.tensor_matrix(str(tmp_path / "m.safetensors"), "missing")


def test_pieces_have_the_names_that_texts_are_cut_into(spark):
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    names = {r.word for r in V.piece_names(spark, path).collect()}
    from lexiquarry.operators.tokenizers import SubwordTokenizer

    cut = spark.range(1).select(SubwordTokenizer(path).tokens(F.lit("Uncommon wordings, here and there")).alias("w")).first().w
    assert set(cut) <= names


@pytest.mark.parametrize("cap, known", [(None, {"gold": 0, "silver": 1, "medal": 3}), (3, {"gold": 0, "silver": 1})])
def test_an_index_whose_words_have_their_vectors_ids(spark, tmp_path, cap, known):
    vectors = [(0, [1.0, 0.0, 0.0], "gold"), (1, [0.8, 0.6, 0.0], "silver"), (2, [0.0, 1.0, 0.0], "unseen"), (3, [0.0, 0.0, 1.0], "medal"), (4, [1.0, 1.0, 1.0], "medal")]
    vectors = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, word string")
    docs = spark.createDataFrame([(0, "gold medal medal"), (1, "silver medal"), (2, "other gold")], "doc_id long, text string")
    Index.build(spark, docs, vectors, str(tmp_path / "i"), LETTERS, cap)
    index = Index.load(spark, str(tmp_path / "i"))
    assert {r.token: r.tok for r in index.vocab.collect()} == known
    assert index.cap == (3 if cap else 6)
    if not cap:
        assert index.count("gold medal").first().match_count == 1
        found = {r.phrase: r.score for r in index.search("gold medal", 5, 0.45).collect()}
        assert found["gold medal"] == pytest.approx(1) and found["silver medal"] == pytest.approx(0.8)
        planned = Index.plan(docs, vectors, LETTERS)
        assert {r.token: r.tok for r in planned.vocab.collect()} == known
    meta = Index.meta(spark, str(tmp_path / "i"))
    assert (meta["documents"], meta["tokens"], meta["words"]) == (3, 7, len(known))


def test_standard_input(spark, monkeypatch):
    monkeypatch.setattr(S, "INPUT_BYTES", 5)
    data = "héllo wörld\n日本語テスト\nlast".encode()
    path = S.standard_input(spark, io.BytesIO(data))
    assert [r.text for r in S.text_files(spark, path).orderBy("line_id").collect()] == data.decode().split("\n")
    assert S.text_files(spark, S.standard_input(spark, io.BytesIO(b""))).count() == 0


def test_bound_on_tokens(spark):
    docs = spark.createDataFrame([(i, "a b c d " * (1 + i % 7)) for i in range(2000)] + [(-1, None)], "doc_id long, text string")
    exact = S.estimate_tokens(docs, WORDS).first().tokens
    first = [S.token_bound(docs, WORDS, 0.1, n).first().tokens for n in range(3)]
    assert exact < first[0] < first[1] < first[2]
    assert first[0] == pytest.approx(1.3 * exact, rel=0.01) and first[2] == pytest.approx(1.45 * exact, rel=0.01)
    assert S.token_bound(docs, WORDS, 0.0).first().tokens == sum(len(r.text or "") for r in docs.collect())
    assert S.token_bound(docs.limit(0), WORDS).first().tokens == 0


def test_abbreviations(spark):
    f = lambda t, x: spark.range(1).select(t.tokens(F.lit(x)).alias("w"), t.gaps(F.lit(x)).alias("g"), t.raw_tokens(F.lit(x)).alias("r")).first()
    got = f(MOSES, "Dr. Smith of the U.S. saw J. Doe. No. 5 is, e.g. well-known etc. and so on. No. End.")
    assert got.w == "dr. smith of the u.s. saw j. doe . no. 5 is , e.g. well-known etc. and so on . no . end .".split()
    assert "".join(a + b for a, b in zip(got.g, got.r)) == "Dr. Smith of the U.S. saw J. Doe. No. 5 is, e.g. well-known etc. and so on. No. End."
    assert f(MOSES_SPLIT, "Mrs. Well-Known").w == ["mrs.", "well", "-", "known"]


def test_option_files(tmp_path):
    (tmp_path / "o.json").write_text(json.dumps({"index": "/i", "num_candidates": 7, "vectors": "/v"}))
    args = cli.options(["search", "--config_path", str(tmp_path / "o.json"), "a phrase"])
    assert (args.index, args.num_candidates, args.min_similarity) == ("/i", 7, 0.45)
    assert cli.options(["search", "--config_path", str(tmp_path / "o.json"), "--num_candidates", "3", "x"]).num_candidates == 3
    assert cli.options(["index", "--config_path", str(tmp_path / "o.json"), "-"]).vectors == "/v"
    (tmp_path / "bad.json").write_text(json.dumps({"indexx": "/i"}))
    with pytest.raises(SystemExit):
        cli.options(["search", "--config_path", str(tmp_path / "bad.json"), "x"])
    with pytest.raises(SystemExit):
        cli.options(["search", "x"])


def test_build_and_search_from_the_command_line(spark, tmp_path, capsys):
    (tmp_path / "v.vec").write_text("gold 1 0 0\nsilver 0.8 0.6 0\nmedal 0 0 1\n")
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps({"text": t}) for t in ("gold medal", "silver medal", "no words here")))
    where = f"{tmp_path}/i"
    assert cli.main(["index", "--index", where, "--vectors", f"file://{tmp_path}/v.vec", "--backend", "gensim", "--jsonl_key", "text", f"file://{tmp_path}/c.jsonl"]) == 0
    assert "#Vocabulary: 3 " in capsys.readouterr().out
    assert cli.main(["search", "--index", where, "gold medal"]) == 0
    out = capsys.readouterr().out
    assert "100.0" in out and "silver medal" in out
