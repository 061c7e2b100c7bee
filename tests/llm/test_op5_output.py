import zlib

import numpy as np

from lexiquarry.llm.queries import QUERIES


def test_op5_gives_its_pieces(spark, tmp_path):
    texts = ["Some plain words.", "ünïcödé 日本", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op5_sentencepiece"](spark, str(tmp_path)).collect()
    assert len(rows) == 4 and all(len(r.ids) == r.n_pieces and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and r.lossless for r in rows)
    assert {r.doc_id for r in rows if r.n_pieces} == {0, 1}
