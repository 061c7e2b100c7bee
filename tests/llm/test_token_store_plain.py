import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lexiquarry.llm.queries import QUERIES
from lexiquarry.llm.token_store import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|>b c", "no such token", " <|endoftext|>\n z", "<| endoftext |>", None, ""]


def plain(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [0]


def test_special_tokens_as_in_a_plain_call(spark, tmp_path):
    assert plain(TEXTS[0])[:-1] == [87, 220, 50256, 331]
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    at, want = 0, []
    for i, t in enumerate(TEXTS):
        ids = plain(t)
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, QUERIES["op9_token_store"](spark, str(tmp_path)).collect())) == want


def test_encoder_mixes_special_and_other_texts():
    rng, enc, t = random.Random(5), Encoder(PATH, 0), Tokenizer.from_file(PATH)
    texts = ["".join(rng.choice([" ", "ab", "é", "\n", "<|endoftext|>", "<|endoftext", "|>"]) for _ in range(rng.randrange(14))) for _ in range(500)]
    for lo in range(0, len(texts), 41):
        size, tokens = enc.encode(texts[lo : lo + 41])
        want = [t.encode(x, add_special_tokens=False).ids + [0] for x in texts[lo : lo + 41]]
        assert size.tolist() == [len(w) for w in want] and tokens.tolist() == [i for w in want for i in w]
