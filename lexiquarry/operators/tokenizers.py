"""Tokenizers as regular expressions, so that splitting stays in the JVM, and by subword models in Arrow batches."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..plugins import Plugins
from ..session import ship

TOKENIZERS = Plugins("tokenizer")


@dataclass(frozen=True)
class RegexTokenizer:
    """Tokens are the matches of `token`; what lies between is `gap`. Lower-cased unless told otherwise."""

    token: str
    gap: str
    lower: bool = True

    def raw_tokens(self, text: Column) -> Column:
        """Tokens as written."""
        return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(f"({self.token})"), F.lit(1))

    def tokens(self, text: Column) -> Column:
        raw = self.raw_tokens(text)
        return F.transform(raw, F.lower) if self.lower else raw

    def gaps(self, text: Column) -> Column:
        """What stands before each token, as written."""
        return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(f"({self.gap})({self.token})"), F.lit(1))


def _in_characters(text: str, places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Rising places in UTF-8 bytes as places in characters."""
    raw = text.encode()
    out, at, chars = [], 0, 0
    for a, b in places:
        start = chars + len(raw[at:a].decode())
        chars = start + len(raw[a:b].decode())
        out.append((start, chars))
        at = b
    return out


@lru_cache(maxsize=4)
def _model(path: str) -> Callable[[list[str]], list[list[tuple[int, int]]]]:
    """Places (start, end) of the pieces of texts; a model is loaded once a process."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [_in_characters(t, [(p.begin, p.end) for p in found.pieces]) for t, found in zip(texts, pieces.encode(texts, return_type="proto", num_threads=1))]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    return lambda texts: [e.offsets for e in model.encode_batch(texts, add_special_tokens=False)]


def pieces_of(text: str, places: list[tuple[int, int]]) -> Iterator[tuple[str, str]]:
    """(what stands before it, piece) of each place, white space never being part of a piece. Of the pieces within one
    character, the first is that character and the rest are left out."""
    done = 0
    for a, b in places:
        a = max(a, done)
        piece = text[a:b].strip()
        if piece:
            a = text.index(piece, a)
            yield text[done:a], piece
            done = a + len(piece)


@dataclass(frozen=True)
class SubwordTokenizer:
    """Tokens are the pieces of a model file (.json of the tokenizers library, .model of sentencepiece), which every
    executor must be able to read. A piece is known by the text that it covers: marks of word starts, which would part
    a phrase's first piece from the same piece within a text, are no part of it."""

    path: str
    lower: bool = False

    def _column(self, text: Column, which: int) -> Column:
        path = self.path

        @F.pandas_udf("array<string>")
        def cut(texts: pd.Series) -> pd.Series:
            whole = texts.tolist()
            return pd.Series([[p[which] for p in pieces_of(t, at)] for t, at in zip(whole, _model(path)(whole))], dtype=object)

        ship(SparkSession.active())
        return cut(F.coalesce(text.cast("string"), F.lit("")))

    def raw_tokens(self, text: Column) -> Column:
        return self._column(text, 1)

    def tokens(self, text: Column) -> Column:
        raw = self.raw_tokens(text)
        return F.transform(raw, F.lower) if self.lower else raw

    def gaps(self, text: Column) -> Column:
        return self._column(text, 0)


Tokenizer = RegexTokenizer | SubwordTokenizer


def tokenizer_of(fields: dict) -> Tokenizer:
    """The tokenizer of an index's metadata."""
    return SubwordTokenizer(**fields) if "path" in fields else RegexTokenizer(**fields)


_WORD = r"[\p{L}\p{N}]+"
_PUNCT = r"[^\p{L}\p{N}\s]"

#: Words and single punctuation marks: the default.
WORDS = RegexTokenizer(rf"{_WORD}|{_PUNCT}", r"\s*")
LETTERS = RegexTokenizer(_WORD, r"[^\p{L}\p{N}]*")
SPACES = RegexTokenizer(r"[^ \t\n\r]+", r"[ \t\n\r]*")
# English abbreviations that keep their full stop, and those that keep it before a number only.
PREFIXES = "Adj Adm Adv Asst Bart Bldg Brig Bros Capt Cmdr Col Comdr Con Corp Cpl DR Dr Drs Ens Gen Gov Hon Hosp Insp Lt MM MR MRS MS Maj Messrs Mlle Mme Mr Mrs Ms Msgr Op Ord Pfc Ph Prof Pvt Rep Reps Res Rev Rt Sen Sens Sfc Sgt Sr St Supt Surg v vs i.e rev e.g"
NUMERIC_PREFIXES = "No Nos Art Nr pp"
#: A full stop stays with a word that holds another, a single capital, an abbreviation, or before a small letter.
_STOP = "|".join(
    [
        r"\p{L}[\p{L}\p{N}]*(?:\.\p{L}[\p{L}\p{N}]*)+(?:\.(?=\s|$))?",
        r"\p{Lu}\.(?=\s|$)",
        rf"(?:{'|'.join(p.replace('.', chr(92) + '.') for p in PREFIXES.split())})\.(?=\s|$)",
        rf"(?:{'|'.join(NUMERIC_PREFIXES.split())})\.(?=\s+\p{{Nd}})",
        r"\p{L}[\p{L}\p{N}]*\.(?=\s+\p{Ll})",
    ]
)
_NUMBER = r"\p{N}+(?:[.,:]\p{N}+)*"
_REST = rf"\.{{2,}}|'(?:s|re|ve|d|m|ll|t)\b|{_PUNCT}"
#: Numbers, hyphened words, clitics, abbreviations and runs of dots stay whole, as in the usual
#: machine-translation tokenizer.
MOSES = RegexTokenizer(rf"{_NUMBER}|{_STOP}|\p{{L}}[\p{{L}}\p{{N}}]*(?:-{_WORD})*|{_REST}", r"\s*")
MOSES_SPLIT = RegexTokenizer(rf"{_NUMBER}|{_STOP}|\p{{L}}[\p{{L}}\p{{N}}]*|{_REST}", r"\s*")
#: One token a character, for scripts without spaces; the query side is not lower-cased.
CHARACTERS = RegexTokenizer(r"[A-Za-z0-9]+|\S", r"\s*", lower=False)

for _name, _t in (("words", WORDS), ("letters", LETTERS), ("spaces", SPACES), ("moses", MOSES), ("moses_split_hyphen", MOSES_SPLIT), ("characters", CHARACTERS)):
    TOKENIZERS.add(_name, item=_t)


@TOKENIZERS.add("gensim")
def gensim_tokenizer(split_hyphen: bool = False) -> RegexTokenizer:
    return MOSES_SPLIT if split_hyphen else MOSES


@TOKENIZERS.add("fasttext")
def fasttext_tokenizer(model: str) -> RegexTokenizer:
    """By the language in the model's name: fasttext-<lang>-vectors."""
    import re

    m = re.fullmatch(r"fasttext-(.+)-vectors", model)
    if not m:
        raise ValueError(f"no language in {model!r}")
    return for_language(m[1])


@TOKENIZERS.add("llama", "transformers")
def subword_tokenizer(model: str) -> SubwordTokenizer:
    """By a model's file."""
    return SubwordTokenizer(model)


def for_language(lang: str) -> RegexTokenizer:
    if lang == "ja":
        return CHARACTERS
    return MOSES if lang in ("el", "la", "he") else WORDS
