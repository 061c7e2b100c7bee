"""Cleans and encodes a corpus: language, quality, near-duplicates, benchmark leaks, piece ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry.llm import langid, pieces, quality
from lexiquarry.llm.common import cut, table, tokenizer_path
from lexiquarry.llm.decontam import clean
from lexiquarry.llm.jaccard import BROADCAST_IDS, jaccard_components


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a language: null, without a letter, or with letters likelier nonsense than any learned language.

    Decided row by row: null ids, repeated rows and other columns pass through; texts of any length are
    read whole; an empty table gives an empty one. Without any labelled document no text has a language.
    """
    return langid.accepted(docs, langid.fit(docs, nonsense=True))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts whose quality score is under the classifier's threshold.

    Decided row by row, as in the stage before; null and empty texts have the score of the model's bias. Labels
    are those of `labels` alone: columns of documents with such names are not looked at.
    """
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")), keep=True)


def keep_first_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8 or more) keeps the smallest id.

    Rows with one id and one text count as one. Rows without id stay.
    """
    groups = cut(jaccard_components(docs, words=5, num=80, den=100), "groups")
    gone = cut(groups.where("doc_id is not null").where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    # up to 8 MB of ids are broadcast; more are shuffled with the texts
    kept = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(docs.columns)
    again = cut(groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    if again.isEmpty():
        return kept
    once = kept.join(again, "doc_id", "left_anti").select(docs.columns)
    return once.unionByName(kept.join(again, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"]))


def keep_unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts with a passage that holds a benchmark item's question and answer.

    Decided row by row, as in the stages before; null and empty texts, and an empty benchmark, leak nothing; items
    without id count as others do.
    """
    return clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of each text, and whether they decode to its bytes.

    One row for each row of docs, repeated and null ids included; null and empty texts have no pieces. Other columns
    are left out. Equal ids draw alike, whatever the partitions.
    """
    return pieces.segment(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", keep_identified),
    ("quality", keep_quality),
    ("ngram_jaccard", keep_first_of_group),
    ("decontamination", keep_unleaked),
    ("sentencepiece", encode),
]

#: Trained models and sampled segmentations have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as a table that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
