"""The index of a corpus: built once as Parquet tables, opened lazily, searched by phrase."""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass, field
from functools import cached_property
from math import exp

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import GRAM, edit_multiplier, l2_normalize, similarity
from ..operators import coded as CD
from ..operators import grams as G
from ..operators import kwic as K
from ..operators import soft
from ..operators import tokens as TK
from ..operators import vectors as V
from ..operators.tokenizers import WORDS, Tokenizer, tokenizer_of
from ..scratch import release, remove
from ..sources.vectors import with_unknown
from ..timing import Stopwatches


#: Bytes of vectors that the driver may hold; a larger vocabulary is scanned for each search.
LEXICON_BYTES = 512 << 20
#: A search goes down the levels by steps that read at most STEP_ROWS rows, or STEP times those of the step before.
STEP_ROWS, STEP = 2_000_000, 4
#: Up to so many rows of grams are read without looking at the triples first: a pass costs a job.
DIRECT_ROWS = 300_000


class Lexicon:
    """The vocabulary in the driver's memory: names, counts, norms and unit vectors."""

    def __init__(self, table: pa.Table):
        self.ids = table.column("tok").to_numpy().astype(np.int64)
        self.names = table.column("token").to_pylist()
        self.freq = table.column("freq").to_numpy().astype(np.int64)
        self.norm = table.column("norm").to_numpy()
        flat = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        self.vectors = flat.reshape(len(self.ids), -1) if len(self.ids) else np.zeros((0, 1))
        self.place = {w: i for i, w in enumerate(self.names)}
        self.name = dict(zip(self.ids.tolist(), self.names))

    def row(self, word: str) -> Row | None:
        i = self.place.get(word)
        return None if i is None else Row(tok=int(self.ids[i]), token=word, norm=float(self.norm[i]), embedding=self.vectors[i].tolist())

    def near(self, vectors: np.ndarray, coef: float, cut: float, floor: float) -> list[tuple[int, list[float], float, int]]:
        """(tok, similarities, edit multiplier, frequency) of words of which one reaches floor."""
        sims = np.maximum(self.vectors @ vectors.T, 0.0)
        mult = np.where(self.norm <= cut, np.exp(-self.norm / coef), 0.0) if coef > 0 else np.zeros(len(self.ids))
        at = np.flatnonzero((sims >= floor).any(axis=1) | (mult >= floor))
        return list(zip(self.ids[at].tolist(), sims[at].tolist(), mult[at].tolist(), self.freq[at].tolist()))


class PhraseTooLong(ValueError):
    pass


class UnknownWord(ValueError):
    pass


@dataclass
class Index:
    """Tables of an index, and searches over them.

    words (doc_id, words), vocab (tok, token, freq), stream (pos, doc_id, tok_idx, tok), grams
    (t0..t11, cnt, first_pos), starts (t0..t2, cnt), vectors (vec_id, embedding of unit length), norms (tok, norm).
    A compact index has coded (start, doc_id, toks, ahead) in place of stream, windows and grams, which are plans over it.
    """

    docs: DataFrame
    vocab: DataFrame
    stream: DataFrame
    windows: DataFrame
    grams: DataFrame
    starts: DataFrame
    vectors: DataFrame
    norms: DataFrame
    cap: int
    tokenizer: Tokenizer = WORDS
    timers: Stopwatches = field(default_factory=Stopwatches)
    counts: dict[str, int] = field(default_factory=dict)
    coded: DataFrame | None = None
    _names: dict[str, Row | None] = field(default_factory=dict)
    _held: Lexicon | None = None
    _low: tuple[list[float], float] | None = None

    @classmethod
    def plan(cls, docs: DataFrame, vectors: DataFrame, tokenizer: Tokenizer = WORDS, cap: int | None = None) -> Index:
        """All tables as plans over (doc_id, text) and (vec_id, embedding); nothing is written.

        The vocabulary has as many ids as there are vectors, cap at most; the last is for all other words.
        Vectors with a column `word` give the words their ids; without it ids are ranks by frequency.
        """
        vectors = _within(vectors, cap or TK.DEFAULT_CAP)
        cap = min(vectors.count(), cap or TK.DEFAULT_CAP)
        words = TK.document_tokens(docs, tokenizer)
        vocab = _vocabulary(TK.token_rows(words), vectors, cap)
        stream = TK.token_stream(words, vocab, cap)
        wins = G.windows(stream, cap)
        vectors = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id") < cap)
        norms = V.whitened_norms(vectors, TK.token_frequency(stream)) if cap else vectors.select(F.col("vec_id").alias("tok"), F.lit(0.0).alias("norm"))
        grams = G.distinct_grams(wins)
        return cls(docs, vocab, stream, wins, grams, G.short_grams(grams), vectors.withColumn("embedding", l2_normalize("embedding")), V.editable(norms), cap, tokenizer)

    @classmethod
    def build(cls, spark: SparkSession, docs: DataFrame, vectors: DataFrame, path: str, tokenizer: Tokenizer = WORDS, cap: int | None = None, compact: bool = False) -> Index:
        """Writes the tables under path, then opens them.

        windows (the suffix order) and grams are range-partitioned and sorted by their ids, so that
        a prefix's rows are few row groups of few files and Parquet's bounds are the sparse index.
        A compact index has the same triples and vocabulary, but ids by document in place of windows and grams, and no copy
        of the documents: less disk, and a search for more than three tokens reads the whole stream of ids.
        """
        timers = Stopwatches()
        put = lambda df, name: df.write.mode("overwrite").parquet(f"{path}/{name}")
        get = lambda name: spark.read.parquet(f"{path}/{name}")
        vectors = _within(vectors, cap or TK.DEFAULT_CAP)
        cap = min(vectors.count(), cap or TK.DEFAULT_CAP)
        if compact:
            return cls._build_compact(spark, docs, vectors, path, tokenizer, cap, timers)
        with timers["tokenize"]:
            put(docs, "docs")
            docs = get("docs")
            put(TK.document_tokens(docs, tokenizer), "words")
            words = get("words")
            put(_vocabulary(TK.token_rows(words), vectors, cap), "vocab")
            vocab = get("vocab")
        with timers["positions"]:
            put(TK.token_stream(words, vocab, cap), "stream")
            stream = get("stream")
        with timers["grams"]:
            put(G.windows(stream, cap).repartitionByRange("t0", "t1", "t2").sortWithinPartitions(*G.T, "pos"), "windows")
            put(G.distinct_grams(get("windows")).repartitionByRange("t0", "t1", "t2").sortWithinPartitions(*G.T), "grams")
            put(G.short_grams(get("grams")).repartitionByRange("t0", "t1", "t2").sortWithinPartitions("t0", "t1", "t2"), "starts")
        cls._finish(spark, docs, vectors, path, tokenizer, cap, timers, False)
        out = cls.load(spark, path)
        out.timers = timers
        return out

    @classmethod
    def _build_compact(cls, spark: SparkSession, docs: DataFrame, vectors: DataFrame, path: str, tokenizer: Tokenizer, cap: int, timers: Stopwatches) -> Index:
        put = lambda df, name: df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
        get = lambda name: spark.read.parquet(f"{path}/{name}")
        with timers["tokenize"]:
            put(_vocabulary(TK.token_rows(TK.document_tokens(docs, tokenizer)), vectors, cap), "vocab")
        cls._put_coded(spark, docs, path, tokenizer, cap, timers)
        with timers["grams"]:
            put(CD.triples(CD.placed(get("coded"), get("parts"))), "starts")
            release(spark)
        cls._finish(spark, docs, vectors, path, tokenizer, cap, timers, True)
        out = cls.load(spark, path, docs)
        out.timers = timers
        return out

    @classmethod
    def _put_coded(cls, spark: SparkSession, docs: DataFrame, path: str, tokenizer: Tokenizer, cap: int, timers: Stopwatches) -> None:
        """Ids by document, from a written vocabulary."""
        put = lambda df, name: df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
        get = lambda name: spark.read.parquet(f"{path}/{name}")
        with timers["tokenize"]:
            put(CD.encoded(docs, get("vocab"), cap, tokenizer), "encoded")
        with timers["positions"]:
            put(CD.ordered(get("encoded")), "coded")
            put(CD.parts(get("coded"), cap).coalesce(1), "parts")
            remove(spark, f"{path}/encoded")
            release(spark)

    @classmethod
    def _finish(cls, spark: SparkSession, docs: DataFrame, vectors: DataFrame, path: str, tokenizer: Tokenizer, cap: int, timers: Stopwatches, compact: bool) -> None:
        """Vectors, frequencies and norms, and what the index says of itself."""
        put = lambda df, name: df.write.mode("overwrite").parquet(f"{path}/{name}")
        get = lambda name: spark.read.parquet(f"{path}/{name}")
        with timers["norms"]:
            put(vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id") < cap), "vectors")
            raw = get("vectors")
            put(get("starts").groupBy(F.col("t0").alias("tok")).agg(F.sum("cnt").alias("freq")), "freq")
            put(V.editable(V.whitened_norms(raw, get("freq"))), "norms")
        total = int(get("freq").agg(F.coalesce(F.sum("freq"), F.lit(0))).first()[0])
        meta = {"cap": cap, "tokens": total, "documents": docs.count(), "words": get("vocab").count(), "tokenizer": asdict(tokenizer), "compact": compact}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str, docs: DataFrame | None = None) -> Index:
        """docs are the indexed (doc_id, text), of which a compact index has no copy; they are read for contexts alone."""
        meta = cls.meta(spark, path)
        get = lambda name: spark.read.parquet(f"{path}/{name}")
        vectors = get("vectors").withColumn("embedding", l2_normalize("embedding"))
        counts = {k: meta.get(k) for k in ("documents", "tokens", "words", "cap")}
        if not meta.get("compact"):
            return cls(get("docs"), get("vocab"), get("stream"), get("windows"), get("grams"), get("starts"), vectors, get("norms"), meta["cap"], tokenizer_of(meta["tokenizer"]), counts=counts)
        if docs is None:
            raise ValueError("a compact index has no copy of the documents; give them")
        coded = CD.placed(get("coded"), get("parts"))
        wins = CD.windows(coded)
        return cls(docs, get("vocab"), CD.stream(coded), wins, G.distinct_grams(wins), get("starts"), vectors, get("norms"), meta["cap"], tokenizer_of(meta["tokenizer"]), counts=counts, coded=coded)

    @staticmethod
    def meta(spark: SparkSession, path: str) -> dict:
        return json.loads(spark.read.text(f"{path}/meta").first()[0])

    def report(self) -> dict[str, int]:
        """Documents, tokens, words that occur under the cap, and ids, as the build counted them."""
        return dict(self.counts)

    @property
    def lexicon(self) -> DataFrame:
        """(tok, token, freq, norm, embedding) of the words that occur: what a search asks of the vocabulary."""
        both = self.vectors.select(F.col("vec_id").cast("int").alias("tok"), "embedding").join(self.norms.select(F.col("tok").cast("int").alias("tok"), "norm"), "tok")
        return self.vocab.select("tok", "token", "freq").join(both, "tok").select("tok", "token", "freq", "norm", "embedding")

    def cached(self) -> Index:
        """Takes the vocabulary to the driver, if its vectors fit LEXICON_BYTES. The corpus's tables stay on disk,
        where they are sorted by the ids that a search asks for."""
        size = self.vectors.agg(F.count("*") * F.coalesce(F.max(F.size("embedding")), F.lit(0)) * 8).first()[0]
        if size <= LEXICON_BYTES:
            self._held = Lexicon(self.lexicon.toArrow())
        return self

    def split(self, phrase: str) -> list[str]:
        return self.split_all([phrase])[0]

    def split_all(self, phrases: list[str]) -> list[list[str]]:
        """The phrases' tokens, by the expression that split the corpus (a local plan)."""
        given = self.docs.sparkSession.createDataFrame(pa.table({"p": pa.array(phrases, pa.string())}))
        return [list(r.w) for r in given.select(self.tokenizer.tokens(F.col("p")).alias("w")).collect()]

    def known(self, words: list[str]) -> list[Row]:
        """(tok, token, norm, embedding) of 1 to 12 known words; PhraseTooLong or UnknownWord otherwise."""
        if len(words) > GRAM:
            raise PhraseTooLong(f"a phrase has {GRAM} tokens at most; this one has {len(words)}")
        new = [w for w in dict.fromkeys(words) if w not in self._names]
        if new and self._held:
            self._names |= {w: self._held.row(w) for w in new}
        elif new:
            found = {r.token: r for r in self.lexicon.where(F.col("token").isin(new)).collect()}
            self._names |= {w: found.get(w) for w in new}
        for w in words:
            if self._names[w] is None:
                raise UnknownWord(f'word "{w}" is unknown, so nothing matches')
        return [self._names[w] for w in words]

    def ids(self, words: list[str]) -> list[int]:
        return [r.tok for r in self.known(words)]

    def count(self, phrase: str) -> DataFrame:
        ids = self.ids(self.split(phrase))
        return G.exact_count((self.triples_of if len(ids) <= soft.SHORT else self.grams_of)([[t] for t in ids]), ids)

    def triples_of(self, places: list[list[int]]) -> DataFrame:
        """(t0, t1, t2, cnt), whose counts sum to those of starts where the i-th id is one of places[i]; starts has all others too."""
        return self.starts

    def windows_of(self, places: list[list[int]]) -> DataFrame:
        """windows, or those alone whose i-th id is one of places[i]."""
        return self.windows if self.coded is None else CD.windows(self.coded, places)

    def grams_of(self, places: list[list[int]]) -> DataFrame:
        """(t0..t11, cnt): grams, or the same windows as rows of their own, those alone whose i-th id is one of places[i]."""
        return self.grams if self.coded is None else CD.windows(self.coded, places).select(*G.T, F.lit(1).cast("long").alias("cnt"))

    def contexts(self, phrase: str, display: int = 10, padding: int = 100) -> DataFrame:
        words = self.split(phrase)
        ids = self.ids(words)
        count = self.count(phrase).first().match_count
        return K.kwic(self.docs, self.windows_of, self.stream, ids, words[-1], count, display, padding, self.tokenizer)

    def pattern(self, words: list[Row], min_similarity: float) -> tuple[soft.Pattern, dict[int, int]]:
        """What a search of the words admits down to the level, and how often its words occur, by one pass over the
        vocabulary, whose cap bounds both."""
        floor = max(soft.LEAST_SIMILARITY, min_similarity)
        if self._low is None:
            self._low = V.lowest_norms(self.norms, self.cap)
        low, cut = self._low
        coef = V.coefficient_of(low, len(words))
        if self._held:
            near = self._held.near(np.array([r.embedding for r in words]), coef, cut, floor)
        else:
            vectors = [F.array(*[F.lit(float(x)) for x in r.embedding]) for r in words]
            sims = F.array(*[similarity("embedding", v) for v in vectors])
            mult = edit_multiplier("norm", coef) if coef > 0 else F.lit(0.0)
            mult = F.when(F.col("norm") <= cut, mult).otherwise(0.0)
            near = self.lexicon.select("tok", sims.alias("sims"), mult.alias("mult"), "freq").where(F.exists("sims", lambda x: x >= floor) | (F.col("mult") >= floor)).collect()
        match: list[dict[int, float]] = [{} for _ in words]
        insert: dict[int, float] = {}
        freq: dict[int, int] = {}
        for tok, sims, mult, n in near:
            freq[tok] = n
            for i, s in enumerate(sims):
                if s >= floor:
                    match[i][tok] = float(s)
            if mult >= floor:
                insert[tok] = float(mult)
        delete = [exp(-r.norm / coef) if coef > 0 else 0.0 for r in words]
        return soft.Pattern(match, insert, delete, soft.effective_threshold(min_similarity)), freq

    def search(self, phrase: str, k: int | None = 20, min_similarity: float = 0.45, max_runtime: float | None = None) -> DataFrame:
        """(rank, score, match_count, phrase): what occurs and is close to the phrase, best first.

        Levels are tried from the highest, until k results are there, the level of min_similarity is done, or
        max_runtime seconds have passed; all results over a level are found before the next. Without k
        all results are given, and neither found nor ranked in one place.
        """
        words = self.known(self.split(phrase))
        if k is None:
            return self._all(self.pattern(words, min_similarity)[0])
        rows = self._descend({0: self.pattern(words, min_similarity)}, k, max_runtime)[0]
        return self.docs.sparkSession.createDataFrame(_table([(0, *r) for r in rows]).drop_columns(["query_id"]))

    def search_batch(self, phrases: list[tuple[int, str]], k: int = 20, min_similarity: float = 0.45, max_runtime: float | None = None) -> DataFrame:
        """(query_id, rank, score, match_count, phrase) of many phrases: each pass over the grams serves all
        that have not got k results yet. Phrases with unknown words or too many tokens give no rows."""
        patterns = {}
        for number, split in zip([n for n, _ in phrases], self.split_all([p for _, p in phrases])):
            try:
                patterns[number] = self.pattern(self.known(split), min_similarity)
            except (UnknownWord, PhraseTooLong):
                continue
        found = self._descend(patterns, k, max_runtime)
        return self.docs.sparkSession.createDataFrame(_table([(q, *r) for q, rows in sorted(found.items()) for r in rows]))

    def _descend(self, patterns: dict[int, tuple[soft.Pattern, dict[int, int]]], k: int, max_runtime: float | None) -> dict[int, list[tuple]]:
        """(rank, score, match_count, phrase) of each pattern's k best.

        A step takes the lowest level that reads at most STEP_ROWS rows, or STEP times the last step's, counted by its first
        words; a result's score doesn't depend on the level at which it is found, so steps never change results.
        """
        until = time.perf_counter() + max_runtime if max_runtime is not None else float("inf")
        reads: dict[int, int] = {}
        level = dict.fromkeys(patterns, 1.0)
        best: dict[int, list] = {q: [] for q in patterns}
        pending = set(patterns)
        while pending and (not reads or time.perf_counter() < until):
            step = {}
            for q in sorted(pending):
                whole, freq = patterns[q]
                lower = [x for x in soft.LADDER if whole.threshold <= x < level[q]]
                allowed = max(STEP_ROWS, STEP * reads.get(q, 0))
                for x in lower:
                    p = whole.at(x)
                    n = sum(freq[t] for t in p.firsts)
                    if q in step and n > allowed:
                        break
                    step[q], level[q], reads[q] = p, x, n
            done = self._at_level(step, k, sum(reads[q] for q in step))
            for q in step:
                best[q] = done.get(q, [])
            pending = {q for q in pending if len(best[q]) < k and level[q] > patterns[q][0].threshold}
        names = self._names_of({t for rows in best.values() for _, s, _ in rows for t in s})
        return {q: [(i + 1, x, c, " ".join(names.get(t, TK.UNKNOWN) for t in s)) for i, (x, s, c) in enumerate(rows)] for q, rows in best.items()}

    def _at_level(self, step: dict[int, soft.Pattern], k: int, reads: int) -> dict[int, list]:
        """k best of each pattern: first of distinct triples, then of the longer grams that such triples start. k short
        results raise the level for the longer ones. Few rows are read at once."""
        if reads <= DIRECT_ROWS and self.coded is None:
            return soft.merged(soft.whole(self.grams, step, k).toArrow(), k)
        got = soft.short(self.triples_of([sorted(set().union(*(p.firsts for p in step.values())))]), step, k).toArrow()
        done, on = soft.merged(got, k), soft.onward(got.filter(pc.equal(got.column("match_count"), soft.ONWARD)))
        if on:
            rest = {q: step[q].at(max(step[q].threshold, done[q][-1][0])) if len(done.get(q, [])) >= k else step[q] for q in on}
            places = [sorted({t for q in on for t in on[q][i]}) for i in range(soft.SHORT)]
            more = soft.long(self.grams_of(places), rest, k, places).toArrow()
            done = soft.merged(pa.concat_tables([got, more]), k)
        return done

    def _names_of(self, ids: set[int]) -> dict[int, str]:
        if self._held or not ids:
            return self._held.name if self._held else {}
        return {r.tok: r.token for r in self.vocab.where(F.col("tok").isin(sorted(ids))).select("tok", "token").collect()}

    def _all(self, p: soft.Pattern) -> DataFrame:
        brief = soft.short(self.starts, {0: p}, None)
        marks = brief.where(F.col("match_count") == soft.ONWARD)
        parts = brief.where(F.col("match_count") != soft.ONWARD)
        on = soft.onward(marks.toArrow())  # ids of the vocabulary, three lists a task
        if on:
            parts = parts.unionByName(soft.long(self.grams_of(on[0]), {0: p}, None, on[0]))
        whole = parts.groupBy("seq").agg(F.sum("match_count").alias("match_count"), F.max("score").alias("score"))
        return soft.ranked(soft.render(whole, self.vocab))


class Staged(Index):
    """A compact index whose tables are written when they are first asked for, so that a question costs the disk of what it reads.

    Words with their counts and norms need no ids of the documents; counts, contexts and the search for one phrase need
    ids by document, but no distinct triples, which lists of phrases and `starts` bring about. The vectors are not copied.
    Ids stay where their documents are: what is put in order of doc_id is each document's first and last tokens, from which
    windows run into the next. Positions of all tokens (stream, windows) alone need a table in that order.
    """

    def __init__(self, spark: SparkSession, docs: DataFrame, vectors: DataFrame, path: str, tokenizer: Tokenizer = WORDS, cap: int | None = None):
        self._spark, self._path, self.docs, self.tokenizer = spark, path, docs, tokenizer
        self._given = _within(vectors, cap or TK.DEFAULT_CAP)
        self.cap = min(self._given.count(), cap or TK.DEFAULT_CAP)
        self.timers, self._names = Stopwatches(), {}

    def _put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self._path}/{name}")
        return self._spark.read.parquet(f"{self._path}/{name}")

    @cached_property
    def _words(self) -> DataFrame:
        with self.timers["tokenize"]:
            out = self._put(TK.word_counts(TK.token_rows(TK.document_tokens(self.docs, self.tokenizer))), "words")
            release(self._spark)
        return out

    @cached_property
    def vocab(self) -> DataFrame:
        return self._put(TK.named(self._words, self._given) if "word" in self._given.columns else TK.most_frequent(self._words, self.cap), "vocab")

    @cached_property
    def counts(self) -> dict[str, int]:
        sizes = {"documents": self.docs, "words": self.vocab}
        return {n: t.count() for n, t in sizes.items()} | {"tokens": self._total(self._words), "cap": self.cap}

    @staticmethod
    def _total(counts: DataFrame) -> int:
        return int(counts.agg(F.coalesce(F.sum("freq"), F.lit(0))).first()[0])

    @cached_property
    def freq(self) -> DataFrame:
        """(tok, freq) of the stream, in which all other words have the last id."""
        other = self._total(self._words) - self._total(self.vocab)
        last = self._spark.createDataFrame([(self.cap - 1, other)] if other else [], "tok int, freq long")
        return self.vocab.select("tok", "freq").unionByName(last)

    @property
    def _raw(self) -> DataFrame:
        return self._given.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id") < self.cap)

    @cached_property
    def vectors(self) -> DataFrame:
        return self._raw.withColumn("embedding", l2_normalize("embedding"))

    @cached_property
    def norms(self) -> DataFrame:
        with self.timers["norms"]:
            return self._put(V.editable(V.whitened_norms(self._raw, self.freq)), "norms")

    @cached_property
    def _held(self) -> Lexicon | None:
        size = self.vectors.agg(F.count("*") * F.coalesce(F.max(F.size("embedding")), F.lit(0)) * 8).first()[0]
        return Lexicon(self.lexicon.toArrow()) if size <= LEXICON_BYTES else None

    def cached(self) -> Index:
        """The vocabulary comes to the driver with the first search, if its vectors fit."""
        return self

    @cached_property
    def coded(self) -> DataFrame:
        """(row, doc_id, toks), in no order."""
        with self.timers["tokenize"]:
            return self._put(CD.encoded(self.docs, self.vocab, self.cap, self.tokenizer), "coded")

    def _ordered(self, rows: DataFrame, name: str) -> DataFrame:
        with self.timers["positions"]:
            table = self._put(CD.ordered(rows), name)
            out = CD.placed(table, self._put(CD.parts(table, self.cap).coalesce(1), f"{name}_parts"))
            release(self._spark)
        return out

    @cached_property
    def _edges(self) -> DataFrame:
        return self._ordered(CD.folded(self.coded), "edges")

    @cached_property
    def _placed(self) -> DataFrame:
        return self._ordered(self.coded, "ordered")

    @cached_property
    def stream(self) -> DataFrame:
        return CD.stream(self._placed)

    @cached_property
    def windows(self) -> DataFrame:
        return CD.windows(self._placed)

    def windows_of(self, places: list[list[int]]) -> DataFrame:
        return CD.windows(self._placed, places)

    def grams_of(self, places: list[list[int]]) -> DataFrame:
        return CD.windows(CD.pieces(self.coded, self._edges, CD.AHEAD), places).select(*G.T, F.lit(1).cast("long").alias("cnt"))

    def contexts(self, phrase: str, display: int = 10, padding: int = 100) -> DataFrame:
        """Hits are told apart by document and place; only those shown get positions, from the table of documents' ends."""
        words = self.split(phrase)
        ids = self.ids(words)
        count = self.count(phrase).first().match_count
        ranks = K.sampled_ranks(count, display)
        pieces = CD.pieces(self.coded, self._edges, CD.AHEAD)
        found = lambda places: CD.windows(pieces, places, ("doc_id", "row")).select("pos", *G.T, "row", *K.digits("doc_id"), *K.digits("row"))
        got = K.at_ranks(found, ids, [f"{c}_{by}" for c in ("doc_id", "row") for by in K.DIGITS] + ["pos"], ranks, count) if ranks else {}
        begin = {r.row: r.start for r in self._edges.where(F.col("row").isin(sorted({x["row"] for x in got.values()}))).select("row", "start").collect()} if got else {}
        hits = [(i + 1, begin[got[r]["row"]] + got[r]["pos"]) for i, r in enumerate(ranks)]
        ends = F.array(*[F.lit(p).cast("long") for p in K.ends_of(hits, len(ids))])
        after = F.col("start") + F.size("toks") + F.col("left")
        near = self._edges.select("doc_id", "start", F.explode(F.filter(ends, lambda p: (p >= F.col("start")) & (p < after))).alias("pos")).collect() if hits else []
        return K.shown(self.docs, hits, {r.pos: (r.doc_id, r.pos - r.start) for r in near}, len(ids), words[-1], padding, self.tokenizer)

    @cached_property
    def grams(self) -> DataFrame:
        return G.distinct_grams(self.windows)

    @cached_property
    def starts(self) -> DataFrame:
        with self.timers["grams"]:
            out = self._put(CD.triples(CD.pieces(self.coded, self._edges, 2)), "starts")
            release(self._spark)
        return out

    def ids(self, words: list[str]) -> list[int]:
        """Those of the vocabulary, for which no norms are asked."""
        if len(words) > GRAM:
            return super().ids(words)
        found = {r.token: r.tok for r in self.vocab.where(F.col("token").isin(words)).collect()}
        return [found[w] for w in words] if all(w in found for w in words) else super().ids(words)

    def triples_of(self, places: list[list[int]]) -> DataFrame:
        return self.starts if "starts" in self.__dict__ else CD.counted(CD.pieces(self.coded, self._edges, 2), places)

    def search_batch(self, phrases: list[tuple[int, str]], k: int = 20, min_similarity: float = 0.45, max_runtime: float | None = None) -> DataFrame:
        """Many phrases start with many words, and each pass reads the triples of all of them: those are written first."""
        self.starts  # noqa: B018
        return super().search_batch(phrases, k, min_similarity, max_runtime)


def _within(vectors: DataFrame, cap: int) -> DataFrame:
    """Named vectors under the cap, with a zero vector for unknown words as the last; others as they are."""
    return with_unknown(vectors.where(F.col("vec_id") < cap - 1)) if "word" in vectors.columns else vectors


def _vocabulary(rows: DataFrame, vectors: DataFrame, cap: int) -> DataFrame:
    return TK.named_vocabulary(rows, vectors) if "word" in vectors.columns else TK.vocabulary(rows, cap)


def _table(rows: list[tuple]) -> pa.Table:
    schema = pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), ("score", pa.float64()), ("match_count", pa.int64()), ("phrase", pa.string())])
    return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)] if rows else [pa.array([], t.type) for t in schema], schema=schema)
