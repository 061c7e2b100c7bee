"""Benchmark decontamination: a BM25 index of test items, block-max WAND, and an overlap check."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .wordbytes import ALNUM, LOWER, mix, slices, words

K1, B = 1.2, 0.75
#: Share of an item's score with itself that a span must reach, and share of the question's and
#: of the answer's words that it must hold in order.
THRESHOLD, OVERLAP = 0.5, 0.8
#: A span is SPAN times as many words as the item has.
SPAN = 2
#: The answer is what follows the last question mark, else the last quarter of the words.
ANSWER_SHARE = 0.25
#: Items in a block with maxima of its own.
BLOCK = 16
#: Share of an item's score that words set apart may make up.
APART = 0.2
#: Bytes of items in one index; more items are searched index by index.
INDEX_BYTES = 16 << 20
SLACK = 1e-9


def item_words(text: str) -> np.ndarray:
    low = LOWER[np.frombuffer(text.encode(), np.uint8)]
    return words(low, np.array([0, len(low)]), ALNUM)[2]


def split_item(text: str) -> int:
    """How many of the item's words are its question."""
    n = len(item_words(text))
    head, mark, tail = text.rpartition("?")
    if mark and len(item_words(tail)) and len(item_words(head)):
        return len(item_words(head))
    return n - max(1, int(n * ANSWER_SHARE)) if n > 1 else n


def length_class(n: int) -> int:
    """Items of 2**(c - 1) + 1 to 2**c words are of class c."""
    return max(0, n - 1).bit_length()


def in_order(item: list[int], places: dict[int, int]) -> int:
    """Length of the longest common subsequence of item and a passage of which places has each word's
    positions as bits (the bit-parallel way)."""
    v, width = 0, max(places.values(), default=0).bit_length()
    mask = (1 << width) - 1
    v = mask
    for w in item:
        u = v & places.get(w, 0)
        v = ((v + u) | (v - u)) & mask
    return width - v.bit_count()


def spread(first: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, whose) of the runs first[i]:first[i + 1] for each i."""
    n = first[of + 1] - first[of]
    whose = np.repeat(np.arange(len(of)), n)
    return np.arange(len(whose)) + np.repeat(first[of] - (np.cumsum(n) - n), n), whose


class ItemIndex:
    """Postings (item, impact) of each word, where an item's impacts sum to 1: its whole score.

    An impact is the word's BM25 weight in the item over the item's score with itself. Blocks of
    items have a maximum for each word. Frequent words are set apart as long as their impacts sum to
    less than APART in each item: the other, essential, words must bring a passage the rest.
    """

    def __init__(self, items: list[tuple[int, str]], df: dict[int, int], total: int, mean: float, threshold: float):
        self.ids = [i for i, _ in items]
        self.threshold = threshold
        own = [item_words(t) for _, t in items]
        self.question = [split_item(t) for _, t in items]
        self.vocab = np.unique(np.concatenate([np.zeros(0, np.uint64), *own]))
        #: Every span of an item's length lies in two neighbouring blocks of so many words.
        self.stride = SPAN << length_class(max((len(w) for w in own), default=1))
        self.seqs = [np.searchsorted(self.vocab, w).tolist() for w in own]
        n_of = np.array([df[w] for w in self.vocab.tolist()], np.float64)
        idf = np.log(1 + (total - n_of + 0.5) / (n_of + 0.5))
        terms, owners, gains = [], [], []
        for k, seq in enumerate(self.seqs):
            u, tf = np.unique(np.array(seq, np.int64), return_counts=True)
            gain = idf[u] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(seq) / mean))
            terms.append(u)
            owners.append(np.full(len(u), k))
            gains.append(gain / gain.sum() if len(u) else gain)
        term, owner, gain = (np.concatenate([np.zeros(0, t), *x]) for t, x in ((np.int64, terms), (np.int64, owners), (np.float64, gains)))
        order = np.lexsort((owner, term))
        term, self.item, self.impact = term[order], owner[order], gain[order]
        v, self.blocks = len(self.vocab), -(-len(items) // BLOCK)
        self.first = np.searchsorted(term, np.arange(v + 1))
        self.items = [self.item[a:b] for a, b in zip(self.first[:-1], self.first[1:])]
        self.impacts = [self.impact[a:b] for a, b in zip(self.first[:-1], self.first[1:])]
        # a cell is a word's postings in one block of items
        cells, start = np.unique(term * max(1, self.blocks) + self.item // BLOCK, return_index=True)
        self.cell_block = cells % max(1, self.blocks)
        self.cell_first = np.searchsorted(cells // max(1, self.blocks), np.arange(v + 1))
        self.cell_start = np.append(start, len(term))
        self.cell_peak = np.maximum.reduceat(self.impact, start) if len(start) else np.zeros(0)
        self.peak = np.maximum.reduceat(self.impact, self.first[:-1]) if v else np.zeros(0)
        # words by falling document frequency are set apart as long as no item's sum gets there
        self.apart = np.zeros(len(items))
        self.essential = np.ones(v, bool)
        for t in np.lexsort((np.arange(v), -n_of)).tolist():
            sums = self.apart[self.items[t]] + self.impacts[t]
            if (sums < min(APART, threshold - SLACK)).all():
                self.apart[self.items[t]] = sums
                self.essential[t] = False
        self.apart_block = np.array([self.apart[b * BLOCK : (b + 1) * BLOCK].max() for b in range(self.blocks)])
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[(mix(self.vocab) >> np.uint64(46)).astype(np.int64)] = True

    def known(self, h: np.ndarray) -> np.ndarray:
        """Word numbers, -1 for words of no item."""
        out = np.full(len(h), -1, np.int64)
        if len(self.vocab):
            near = np.flatnonzero(self.maybe[(mix(h) >> np.uint64(46)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.vocab, h[near]), len(self.vocab) - 1)
            hit = self.vocab[at] == h[near]
            out[near[hit]] = at[hit]
        return out

    def wand(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, score) of all pairs that reach the threshold; passages are distinct (passage, term).

        Block-max WAND for many passages at once: a passage goes on if the sum of its words' maxima gets
        there, a block of items if that of their maxima in the block does; only the
        postings of such blocks are summed. Words set apart count as the item's, or block's, most
        until the end, where the pairs that are left get what the passage has of them.
        """
        tau, n = self.threshold - SLACK, len(self.ids)
        main = self.essential[term]
        p, t = passage[main], term[main]
        width = int(passage.max(initial=-1)) + 1
        bound = np.bincount(p, self.peak[t], width) + self.apart_block.max(initial=0)
        go = bound[p] >= tau
        p, t = p[go], t[go]
        cell, whose = spread(self.cell_first, t)
        key = p[whose] * self.blocks + self.cell_block[cell]
        blocks, which = np.unique(key, return_inverse=True)
        go = (np.bincount(which, self.cell_peak[cell], len(blocks)) + self.apart_block[blocks % max(1, self.blocks)] >= tau)[which]
        place, of = spread(self.cell_start, cell[go])
        pairs, which = np.unique(p[whose[go]][of] * n + self.item[place], return_inverse=True)
        score = np.bincount(which, self.impact[place], len(pairs))
        go = score + self.apart[pairs % max(1, n)] >= tau
        pairs, score = pairs[go], score[go]
        if not len(pairs):
            return pairs, pairs, score
        live = np.zeros(width, bool)
        live[pairs // n] = True
        rest = ~main & live[passage]
        place, of = spread(self.first, term[rest])
        key = passage[rest][of] * n + self.item[place]
        at = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
        hit = pairs[at] == key
        score += np.bincount(at[hit], self.impact[place[hit]], len(pairs))
        go = score >= tau
        return pairs[go] // n, pairs[go] % n, score[go]

    def retrieve(self, terms: list[int]) -> list[tuple[int, float]]:
        """All items whose score with the words reaches the threshold."""
        _, item, score = self.wand(np.zeros(len(terms), np.int64), np.array(terms, np.int64))
        return list(zip(item.tolist(), score.tolist()))

    def best_span(self, ids: np.ndarray, lo: int, hi: int, last: int, item: int, overlap: float) -> tuple | None:
        """(score, question share, answer share, -start) of the best span of SPAN times the item's length that
        starts in lo:last, ends before hi and passes; a span that passes can start with a word of the item."""
        seq, q = self.seqs[item], self.question[item]
        question, answer = seq[:q], seq[q:]
        gain = dict(zip(*(x.tolist() for x in self._weights(item))))
        at = lo + np.flatnonzero(np.isin(ids[lo:hi], np.array(seq)))
        ends = np.searchsorted(at, at + SPAN * len(seq))
        least = max(overlap * len(question), overlap * len(answer)) - SLACK
        best = None
        for s in np.flatnonzero((ends - np.arange(len(at)) >= least) & (at < last)).tolist():
            span = ids[at[s : ends[s]]].tolist()
            score = sum(gain[w] for w in set(span))
            if score < self.threshold - SLACK:
                continue
            places: dict[int, int] = {}
            for k, w in enumerate(span):
                places[w] = places.get(w, 0) | 1 << k
            in_q = in_order(question, places)
            if in_q < overlap * len(question) - SLACK:
                continue
            in_a = in_order(answer, places)
            if in_a < overlap * len(answer) - SLACK:
                continue
            found = (score, in_q / len(question) if question else 1.0, in_a / len(answer) if answer else 1.0, -int(at[s]))
            best = found if best is None else max(best, found)
        return best

    def _weights(self, item: int) -> tuple[np.ndarray, np.ndarray]:
        u = np.unique(np.array(self.seqs[item], np.int64))
        return u, np.array([self.impacts[t][np.searchsorted(self.items[t], item)] for t in u.tolist()])

    def hits(self, h: np.ndarray, bounds: np.ndarray, overlap: float) -> Iterator[tuple]:
        """(text, item, score, question share, answer share, first word) of texts' verified items.

        A text's passages are its pairs of neighbouring blocks of stride words. Passages only find
        candidates: a span is verified in the passage whose first block it starts in.
        """
        ids, stride = self.known(h), self.stride
        at = np.flatnonzero(ids >= 0)
        if not len(at):
            return
        doc = np.searchsorted(bounds, at, "right") - 1
        count = np.maximum(1, -(-np.diff(bounds) // stride) - 1)  # passages of each text
        base = np.concatenate([[0], np.cumsum(count)])
        block = (at - bounds[doc]) // stride
        code = np.concatenate([np.minimum(block, count[doc] - 1), np.maximum(block - 1, 0)]) + np.tile(base[doc], 2)
        v = len(self.vocab)
        pair = np.unique(code * v + np.tile(ids[at], 2))
        best: dict[tuple[int, int], tuple] = {}
        for p, item, _ in zip(*(x.tolist() for x in self.wand(pair // v, pair % v))):
            d = int(np.searchsorted(base, p, "right")) - 1
            k, end = p - int(base[d]), int(bounds[d + 1])
            lo = int(bounds[d]) + k * stride
            last = end if k == count[d] - 1 else lo + stride
            found = self.best_span(ids, lo, min(lo + 2 * stride, end), last, item, overlap)
            if found:
                best[d, item] = max(best.get((d, item), found), found)
        for (d, item), (score, in_q, in_a, start) in sorted(best.items()):
            yield d, self.ids[item], score, in_q, in_a, -start - int(bounds[d])


HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_share", pa.float64()), ("answer_share", pa.float64()), ("first_word", pa.int64())])
DDL = "doc_id long, item_id long, score double, question_share double, answer_share double, first_word long"


def _item_terms(batches):
    """Adds each item's number of words and its distinct words."""
    for batch in batches:
        got = [item_words(t) for t in batch.column(1).to_pylist()]
        sets = [np.unique(w).view(np.int64) for w in got]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(w) for w in got], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["id", "text", "n", "terms"])


def indexes(items: DataFrame, id_col: str = "item_id", text_col: str = "text", threshold: float = THRESHOLD) -> Iterator[list[ItemIndex]]:
    """Indexes of INDEX_BYTES of items each, one for each class of length, that are searched together.

    Document frequencies and the mean length are those of all items, counted by Spark; the driver has the
    items and words of one such part at a time.
    """
    base = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null").dropDuplicates(["id", "text"])
    base = cut(base.mapInArrow(_item_terms, "id long, text string, n long, terms array<long>").where("n > 0"), "items")
    total, length, size = base.agg(F.count("*"), F.sum("n"), F.sum(F.octet_length("text"))).first()
    if not total:
        return
    parts = -(-int(size) // INDEX_BYTES)
    own = base.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(parts)))
    df = base.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    if parts > 1:
        df = cut(df, "item-frequencies")
    for p in range(parts):
        mine = own.where(F.col("part") == p)
        need = df if parts == 1 else df.join(mine.select(F.explode("terms").alias("term")).distinct(), "term", "left_semi")
        counts = {r.term & (2**64 - 1): r.n for r in need.collect()}
        classes: dict[int, list] = {}
        for r in sorted(mine.select("id", "text", "n").collect(), key=lambda r: (r.id is not None, r.id or 0, r.text)):
            classes.setdefault(length_class(r.n), []).append((r.id, r.text))
        if classes:
            yield [ItemIndex(rows, counts, int(total), length / total, threshold) for _, rows in sorted(classes.items())]


def _texts(column, group: list[ItemIndex], overlap: float):
    """(row, item, ...) of a batch's column of texts."""
    for lo, buf, off in slices(column):
        _, _, h, bounds = words(LOWER[buf], off, ALNUM)
        for index in group:
            for d, *found in index.hits(h, bounds, overlap):
                yield lo + d, *found


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """(doc_id, item_id, score, question_share, answer_share, first_word): leaks of items in documents.

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. A text leaks an item
    of n words if some run of SPAN * n of its words (or the whole text, if shorter) has a BM25 score of `threshold` of the item's with itself, and
    holds `overlap` of the question's and of the answer's words, either in order. Other items
    matter only by the frequencies of their words. Every passage is a query of the index, and all items
    it reaches the threshold for are retrieved before spans are verified. One row for each document and
    item, with its best span and where that starts.

    Null and empty texts and items without words never match; items with equal ids and texts are
    one; items without id are items like any other and give rows with a null item_id; repeated documents
    give their rows each. No items, or no leaks, give no rows. Other columns are ignored.
    """
    out = None
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    for group in indexes(items, threshold=threshold):
        handle = docs.sparkSession.sparkContext.broadcast(group)  # of INDEX_BYTES of items at most

        def run(batches, handle=handle):
            for batch in batches:
                rows = [(batch.column(0)[d].as_py(), *found) for d, *found in _texts(batch.column(1), handle.value, overlap)]
                columns = list(zip(*rows)) if rows else [[]] * len(HITS)
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, HITS)], schema=HITS)

        found = base.mapInArrow(run, DDL)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], DDL)
    return out.withColumnRenamed("doc_id", id_col)


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """Rows of docs, unchanged, that leak no item; decided row by row, so null ids are handled too."""
    at = docs.columns.index(text_col)
    for group in indexes(items, threshold=threshold):
        handle = docs.sparkSession.sparkContext.broadcast(group)

        def run(batches, handle=handle):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[d for d, *_ in _texts(batch.column(at), handle.value, overlap)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
