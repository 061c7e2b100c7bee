"""Exact n-gram Jaccard join by vertical partitioning of the global n-gram order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .graph import components
from .wordbytes import LOWER, mix, shingle_sets, slices

FRAGMENTS = 8
#: 64-bit words of the parity sketch of a set of up to SKETCH_SET n-grams; larger sets get twice,
#: four times, ... as many, and meet smaller ones with the halves of their sketch folded together.
SKETCH_WORDS, SKETCH_SET = 16, 2048
#: The order puts up to so many of the most frequent n-grams last.
FREQUENT = 65_536
LOCAL_MIN, GLOBAL_MIN, LOCAL_BUFFER = 4, 16, 1 << 20
#: A prefix is longer than one shared n-gram asks for by a share of what sets may differ by; in
#: return, linked sets share as many more n-grams of it.
EXTRA = 10
#: Ids to which documents are matched by a broadcast (8 MB); beyond it by a shuffle.
BROADCAST_IDS = 1_000_000
SEEN = 1 << 18


def _node(u: np.ndarray) -> int:
    """A set's signature."""
    return int(mix(np.add.reduce(mix(u ^ np.uint64(0x5851F42D4C957F2D)), keepdims=True) + np.uint64(len(u))).view(np.int64)[0])


def _sketch(u: np.ndarray) -> np.ndarray:
    bits = 64 * SKETCH_WORDS << max(0, (len(u) // (SKETCH_SET // 2)).bit_length() - 1)
    bit = (mix(u + np.uint64(99)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def _sets(batches, k: int):
    """(id, set) of each row."""
    for batch in batches:
        ids = batch.column(0)
        for lo, buf, off in slices(batch.column(1)):
            low = LOWER[buf]
            for i, u in enumerate(shingle_sets(low, off, k)):
                yield ids[lo + i].as_py(), u


def _table(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)] if rows else [pa.array([], t.type) for t in schema], schema=schema)


def _signatures(k: int):
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("gram", pa.int64())])

    def run(batches):
        rows, held, size, seen = [], [], 0, set()

        def frequent():
            u, c = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, int))
            keep = c >= LOCAL_MIN
            m = int(keep.sum())
            return pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.array(c[keep].astype(np.int64)), pa.nulls(m, pa.int64()), pa.array(u[keep].view(np.int64))], schema=schema)

        for i, u in _sets(batches, k):
            node = _node(u) if len(u) else None
            rows.append((i, len(u), node, None))
            if node is not None and node not in seen:
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                held.append(u)
                size += len(u)
            if size >= LOCAL_BUFFER:
                yield frequent()
                held, size = [], 0
            if len(rows) >= 4096:
                yield _table(rows, schema)
                rows = []
        yield _table(rows, schema)
        yield frequent()

    return run


def _ordered(u: np.ndarray, freq: np.ndarray, level: np.ndarray) -> np.ndarray:
    """u in the global order: rare n-grams by hash, then the frequent by level and hash."""
    if len(freq):
        at = np.minimum(np.searchsorted(freq, u), len(freq) - 1)
        lv = np.where(freq[at] == u, level[at], 0)
        if lv.any():
            return u[np.lexsort((u, lv))]
    return u


def _prefixes(k: int, num: int, den: int, freq: np.ndarray, level: np.ndarray):
    """Rows of prefix n-grams (gram, node, n, at), and one row with the parity sketch for each set."""
    schema = pa.schema([("gram", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("at", pa.int32()), ("bits", pa.list_(pa.int64()))])

    def run(batches):
        grams, meta, size, seen = [], [], 0, set()

        def flush():
            g = np.concatenate([x for x, *_ in grams]) if grams else np.zeros(0, np.uint64)
            ln = np.array([len(x) for x, *_ in grams], np.int64)
            node = np.repeat(np.array([m for _, m, _ in grams], np.int64), ln)
            n = np.repeat(np.array([c for *_, c in grams], np.int32), ln)
            at = np.arange(1, len(g) + 1) - np.repeat(np.cumsum(ln) - ln, ln)
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(node), pa.array(n), pa.array(at.astype(np.int32)), pa.nulls(len(g), schema.field("bits").type)], schema=schema)
            if meta:
                yield pa.RecordBatch.from_arrays([pa.nulls(len(meta), pa.int64()), pa.array([m for m, *_ in meta], pa.int64()), pa.array([c for _, c, _ in meta], pa.int32()), pa.nulls(len(meta), pa.int32()), pa.array([b for *_, b in meta], schema.field("bits").type)], schema=schema)

        for _, u in _sets(batches, k):
            if not len(u):
                continue
            node = _node(u)
            if node in seen:
                continue
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(node)
            free = len(u) - -(-num * len(u) // den)
            p = min(len(u), free + 1 + free // EXTRA)
            grams.append((_ordered(u, freq, level)[:p], node, len(u)))
            meta.append((node, len(u), _sketch(u)))
            size += p
            if size >= 100_000:
                yield from flush()
                grams, meta, size = [], [], 0
        yield from flush()

    return run


def _segments(k: int):
    """Each set's segments, one row for each fragment of the order that it meets."""
    schema = pa.schema([("node", pa.int64()), ("fragment", pa.int32()), ("grams", pa.list_(pa.int64()))])
    cuts = np.array([(1 << 64) // FRAGMENTS * i for i in range(1, FRAGMENTS)], np.uint64)

    def run(batches):
        rows = []
        for _, u in _sets(batches, k):
            node = _node(u) if len(u) else None
            for f, part in enumerate(np.split(u, np.searchsorted(u, cuts))):
                if len(part):
                    rows.append((node, f, part.view(np.int64)))
            if len(rows) >= 2048:
                yield _table(rows, schema)
                rows = []
        yield _table(rows, schema)

    return run


class _Rule:
    """Jaccard >= num / den, and what it asks of two sets of sizes n and m."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def overlap(self, n: Column, m: Column) -> Column:
        return F.ceil((n + m).cast("long") * F.lit(self.num) / F.lit(self.num + self.den) - F.lit(1e-9))

    def similar_size(self, a: str, b: str) -> Column:
        n, m = F.col(f"{a}.n").cast("long"), F.col(f"{b}.n").cast("long")
        return F.least(n, m) * self.den >= F.greatest(n, m) * self.num

    def may_link(self, a: str, b: str) -> Column:
        """Lengths, and places of what may be the first shared n-gram, allow the overlap."""
        n, m = F.col(f"{a}.n").cast("long"), F.col(f"{b}.n").cast("long")
        rest = F.least(n - F.col(f"{a}.at"), m - F.col(f"{b}.at")) + 1
        return self.similar_size(a, b) & (rest >= self.overlap(n, m))


    def shared(self, n: Column) -> Column:
        """How many n-grams of its prefix a set of n shares with any it is linked to."""
        n = n.cast("long")
        return 1 + F.floor((n - F.floor((n * self.num + (self.den - 1)) / self.den)) / EXTRA)


def _ordered_pair() -> tuple[Column, Column]:
    return F.least("a.node", "b.node").alias("x"), F.greatest("a.node", "b.node").alias("y")


def _verify(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, k: int, rule: _Rule) -> DataFrame:
    """The links (a, b), as ids of representatives, among candidate pairs (x, y) of sets."""
    s = lambda p, q: sketches.select(F.col("node").alias(p), F.col("id").alias(q), F.col("n").alias(f"n_{p}"), F.col("bits").alias(f"bits_{p}"))
    words = F.least(F.size("bits_x"), F.size("bits_y"))

    def folded(bits):
        halves = F.zip_with(F.slice(bits, F.lit(1), words), F.slice(bits, words + 1, words), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(bits) == 2 * words, halves).otherwise(bits)

    differ = F.when(
        F.greatest(F.size("bits_x"), F.size("bits_y")) <= 2 * words,
        F.aggregate(F.zip_with(folded(F.col("bits_x")), folded(F.col("bits_y")), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda acc, v: acc + v),
    ).otherwise(0)
    both = F.col("n_x").cast("long") + F.col("n_y")
    close = pairs.join(s("x", "a"), "x").join(s("y", "b"), "y").where(differ <= both - 2 * rule.overlap(F.col("n_x"), F.col("n_y")))
    close = cut(close.select("x", "y", "a", "b", "n_x", "n_y"), "close-pairs")
    ids = cut(close.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "close-ids")
    few = ids.count() <= BROADCAST_IDS
    picked = docs.join(F.broadcast(ids) if few else ids, "id", "left_semi")
    segments = picked.mapInArrow(_segments(k), "node long, fragment int, grams array<long>").groupBy("node", "fragment").agg(F.first("grams").alias("grams"))
    segments = cut(segments, "segments")
    side = lambda p: segments.select(F.col("node").alias(p), "fragment", F.col("grams").alias(f"grams_{p}"))
    partial = close.join(side("x"), "x").join(side("y"), ["y", "fragment"]).select("a", "b", "n_x", "n_y", F.size(F.array_intersect("grams_x", "grams_y")).alias("shared"))
    found = partial.groupBy("a", "b", "n_x", "n_y").agg(F.sum("shared").alias("shared"))
    return cut(found.where(F.col("shared") * rule.den >= (F.col("n_x").cast("long") + F.col("n_y") - F.col("shared")) * rule.num).select("a", "b"), "links")


def jaccard_components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of the documents whose shingle sets have a Jaccard similarity of num/den or more.

    A set holds the distinct runs of `words` lower-cased (A-Z) words between white space; a shorter
    text is one shingle; null, empty and blank texts have no set and link with nothing. Equal sets
    are one node from the start, so copies are never paired. Nodes meet on the rare end of the
    global n-gram order: hash order with the most frequent n-grams last. In every meeting point
    each node is first paired with the most central one; only nodes that this leaves in another
    component than that one are then paired with the other members, so a group of near copies
    costs pairs in proportion to its size. Bounds by length, by position, by the number of shared
    prefix n-grams and by parity sketches drop pairs without loss. For the rest, the order is cut into fragments, the overlap of each fragment is
    counted separately, and the counts are summed for each pair. No link between different sets
    is lost; only links within one component may stay uncounted.

    Ids must be integers. Repeated rows, and rows that share an id, are rows of their own; null ids
    stay null. Returns id, n_shingles, component_id: the smallest id reachable.
    """
    rule = _Rule(num, den)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    first = cut(base.mapInArrow(_signatures(words), "id long, n long, node long, gram long"), "signatures")
    sets = first.where("gram is null").select("id", "n", "node")
    top = first.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= GLOBAL_MIN).orderBy(F.desc("n"), "gram").limit(FREQUENT).collect()
    gram, level = np.array([r.gram for r in top], np.int64).view(np.uint64), np.array([int(r.n).bit_length() for r in top], np.int64)
    order = np.argsort(gram)

    reps = cut(sets.where("node is not null").groupBy("node").agg(F.min("id").alias("id")), "representatives")
    second = cut(base.mapInArrow(_prefixes(words, num, den, gram[order], level[order]), "gram long, node long, n int, at int, bits array<long>"), "prefixes")
    sketches = cut(second.where("bits is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits")).join(reps, "node"), "sketches")
    postings = second.where("bits is null").select("gram", "node", "n", "at")
    met = postings.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1").select("gram")
    postings = cut(postings.join(met, "gram").groupBy("gram", "node").agg(F.first("n").alias("n"), F.first("at").alias("at")), "postings")
    centre = cut(postings.groupBy("gram").agg(F.min(F.struct("at", "n", "node")).alias("m"), F.count("*").alias("c")).where("c > 1").select("gram", "m.*"), "centres")

    star = cut(postings.alias("a").join(centre.alias("b"), "gram").where(rule.may_link("a", "b")).select(*_ordered_pair()).where("x != y").distinct(), "star-pairs")
    links = _verify(star, sketches, base, words, rule)

    labels = components(links)
    node_label = cut(reps.join(labels.withColumnRenamed("v", "id"), "id", "left").select("node", F.coalesce("c", "id").alias("c")), "node-labels")
    held = cut(postings.join(node_label, "node"), "labelled-postings")
    apart = held.join(centre.join(node_label, "node").select("gram", F.col("c").alias("cc")), "gram").where("c != cc")
    met = apart.alias("a").join(held.alias("b"), "gram").where((F.col("a.c") != F.col("b.c")) & rule.similar_size("a", "b"))
    # shared n-grams are counted once or twice, never less than they are
    counted = met.select(*_ordered_pair(), F.least(rule.shared(F.col("a.n")), rule.shared(F.col("b.n"))).alias("need"), rule.may_link("a", "b").alias("may"))
    rest = counted.groupBy("x", "y", "need").agg(F.count("*").alias("shared"), F.max("may").alias("may")).where("may and shared >= need").select("x", "y")
    more = _verify(rest.join(star, ["x", "y"], "left_anti"), sketches, base, words, rule)
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    whole = reps.join(labels.withColumnRenamed("v", "id"), "id", "left").select("node", F.coalesce("c", "id").alias("c"))
    return sets.join(whole, "node", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("c", "id").alias("component_id"))
