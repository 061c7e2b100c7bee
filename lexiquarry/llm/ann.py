"""Approximate nearest neighbours: multiprobe p-stable hashing, then exact distances."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

TABLES, SEED = 2, 9
#: There are as many functions as give buckets of about so many vectors, between these bounds.
OCCUPANCY, LEAST_FUNCTIONS, MOST_FUNCTIONS = 2, 4, 24
#: Probability, as estimated, that a neighbour lies in the buckets probed.
TARGET = 0.98
#: Exact queries from which the angle to the k-th neighbour is learned, and the quantile taken; vectors from which
#: the functions' offsets are.
CALIBRATION, QUANTILE, OFFSETS = 64, 0.75, 1024
#: Vectors and queries that meet in one task.
BLOCK, QUERY_BLOCK = 16_384, 4_096
#: Up to so many blocks' numbers of parts are broadcast (16 bytes each).
BROADCAST_BLOCKS = 1_000_000
SLACK = 1e-9


def _matrix(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.list_(pa.float64()))
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def _list(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), np.ascontiguousarray(m).reshape(-1))


def functions_for(vectors: int) -> int:
    """Bits of a bucket: one more for each doubling of the table."""
    return min(MOST_FUNCTIONS, max(LEAST_FUNCTIONS, math.ceil(math.log2(max(1, vectors) / OCCUPANCY))))


class Hashes:
    """Projections on Gaussian directions, made orthogonal as far as they can be, cut at an offset into two open cells.

    Vectors are scaled by the largest norm and lifted to the unit sphere by one more component, and
    queries are scaled to it, so the largest inner product is the smallest angle. A bucket's code has one bit a
    function: the first half of the bits is its left code, the others are its right code.
    """

    def __init__(self, dim: int, norm: float, functions: int, sample: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.norm, self.n = norm, functions
        self.a = rng.standard_normal((TABLES, functions, dim + 1))
        for t in range(TABLES):
            for lo in range(0, functions, dim + 1):
                part = self.a[t, lo : lo + dim + 1]
                q, r = np.linalg.qr(part.T)
                self.a[t, lo : lo + dim + 1] = (q * np.sign(np.diag(r))).T * math.sqrt(dim + 1)
        # an offset in the middle of a sample's projections halves the table
        self.offset = np.array([np.median(self.projections(self.lifted(sample), t), axis=0) for t in range(TABLES)])
        self.left = functions // 2
        self.bits = [(np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(np.float64) for m in (self.left, functions - self.left)]

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x / self.norm
        return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1, keepdims=True)))], axis=1)

    @staticmethod
    def aimed(q: np.ndarray) -> np.ndarray:
        q = q / np.linalg.norm(q, axis=1, keepdims=True)
        return np.concatenate([q, np.zeros((len(q), 1))], axis=1)

    def projections(self, unit: np.ndarray, table: int) -> np.ndarray:
        return unit @ self.a[table].T

    def codes(self, unit: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """Left and right codes."""
        up = (self.projections(unit, table) >= self.offset[table]).astype(np.int64)
        return up[:, : self.left] @ (1 << np.arange(self.left)), up[:, self.left :] @ (1 << np.arange(self.n - self.left))

    def success(self, aimed: np.ndarray, table: int, cosine: float, lift: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """(queries, left codes) and (queries, right codes): a bucket's two values add up to the logarithm of the estimated
        probability that a neighbour at that angle is in it.

        The neighbour's projection is normal about cosine times the query's, and lift times the added component's, which
        queries don't have; its deviation is what of the sine these leave.
        """
        mean = cosine * self.projections(aimed, table) + lift * self.a[table][:, -1]
        z = (self.offset[table] - mean) / math.sqrt(max(1e-12, 1 - cosine * cosine - lift * lift))
        low = np.clip(_normal(z), 1e-12, 1 - 1e-12)
        off, on = np.log(low), np.log1p(-low)
        cut = [slice(None, self.left), slice(self.left, None)]
        return tuple(off[:, c] @ (1 - b).T + on[:, c] @ b.T for c, b in zip(cut, self.bits))


def _normal(z: np.ndarray) -> np.ndarray:
    """The normal distribution function, to 1e-7 (Abramowitz and Stegun 7.1.26)."""
    x = np.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    erf = 1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-x * x)
    return 0.5 * (1 + np.sign(z) * erf)


def probes(left: np.ndarray, right: np.ndarray, target: float) -> float:
    """How low the sum of a query's left and right values may be, for buckets to be visited in falling order of success
    until it adds up to target. The order is that of perturbations of the query's own bucket; its sums come from
    the two halves, so no bucket is listed."""
    a, b = np.sort(left)[::-1], np.sort(right)[::-1]
    mass, upto = np.exp(a), np.concatenate([[0.0], np.cumsum(np.exp(b))])
    falling = -b
    lo, hi = a[-1] + b[-1], a[0] + b[0]
    if mass @ upto[np.searchsorted(falling, a - hi + SLACK, "right")] >= target:
        return hi - SLACK
    for _ in range(40):  # lo is enough, hi is not
        mid = (lo + hi) / 2
        if mass @ upto[np.searchsorted(falling, a - mid, "right")] >= target:
            lo = mid
        else:
            hi = mid
    return lo - SLACK


def top(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int, allowed: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each query's k best (ids, scores): inner products in double precision, summed in order of the
    components, so that equal vectors have equal scores anywhere; ties go to the smaller id."""
    out = []
    for lo in range(0, len(q), 128):
        s = q[lo : lo + 128] @ x.T
        s[qid[lo : lo + 128, None] == xid[None]] = -np.inf
        if allowed is not None:
            s[~allowed[lo : lo + 128]] = -np.inf
        for i, row in enumerate(s):
            floor = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
            near = np.flatnonzero((row >= floor - SLACK * max(1.0, abs(floor)) if np.isfinite(floor) else np.ones(len(row), bool)) & (row > -np.inf))
            exact = np.zeros(len(near))
            for d in range(x.shape[1]):
                exact += q[lo + i, d] * x[near, d]
            best = np.lexsort((xid[near], -exact))[:k]
            out.append((xid[near][best], exact[best]))
    return out


RESULT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
DDL = "query_id long, vec_id long, score double"


def _results(qid, found) -> pa.RecordBatch:
    n = [len(i) for i, _ in found]
    ids = np.concatenate([i for i, _ in found]) if found else np.zeros(0, np.int64)
    scores = np.concatenate([s for _, s in found]) if found else np.zeros(0)
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, n)), pa.array(ids), pa.array(scores)], schema=RESULT)


def _best(found: DataFrame, k: int) -> DataFrame:
    one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return one.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_search(base: DataFrame, q: np.ndarray, qid: np.ndarray, k: int) -> DataFrame:
    """A few given queries against all vectors (vec_id, v)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield _results(qid, top(q, qid, _matrix(batch.column(1)), batch.column(0).to_numpy(), k))

    return _best(base.mapInArrow(run, DDL), k)


def valid_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(vec_id, v) of usable vectors of the commonest dimension, and that dimension."""
    v = F.col(vec_col).cast("array<double>")
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    base = base.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))
    sizes = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = int(sizes.d) if sizes else 0
    return base.where(F.size("v") == d), d


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest by inner product of every row whose id is divisible by `every`, among all others.

    Every vector is in one bucket of each table; buckets have as many bits as keep them small at any size of the table.
    A query visits buckets in the order of estimated success until TARGET is reached over all tables; the
    estimate's angle comes from CALIBRATION queries that are answered exactly. Buckets lie in blocks of about
    BLOCK vectors by their left codes (a left code with more is split by id), and a query goes to the blocks that
    have a bucket for it. A block with more than QUERY_BLOCK queries meets them in parts. A block gives each
    query its k best visited vectors, the tables' are merged, and scores are exact. Queries that have not found k
    among those visited go on to all blocks.

    Vectors that are null, zero, of another dimension than most, or hold null or non-finite
    components take no part; nor do rows without id. Rows that share an id count as one vector
    with the best of their scores. Fewer candidates than k give fewer rows; no vectors, none.
    Returns query_id, rank, vec_id, score.
    """
    return search(vectors, k, every, id_col, vec_col)[0]


class Visits:
    """How many (query, vector) pairs were scored, of how many."""

    def __init__(self, pairs: int, scored):
        self.pairs, self._scored = pairs, scored

    @property
    def share(self) -> float:
        """In the mean of the tables and after the result has been computed once."""
        return self._scored.value / max(1, self.pairs * TABLES)


def search(vectors: DataFrame, k: int, every: int, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, Visits | None]:
    """nearest, and what it has visited."""
    spark = vectors.sparkSession
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    base, dim = valid_vectors(vectors, id_col, vec_col)
    if not dim:
        return none, None
    total, norm = base.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()
    queries = base.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    drawn = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATION).collect()
    if not drawn:
        return none, None
    sample = base.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id", "v").limit(OFFSETS).collect()
    hashes = Hashes(dim, float(norm), functions_for(total), np.array([r.v for r in sample]))
    dq, di = np.array([r.v for r in drawn]), np.array([r.vec_id for r in drawn])
    near = exact_search(base, dq, di, k).collect()  # k rows for each of CALIBRATION queries
    ends: dict[int, float] = {}
    for r in near:
        ends[r.query_id] = min(ends.get(r.query_id, math.inf), r.score)
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)) / F.lit(float(norm))
    met = base.where(F.col("vec_id").isin(sorted({r.vec_id for r in near}))).agg(F.avg(F.sqrt(F.greatest(F.lit(0.0), 1 - size * size)))).first()[0] if near else 0.0
    lens = dict(zip(di.tolist(), np.linalg.norm(dq, axis=1)))
    cosine = float(np.quantile([s / (norm * lens[i]) for i, s in ends.items()], 1 - QUANTILE)) if ends else 0.0
    cosine = min(max(cosine, 0.0), 0.999999)
    lift = min(float(met or 0.0), math.sqrt(1 - cosine * cosine))
    lefts = 1 << hashes.left

    def coded(batches):
        for batch in batches:
            unit = hashes.lifted(_matrix(batch.column(1)))
            for t in range(TABLES):
                left, right = hashes.codes(unit, t)
                yield pa.RecordBatch.from_arrays([pa.array(left + t * lefts), pa.array(right), batch.column(0), batch.column(1)], names=["left", "right", "vec_id", "v"])

    placed = base.mapInArrow(coded, "left long, right long, vec_id long, v array<double>")
    # one row a left code: TABLES times the root of the number of buckets
    counts = {r["left"]: r.n for r in placed.groupBy("left").agg(F.count("*").alias("n")).collect()}
    first, parts, number, room, table = np.zeros(TABLES * lefts, np.int64), np.ones(TABLES * lefts, np.int64), -1, 0, -1
    for code in sorted(counts):
        n = counts[code]
        if n > BLOCK:
            parts[code] = -(-n // BLOCK)
            first[code], number, room = number + 1, number + int(parts[code]), 0
        else:
            if code // lefts != table or n > room:
                number, room = number + 1, BLOCK
            first[code], room = number, room - n
        table = code // lefts
    used = np.array(sorted(counts), np.int64)
    each = 1 - (1 - TARGET) ** (1 / TABLES)

    def dealt(batches):
        for batch in batches:
            left, i = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            block = first[left] + ((i * 0x9E3779B1) >> 7) % parts[left]
            yield pa.RecordBatch.from_arrays([pa.array(block), *batch.columns], names=["block", "left", "right", "vec_id", "v"])

    def asking(target):
        def run(batches):
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    part = batch.slice(lo, 256)
                    q, ids = _matrix(part.column(1)), part.column(0).to_numpy()
                    aimed, rows = hashes.aimed(q), []
                    for t in range(TABLES):
                        mine = used[used // lefts == t]
                        left, right = hashes.success(aimed, t, cosine, lift)
                        for i in range(len(q)):
                            floor = probes(left[i], right[i], target) if target < 1 else -math.inf
                            near = mine[left[i, mine - t * lefts] + right[i].max() >= floor]
                            for code in np.unique(first[near], return_index=True)[1].tolist():
                                at = near[code]
                                rows += [(int(first[at]) + j, i, floor) for j in range(int(parts[at]))]
                    n = np.array([r[1] for r in rows], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(ids[n]), _list(q[n]) if len(n) else pa.array([], pa.list_(pa.float64())), pa.array([r[2] for r in rows], pa.float64())], names=["block", "query_id", "q", "floor"])

        return run

    scored = spark.sparkContext.accumulator(0)

    def meet(have: pa.Table, ask: pa.Table) -> pa.Table:
        if not have.num_rows or not ask.num_rows:
            return pa.Table.from_batches([], RESULT)
        left, right = have.column("left").to_numpy(), have.column("right").to_numpy()
        order = np.lexsort((right, left))
        left, right = left[order], right[order]
        x, xid = _matrix(have.column("v"))[order], have.column("vec_id").to_numpy()[order]
        t, left = int(left[0]) // lefts, left % lefts
        heads = np.flatnonzero(np.append(True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])))
        size = np.diff(np.append(heads, len(left)))
        q, qid, floor = _matrix(ask.column("q")), ask.column("query_id").to_numpy(), ask.column("floor").to_numpy()
        out = []
        for lo in range(0, len(q), 128):
            part = slice(lo, lo + 128)
            a, b = hashes.success(hashes.aimed(q[part]), t, cosine, lift)
            visit = a[:, left[heads]] + b[:, right[heads]] >= floor[part, None]
            scored.add(int((visit @ size).sum()))
            some = np.repeat(visit.any(axis=0), size)  # buckets that none of these queries visits are left out
            if some.any():
                out.append(_results(qid[part], top(q[part], qid[part], x[some], xid[some], k, np.repeat(visit, size, axis=1)[:, some])))
        return pa.Table.from_batches(out, RESULT)

    have = placed.mapInArrow(dealt, "block long, left long, right long, vec_id long, v array<double>")

    def visited(queries: DataFrame, target: float) -> DataFrame:
        # probing is work of the queries alone, so it is spread by their number
        spread = queries.repartition(max(1, min(4096, -(-queries.count() // 256))), "vec_id")
        ask = cut(spread.mapInArrow(asking(target), "block long, query_id long, q array<double>, floor double"), "ann-probes")
        few = F.broadcast if number < BROADCAST_BLOCKS else (lambda df: df)
        salts = ask.groupBy("block").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("long").alias("salts"))
        ask = ask.join(few(salts), "block").withColumn("salt", F.pmod(F.xxhash64("query_id"), F.col("salts"))).drop("salts")
        copies = have.join(few(salts), "block").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
        return copies.groupBy("block", "salt").cogroup(ask.groupBy("block", "salt")).applyInArrow(meet, DDL)

    found = cut(visited(queries, each), "ann-found")
    most = min(k, base.select("vec_id").distinct().count() - 1)
    enough = found.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n")).where(F.col("n") >= most)
    short = cut(queries.join(enough, queries["vec_id"] == enough["query_id"], "left_anti"), "ann-short")
    if not short.isEmpty():
        found = found.unionByName(visited(short, 1.0))
    return _best(found, k), Visits(int(total) * queries.count(), scored)
