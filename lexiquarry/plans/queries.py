"""Registered queries over the test tables, with the SQL that gives the same rows.

The corpus is `documents` in order of doc_id; the vocabulary has as many ids as `embeddings` has
rows. All queries read whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import grams as G
from ..operators import pruning
from ..operators import soft
from ..operators import tokens as TK
from ..operators import vectors as V
from ..operators.kwic import START, STEP
from ..operators.ranges import range_of
from ..operators.tokenizers import LETTERS, SPACES, WORDS
from ..scratch import scratch
from ..sources import text as S
from ..sources.vectors import gather
from ..streaming.counts import token_frequency_stream
from .index import Index, Staged

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Fixed phrases and levels of the registered searches.
PHRASE, SECOND, LOW = "the of", "on the and", 0.20
EVERY = 128
PADDING = 60


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return S.corpus(_table(spark, d, "documents"))


class _Corpus:
    """The plans that several queries share."""

    def __init__(self, spark: SparkSession, d: str, tokenizer=LETTERS):
        self.docs = _docs(spark, d)
        self.vectors = _table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
        self.cap = self.vectors.count()
        self.words = TK.document_tokens(self.docs, tokenizer)
        self.rows = TK.token_rows(self.words)

    @property
    def vocab(self):
        return TK.vocabulary(self.rows, self.cap)

    @property
    def stream(self):
        return TK.token_stream(self.words, self.vocab, self.cap)

    @property
    def windows(self):
        return G.windows(self.stream, self.cap)

    @property
    def weighted(self):
        return V.weighted_vectors(self.vectors, TK.token_frequency(self.stream))


_BUILT: dict[tuple[str, str], Index] = {}


def _index(spark: SparkSession, d: str) -> Index:
    """The compact index of a folder's tables, of which each is built once, when it is asked for, in this application's scratch folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _BUILT:
        _BUILT[key] = Staged(spark, _docs(spark, d), _table(spark, d, "embeddings"), scratch(spark, "index"), LETTERS)
    return _BUILT[key]


_TOK = r"""
tl AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+'), lambda x: lower(x)) AS l FROM documents),
t AS (SELECT doc_id, unnest(l) AS token, unnest(range(len(l))) AS i FROM tl),
cap AS (SELECT count(*) AS c FROM embeddings),
freq AS (SELECT token, count(*) AS n FROM t GROUP BY token),
allv AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) - 1 AS r FROM freq),
voc AS (SELECT CAST(r AS INTEGER) AS tok, token, n FROM allv, cap WHERE r < c - 1),
s AS (SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS pos, doc_id, i, CAST(coalesce(voc.tok, c - 1) AS INTEGER) AS tok FROM t CROSS JOIN cap LEFT JOIN voc USING (token))"""
_WIN = _TOK + """,
g AS (SELECT pos, tok AS t0, """ + ", ".join(f"coalesce(lead(tok, {k}) OVER (ORDER BY pos), CAST((SELECT c FROM cap) - 1 AS INTEGER)) AS t{k}" for k in range(1, 12)) + " FROM s)"
_T = ", ".join(G.T)
_DOT = "list_dot_product({}::DOUBLE[], {}::DOUBLE[])"


# --- sources and tokens -------------------------------------------------------------------------


@query("""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
u AS (SELECT doc_id, unnest(l) AS text, unnest(range(len(l))) AS line_no FROM l)
SELECT doc_id, line_no, text, CAST(coalesce(sum(strlen(text) + 1) OVER (ORDER BY doc_id, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_start FROM u""")
def line_table(spark, d):
    return S.line_table(_docs(spark, d))


@query("SELECT event_id, json_extract_string(props, '$.k') AS text FROM events")
def jsonl_extract(spark, d):
    return S.json_lines(_table(spark, d, "events"), "props", "/k").select("event_id", "text")


@query(r"SELECT CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+|[^\p{L}\p{N}\s]'))) AS BIGINT) AS tokens FROM documents")
def estimate_tokens(spark, d):
    return S.estimate_tokens(_docs(spark, d), WORDS)


@query(r"""
WITH a AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '([^\p{L}\p{N}]*)([\p{L}\p{N}]+)', 1) AS gap, regexp_extract_all(coalesce(text, ''), '([^\p{L}\p{N}]*)([\p{L}\p{N}]+)', 2) AS raw FROM documents),
u AS (SELECT doc_id, unnest(gap) AS gap, unnest(raw) AS raw, unnest(range(len(raw))) AS i FROM a)
SELECT doc_id, CAST(i AS INTEGER) AS tok_idx, lower(raw) AS token, CAST(sum(strlen(gap) + strlen(raw)) OVER (PARTITION BY doc_id ORDER BY i) - strlen(raw) AS BIGINT) AS byte_off FROM u""")
def tokenize_spans(spark, d):
    return TK.token_spans(_docs(spark, d), LETTERS)


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+')) AS BIGINT) AS n_tokens FROM documents")
def token_counts_per_doc(spark, d):
    return TK.token_counts(TK.document_tokens(_docs(spark, d), SPACES))


@query(r"""
WITH w AS (SELECT unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+|[^\p{L}\p{N}\s]'), lambda x: lower(x))) AS token FROM conversations)
SELECT token, count(*) AS freq FROM w GROUP BY token""")
def conversation_words(spark, d):
    """The default tokenizer over another corpus."""
    rows = TK.token_rows(TK.document_tokens(S.corpus(_table(spark, d, "conversations"), "conv_id"), WORDS))
    return rows.groupBy("token").agg(F.count("*").alias("freq"))


# --- vocabulary -----------------------------------------------------------------------------------


@query(f"WITH {_TOK} SELECT tok, token, n AS freq FROM voc")
def vocab_topn(spark, d):
    return _Corpus(spark, d).vocab


@query(f"WITH {_TOK} SELECT pos, doc_id, CAST(i AS INTEGER) AS tok_idx, tok FROM s")
def encode_capped(spark, d):
    return _Corpus(spark, d).stream


@query(f"WITH {_TOK} SELECT s.pos, coalesce(voc.token, '<unk>') AS token FROM s LEFT JOIN voc USING (tok)")
def decode_unk(spark, d):
    c = _Corpus(spark, d)
    return TK.decode(c.stream, c.vocab).select("pos", "token")


@query(f"WITH {_TOK} SELECT tok, count(*) AS freq FROM s GROUP BY tok")
def token_frequency(spark, d):
    return TK.token_frequency(_Corpus(spark, d).stream)


@query(r"""
WITH a AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '([^\p{L}\p{N}]*)([\p{L}\p{N}]+)', 1) AS gap, regexp_extract_all(coalesce(text, ''), '([^\p{L}\p{N}]*)([\p{L}\p{N}]+)', 2) AS raw FROM documents),
u AS (SELECT doc_id, unnest(gap) AS gap, unnest(raw) AS raw, unnest(range(len(raw))) AS i FROM a),
o AS (SELECT doc_id, i, lower(raw) AS token, CAST(sum(strlen(gap) + strlen(raw)) OVER (PARTITION BY doc_id ORDER BY i) - strlen(raw) AS BIGINT) AS byte_off FROM u)
SELECT doc_id, CAST(i AS INTEGER) AS tok_idx, token, byte_off, coalesce(byte_off - lag(byte_off) OVER (PARTITION BY doc_id, i // 256 ORDER BY i), -1) AS delta FROM o""")
def offset_deltas(spark, d):
    return TK.offset_deltas(TK.token_spans(_docs(spark, d), LETTERS)).withColumn("delta", F.coalesce("delta", F.lit(-1).cast("long")))


# --- n-grams ----------------------------------------------------------------------------------------


@query(f"WITH {_WIN} SELECT DISTINCT t0, t1 FROM g")
def bigram_set(spark, d):
    """All pairs of the corpus: the bound is the vocabulary's cap."""
    c = _Corpus(spark, d)
    return G.bigram_set(c.windows, c.cap)


_B = "(SELECT 3 * c FROM cap)"
_TRIO = f"CAST({_B} * ({_B} + 1) * ({_B} + 2) // 6 - ({_B} + 2 - t0) * ({_B} + 1 - t0) * ({_B} - t0) // 6 + t1 * ({_B} - t0) - t1 * (t1 - 1) // 2 + t2 AS BIGINT)"


@query(f"WITH {_WIN} SELECT DISTINCT t0, t1, t2, {_TRIO} AS idx FROM g")
def trigram_set(spark, d):
    """All triples: no sum of three ids reaches three times the cap."""
    c = _Corpus(spark, d)
    return G.trigram_set(c.windows, 3 * c.cap)


@query(f"WITH {_WIN} SELECT {_T}, count(*) AS cnt, min(pos) AS first_pos FROM g GROUP BY {_T}")
def distinct_12grams(spark, d):
    return G.distinct_grams(_Corpus(spark, d).windows)


@query(f"WITH {_WIN} SELECT row_number() OVER (ORDER BY {_T}, pos) - 1 AS rank, pos FROM g")
def suffix_rank(spark, d):
    return G.suffix_ranks(_Corpus(spark, d).windows).select("rank", "pos")


@query(f"WITH {_WIN}, r AS (SELECT row_number() OVER (ORDER BY {_T}, pos) - 1 AS rank, pos, t0, t1, t2 FROM g) SELECT * FROM r WHERE rank % {EVERY} = 0")
def sparse_index(spark, d):
    return G.sparse_index(G.suffix_ranks(_Corpus(spark, d).windows), EVERY).select("rank", "pos", "t0", "t1", "t2")


@query(f"WITH {_WIN} SELECT pos, {' || '.join(f'''lpad(upper(format('{{:x}}', t{k})), 5, '0')''' for k in range(12))} AS key, t11 AS last_tok FROM g")
def gram_keys(spark, d):
    wins = _Corpus(spark, d).windows.select("pos", C.gram_key(*G.T).alias("key"))
    return wins.select("pos", "key", C.gram_token("key", 11).alias("last_tok"))


# --- exact search -----------------------------------------------------------------------------------

_IDS = "(SELECT tok FROM voc WHERE token = '{}')"


@query(f"WITH {_WIN} SELECT count(*) AS match_count FROM g WHERE t0 = {_IDS.format('the')} AND t1 = {_IDS.format('of')}")
def exact_count(spark, d):
    return _index(spark, d).count(PHRASE)


def _patterns(c: _Corpus | Index, spark, d, lengths=(1, 2, 3)) -> DataFrame:
    """(query_id, ids): the first words of each benchmark passage, 1 to 3 of them."""
    words = S.corpus(_table(spark, d, "benchmark"), "item_id").select("doc_id", LETTERS.tokens(F.col("text")).alias("w"))
    each = words.select("doc_id", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("n"), "w").where(F.size("w") >= F.col("n"))
    rows = each.select("doc_id", "n", F.posexplode(F.slice("w", F.lit(1), F.col("n"))).alias("i", "token"))
    ids = TK.encode(rows, c.vocab, c.cap).groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("i", "tok"))).alias("x"))
    return ids.select((F.col("doc_id") * 10 + F.col("n")).alias("query_id"), F.transform("x", lambda x: x["tok"]).alias("ids"))


_PAT = r""",
bl AS (SELECT item_id, list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+'), lambda x: lower(x)) AS l FROM benchmark),
p AS (SELECT item_id, k, [CAST(coalesce(v1.tok, c - 1) AS INTEGER), CAST(coalesce(v2.tok, c - 1) AS INTEGER), CAST(coalesce(v3.tok, c - 1) AS INTEGER)][1:k] AS ids
  FROM bl CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) CROSS JOIN cap LEFT JOIN voc v1 ON v1.token = l[1] LEFT JOIN voc v2 ON v2.token = l[2] LEFT JOIN voc v3 ON v3.token = l[3] WHERE len(l) >= k)"""


@query(f"""WITH {_WIN}{_PAT}, g3 AS (SELECT t0, t1, t2, count(*) AS n FROM g GROUP BY ALL)
SELECT item_id * 10 + k AS query_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS match_count FROM p LEFT JOIN g3 ON t0 = ids[1] AND (k < 2 OR t1 = ids[2]) AND (k < 3 OR t2 = ids[3]) GROUP BY ALL""")
def exact_count_batch(spark, d):
    c = _Corpus(spark, d)
    return G.exact_counts(G.distinct_grams(c.windows), _patterns(c, spark, d))


def _shuffled(c: _Corpus | Index, spark, d) -> DataFrame:
    """Triples some of which occur and some don't: the passages' first ids, and those in reverse."""
    p = _patterns(c, spark, d, (3,))
    both = p.select("query_id", F.explode(F.array("ids", F.reverse("ids"))).alias("ids")).distinct()
    return both.select("query_id", *[F.col("ids")[i].alias(G.T[i]) for i in range(3)])


_SHUF = """, sh AS (SELECT DISTINCT query_id, x[1] AS t0, x[2] AS t1, x[3] AS t2 FROM (SELECT item_id * 10 + k AS query_id, unnest([ids, list_reverse(ids)]) AS x FROM p WHERE k = 3)),
g3 AS (SELECT DISTINCT t0, t1, t2 FROM g)"""


@query(f"WITH {_WIN}{_PAT}{_SHUF} SELECT sh.* FROM sh WHERE EXISTS (SELECT 1 FROM g3 WHERE g3.t0 = sh.t0 AND g3.t1 = sh.t1 AND g3.t2 = sh.t2)")
def prefix_exists(spark, d):
    index = _index(spark, d)
    return G.prefix_exists(index.starts, _shuffled(index, spark, d), 3)


@query(f"WITH {_WIN}{_PAT}{_SHUF} SELECT sh.* FROM sh WHERE NOT EXISTS (SELECT 1 FROM g3 WHERE g3.t0 = sh.t0 AND g3.t1 = sh.t1 AND g3.t2 = sh.t2)")
def prefix_missing(spark, d):
    index = _index(spark, d)
    return G.prefix_missing(index.starts, _shuffled(index, spark, d), 3)


@query(f"""WITH {_WIN}{_PAT}{_SHUF}, g2 AS (SELECT DISTINCT t0, t1, 1 AS hit FROM g), g3b AS (SELECT *, 1 AS hit FROM g3)
SELECT query_id, sh.t0, sh.t1, sh.t2,
  CAST(CASE WHEN sh.t0 >= c // 2 OR sh.t1 >= c // 2 THEN 0 WHEN g2.hit = 1 THEN 2 ELSE 1 END AS INTEGER) AS pair_state,
  CAST(CASE WHEN sh.t0 + sh.t1 + sh.t2 >= c THEN 0 WHEN g3b.hit = 1 THEN 2 ELSE 1 END AS INTEGER) AS triple_state
FROM sh CROSS JOIN cap LEFT JOIN g2 ON g2.t0 = sh.t0 AND g2.t1 = sh.t1 LEFT JOIN g3b ON g3b.t0 = sh.t0 AND g3b.t1 = sh.t1 AND g3b.t2 = sh.t2""")
def ngram_trichotomy(spark, d):
    """Pairs of ids under half of the cap and triples with a sum under the cap are in range."""
    c = _Corpus(spark, d)
    wins, sh = c.windows, _shuffled(c, spark, d)
    below, sum_below = c.cap // 2, c.cap
    pairs = G.pair_state(sh, G.bigram_set(wins, below), below).withColumnRenamed("state", "pair_state")
    return G.triple_state(pairs, G.trigram_set(wins, sum_below), sum_below).withColumnRenamed("state", "triple_state")


@query(f"""WITH {_WIN}, a AS (SELECT t2, count(*) AS cnt FROM g WHERE t0 = {_IDS.format('on')} AND t1 = {_IDS.format('the')} GROUP BY t2)
SELECT {_IDS.format('on')} AS t0, {_IDS.format('the')} AS t1, t2 AS next_tok, cnt FROM a""")
def continuations(spark, d):
    index = _index(spark, d)
    a, b = index.ids(["on", "the"])
    return G.continuations(index.starts, F.broadcast(spark.createDataFrame([(a, b)], "t0 int, t1 int")), 2)  # one row


@query(rf"""WITH {_WIN},
pat AS (SELECT max(tok) FILTER (token = '{PHRASE.split()[0]}') AS a, max(tok) FILTER (token = '{PHRASE.split()[1]}') AS b FROM voc),
hits AS (SELECT pos, row_number() OVER (ORDER BY {_T}, pos) - 1 AS rank FROM g, pat WHERE t0 = a AND t1 = b),
picks AS (SELECT i + 1 AS n, ({START} + {STEP} * i) % (SELECT count(*) FROM hits) AS rank FROM range(10) r(i) WHERE i < (SELECT count(*) FROM hits)),
ends AS (SELECT n, h.pos, a.doc_id AS d1, a.i AS i1, b.doc_id AS d2, b.i AS i2 FROM picks JOIN hits h USING (rank) JOIN s a ON a.pos = h.pos JOIN s b ON b.pos = h.pos + 1),
part AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '([^\p{{L}}\p{{N}}]*)([\p{{L}}\p{{N}}]+)', 1) AS gap, regexp_extract_all(coalesce(text, ''), '([^\p{{L}}\p{{N}}]*)([\p{{L}}\p{{N}}]+)', 2) AS raw
  FROM documents WHERE doc_id IN (SELECT d.doc_id FROM documents d, ends WHERE d.doc_id BETWEEN d1 AND d2)),
doc AS (SELECT doc_id, text, list_transform(range(len(raw) + 1), lambda k: coalesce(list_sum(list_transform(gap[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(raw[1:k], lambda x: length(x))), 0)) AS upto, list_transform(raw, lambda x: length(x)) AS size FROM part),
whole AS (SELECT n, pos, d1, d2, i1, i2, string_agg(text, chr(10) ORDER BY doc_id) AS w, coalesce(sum(length(text) + 1) FILTER (doc_id < d2), 0) AS base FROM ends JOIN doc ON doc_id BETWEEN d1 AND d2 GROUP BY ALL),
cutat AS (SELECT n, pos, w, CAST(a.upto[i1 + 2] - a.size[i1 + 1] AS BIGINT) AS l, CAST(base + b.upto[i2 + 2] AS BIGINT) AS r FROM whole JOIN doc a ON a.doc_id = d1 JOIN doc b ON b.doc_id = d2),
texts AS (SELECT n, pos, left(w, l) AS before, substr(w, l + 1, r - l) AS match, substr(w, r + 1) AS after FROM cutat),
near AS (SELECT n, pos, match, before, after, right(before, list_max(list_filter(range({PADDING} + 1), lambda k: strlen(right(before, k)) <= {PADDING}))) AS lt, left(after, list_max(list_filter(range({PADDING} + 1), lambda k: strlen(left(after, k)) <= {PADDING}))) AS rt FROM texts),
lines AS (SELECT *, ltrim(string_split(lt, chr(10))[-1], ' ') AS ll, rtrim(string_split(rt, chr(10))[1], ' ') AS rl FROM near)
SELECT CAST(n AS INTEGER) AS n, pos, CASE WHEN NOT contains(lt, chr(10)) AND strlen(before) > {PADDING} AND ll <> '' THEN '...' ELSE '' END || ll AS "left",
replace(match, chr(10), ' ') AS match, rl || CASE WHEN NOT contains(rt, chr(10)) AND strlen(after) > {PADDING} AND rl <> '' THEN '...' ELSE '' END AS "right" FROM lines""")
def kwic_sample(spark, d):
    """A fixed sample of hits in context (a top-k report)."""
    return _index(spark, d).contexts(PHRASE, display=10, padding=PADDING)


# --- vectors ----------------------------------------------------------------------------------------


@query(f"SELECT vec_id, i, round(x, 6) AS x FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(list_transform(embedding, lambda x: x::DOUBLE / (sqrt({_DOT.format('embedding', 'embedding')}) + 1e-12))) AS x FROM embeddings)")
def l2_normalize(spark, d):
    out = _table(spark, d, "embeddings").select("vec_id", F.posexplode(C.l2_normalize("embedding")).alias("i", "x"))
    return out.select("vec_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


_PATTERN = [3, 17, 42]


def _pattern_rows(spark, d) -> DataFrame:
    picked = _table(spark, d, "embeddings").where(F.col("vec_id").isin(_PATTERN))
    return picked.select((F.array_position(F.array(*[F.lit(x) for x in _PATTERN]), F.col("vec_id").cast("int")) - 1).cast("int").alias("idx"), "embedding")


_SIM = f"""p AS (SELECT CAST(list_position([3, 17, 42], vec_id) - 1 AS INTEGER) AS idx, embedding AS pe FROM embeddings WHERE vec_id IN (3, 17, 42)),
m AS (SELECT idx, vec_id AS tok, greatest({_DOT.format('pe', 'embedding')}, 0) AS sim FROM p, embeddings)"""


@query(f"WITH {_SIM} SELECT idx, tok, round(sim, 6) AS sim FROM m")
def similarity_matrix(spark, d):
    return V.similarity_matrix(_pattern_rows(spark, d), _table(spark, d, "embeddings")).withColumn("sim", F.round("sim", 6))


@query(f"WITH {_SIM}, r AS (SELECT idx, tok, sim, row_number() OVER (PARTITION BY idx ORDER BY sim DESC, tok) AS rank FROM m WHERE sim >= 0.2 AND tok < (SELECT count(*) FROM embeddings) - 1) SELECT idx, tok, round(sim, 6) AS sim, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def similar_words_topk(spark, d):
    e = _table(spark, d, "embeddings")
    return V.top_similar(V.similar_words(_pattern_rows(spark, d), e, 0.2, e.count()), 10).withColumn("sim", F.round("sim", 6))


_MOM = _TOK + """,
f AS (SELECT tok, count(*) AS n FROM s GROUP BY tok),
wt AS (SELECT tok, n / (SELECT sum(f.n) FROM f JOIN embeddings e ON e.vec_id = f.tok) AS p, embedding::DOUBLE[] AS e FROM f JOIN embeddings ON vec_id = tok),
x AS (SELECT tok, p, unnest(range(64)) AS i, unnest(e) AS v FROM wt),
mu AS (SELECT i, sum(p * v) AS mu FROM x GROUP BY i)"""


@query(f"WITH {_MOM} SELECT CAST(i AS INTEGER) AS i, round(mu, 6) AS mu FROM mu")
def weighted_mean(spark, d):
    return V.weighted_mean(_Corpus(spark, d).weighted).withColumn("mu", F.round("mu", 6))


@query(f"WITH {_MOM}, m2 AS (SELECT a.i, b.i AS j, sum(a.p * a.v * b.v) AS m FROM x a JOIN x b ON a.tok = b.tok GROUP BY ALL) SELECT CAST(m2.i AS INTEGER) AS i, CAST(m2.j AS INTEGER) AS j, round(m - a.mu * b.mu, 6) AS cov FROM m2 JOIN mu a ON a.i = m2.i JOIN mu b ON b.i = m2.j")
def covariance(spark, d):
    return V.covariance(_Corpus(spark, d).weighted).withColumn("cov", F.round("cov", 6))


# Gauss-Jordan elimination: a step clears one column of all other rows of (covariance | identity).
_NORMS = """,
m2 AS (SELECT a.i, b.i AS j, sum(a.p * a.v * b.v) AS m FROM x a JOIN x b ON a.tok = b.tok GROUP BY ALL),
cv AS (SELECT m2.i, m2.j, m - a.mu * b.mu AS cov FROM m2 JOIN mu a ON a.i = m2.i JOIN mu b ON b.i = m2.j),
a0 AS (SELECT i, list_concat(list(cov ORDER BY j), list_transform(range(64), lambda j: CASE WHEN j = i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) AS r FROM cv GROUP BY i),
gj AS (SELECT 0 AS k, i, r FROM a0 UNION ALL
  SELECT o.k + 1, o.i, CASE WHEN o.i = o.k THEN list_transform(o.r, lambda z: z / o.r[o.k + 1])
    ELSE list_transform(range(1, 129), lambda j: o.r[j] - o.r[o.k + 1] / p.r[o.k + 1] * p.r[j]) END
  FROM gj o JOIN gj p ON p.i = o.k WHERE o.k < 64),
inv AS (SELECT i, r[65:128] AS r FROM gj WHERE k = 64),
cen AS (SELECT vec_id AS tok, list_transform(range(1, 65), lambda j: embedding[j]::DOUBLE - ml[j]) AS c FROM embeddings, (SELECT list(mu ORDER BY i) AS ml FROM mu)),
nm AS (SELECT tok, CASE WHEN tok IN (SELECT tok FROM f) THEN sum(c[i + 1] * list_dot_product(r, c)) ELSE 1e20 END AS norm FROM cen, inv GROUP BY tok),
ed AS (SELECT tok, CASE WHEN tok >= 50000 THEN 1e10 ELSE norm END AS norm FROM nm),
hd AS (SELECT row_number() OVER (ORDER BY norm) AS r, norm FROM ed, cap WHERE tok < c // 50),
cut AS (SELECT CASE WHEN 2600 >= (SELECT c // 50 FROM cap) THEN 1e9 ELSE (SELECT max(norm) FROM hd WHERE r <= 2601) END AS cut),
low AS (SELECT row_number() OVER (ORDER BY norm) - 1 AS r, norm FROM ed, cap, cut WHERE tok < c - 1 AND norm <= cut),
coef AS (SELECT norm AS unit FROM low WHERE r = (SELECT least(50, count(*) - 1) FROM low))"""


@query(f"WITH RECURSIVE {_MOM}{_NORMS} SELECT tok, round(norm, 4) AS norm FROM nm")
def whitened_norm(spark, d):
    c = _Corpus(spark, d)
    return V.whitened_norms(c.vectors, TK.token_frequency(c.stream)).withColumn("norm", F.round("norm", 4))


@query(f"WITH RECURSIVE {_MOM}{_NORMS} SELECT tok, round(exp(-norm / (unit * 2 / 5.0)), 6) AS mult FROM ed, coef, cap, cut WHERE tok < c - 1 AND norm <= cut AND exp(-norm / (unit * 2 / 5.0)) >= {LOW}")
def edit_costs(spark, d):
    """Words that may be inserted into a phrase of two, and what that costs."""
    index = _index(spark, d)
    coef, cut = V.coefficient(index.norms, index.cap, 2)
    return V.insert_words(index.norms, index.cap, coef, cut, LOW).select("tok", F.round("mult", 6).alias("mult"))


# --- lookups ------------------------------------------------------------------------------------------


@query(f"WITH {_TOK} SELECT tok, n AS freq, len(embedding) AS dims, round(embedding[1]::DOUBLE, 6) AS x0 FROM voc JOIN embeddings ON vec_id = tok")
def embedding_gather(spark, d):
    """The vectors of the words that occur."""
    c = _Corpus(spark, d)
    rows = gather(c.vocab.select(F.col("tok").cast("long").alias("tok"), "freq"), _table(spark, d, "embeddings"))
    return rows.select(F.col("tok").cast("int").alias("tok"), "freq", F.size("embedding").cast("long").alias("dims"), F.round(F.col("embedding")[0].cast("double"), 6).alias("x0"))


@query("SELECT doc_id, CAST(CASE WHEN instr(coalesce(text, ''), ' the ') = 0 THEN -1 ELSE strlen(left(text, instr(text, ' the ') - 1)) END AS INTEGER) AS at FROM documents")
def byte_find(spark, d):
    return _docs(spark, d).select("doc_id", C.byte_find(F.col("text"), F.lit(" the ")).cast("int").alias("at"))


@query(rf"""WITH l AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}]+'), lambda x: lower(x)) AS l FROM documents),
p AS (SELECT doc_id, list_sort(list_distinct(l)) AS u, len(list_filter(range(1, len(l)), lambda i: l[i] = '{PHRASE.split()[0]}' AND l[i + 1] = '{PHRASE.split()[1]}')) > 0 AS holds FROM l)
SELECT doc_id, holds, CAST(coalesce(list_position(u, '{PHRASE.split()[0]}'), 0) - 1 AS INTEGER) AS place FROM p""")
def sequence_lookups(spark, d):
    """Whether a document holds the phrase, and the place of its first word among the document's sorted words."""
    words = TK.document_tokens(_docs(spark, d), LETTERS)
    phrase = [F.lit(w) for w in PHRASE.split()]
    return words.select("doc_id", C.contains_run(F.col("words"), F.array(*phrase)).alias("holds"), C.sorted_place(F.array_sort(F.array_distinct("words")), phrase[0]).alias("place"))


_BOUNDS = [1 << i for i in range(4, 21)]


@query(f"WITH r AS (SELECT len(list_filter({_BOUNDS}, lambda b: b <= n_chars)) AS range FROM documents) SELECT CAST(range AS INTEGER) AS range, count(*) AS n FROM r GROUP BY range")
def range_histogram(spark, d):
    """Documents by ranges of their length, between doubling bounds."""
    return _table(spark, d, "documents").groupBy(range_of(F.col("n_chars"), _BOUNDS).cast("int").alias("range")).agg(F.count("*").alias("n"))


_NAMED = r"""b AS (SELECT unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+'), lambda x: lower(x))) AS token FROM benchmark),
bn AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) - 1 AS r FROM b GROUP BY token)"""


@query(f"WITH {_TOK}, {_NAMED} SELECT CAST(r AS INTEGER) AS tok, token, n AS freq FROM bn JOIN freq USING (token)")
def named_vocabulary(spark, d):
    """The corpus's words that vectors name; names are those of the benchmark's words."""
    items = S.corpus(_table(spark, d, "benchmark"), "item_id")
    names = TK.vocabulary(TK.token_rows(TK.document_tokens(items, LETTERS)))
    return TK.named_vocabulary(TK.token_rows(TK.document_tokens(_docs(spark, d), LETTERS)), names.select(F.col("tok").alias("vec_id"), F.col("token").alias("word")))


@query(f"WITH {_TOK} SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM t) AS tokens, (SELECT count(*) FROM voc) AS words, (SELECT c FROM cap) AS cap")
def index_report(spark, d):
    """What an index says of itself once it is built."""
    meta = _index(spark, d).report()
    return spark.createDataFrame([(meta["documents"], meta["tokens"], meta["words"], meta["cap"])], "documents long, tokens long, words long, cap long")


@query(r"""WITH a AS (SELECT sum(strlen(coalesce(text, ''))) AS b, sum(len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+|[^\p{L}\p{N}\s]'))) AS n FROM documents)
SELECT CAST(floor(1.3::DOUBLE * b * n / b) AS BIGINT) AS tokens FROM a""")
def token_bound(spark, d):
    """The bound for sizing ahead of a build, with all documents in its sample."""
    return S.token_bound(_docs(spark, d), WORDS, 1.0)


# --- scoring and pruning ------------------------------------------------------------------------------


@query(f"""WITH {_SIM}, a AS (SELECT tok, list(sim ORDER BY idx) AS l FROM m GROUP BY tok)
SELECT tok, round(1 - ln(1 + list_sum(list_transform(l, lambda x: pow(1e4, 1 - x) - 1))) / ln(1e4), 6) + 0.0 AS folded,
  round(1 - ln(pow(1e4, 1 - l[1]) + pow(1e4, 1 - l[2]) - 1) / ln(1e4), 6) + 0.0 AS two FROM a""")
def softmin_fold(spark, d):
    m = V.similarity_matrix(_pattern_rows(spark, d), _table(spark, d, "embeddings"))
    rows = m.groupBy("tok").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "sim"))), lambda x: x["sim"]).alias("l"))
    return rows.select("tok", (F.round(C.softmin_fold("l"), 6) + 0.0).alias("folded"), (F.round(C.softmin(F.col("l")[0], F.col("l")[1]), 6) + 0.0).alias("two"))


@query("""WITH a AS (SELECT l_suppkey, round(l_extendedprice, 2) AS a, round(l_quantity, 2) AS b FROM lineitem)
SELECT DISTINCT l_suppkey, a, b FROM a WHERE NOT EXISTS (SELECT 1 FROM a o WHERE o.l_suppkey = a.l_suppkey AND o.a >= a.a AND o.b >= a.b AND (o.a > a.a OR o.b > a.b))""")
def skyline(spark, d):
    rows = _table(spark, d, "lineitem").select("l_suppkey", F.round(F.col("l_extendedprice").cast("double"), 2).alias("a"), F.round(F.col("l_quantity").cast("double"), 2).alias("b"))
    return pruning.skyline(rows, "l_suppkey", "a", "b")


# A sequence of three has five shorter runs: each is looked up.
_C3 = """, k AS (SELECT t0 AS a, NULL::INTEGER AS b, NULL::INTEGER AS c3, -1e0 * count(*) AS s FROM g GROUP BY ALL
UNION ALL SELECT t0, t1, NULL, -2e0 * count(*) FROM g GROUP BY ALL UNION ALL SELECT t0, t1, t2, -4e0 * count(*) FROM g GROUP BY ALL),
o AS (SELECT *, CASE WHEN c3 IS NOT NULL THEN [a, b, c3] WHEN b IS NOT NULL THEN [a, b] ELSE [a] END AS q FROM k),
one AS (SELECT a, {'s': s, 'q': q} AS o FROM o WHERE b IS NULL), two AS (SELECT a, b, {'s': s, 'q': q} AS o FROM o WHERE b IS NOT NULL AND c3 IS NULL),
j AS (SELECT o.q, o.s, o.c3, o.b, {'s': o.s, 'q': o.q} AS own, x.o AS xa, y.o AS xb, z.o AS xc, u.o AS ab, v.o AS bc FROM o LEFT JOIN one x ON x.a = o.a LEFT JOIN one y ON y.a = o.b LEFT JOIN one z ON z.a = o.c3
  LEFT JOIN two u ON u.a = o.a AND u.b = o.b LEFT JOIN two v ON v.a = o.b AND v.b = o.c3)"""


@query(f"""WITH {_WIN}{_C3} SELECT array_to_string(q, ' ') AS phrase, -s AS score FROM j
WHERE NOT (b IS NOT NULL AND (coalesce(xa < own, false) OR coalesce(xb < own, false))) AND NOT (c3 IS NOT NULL AND (coalesce(xc < own, false) OR coalesce(ab < own, false) OR coalesce(bc < own, false)))""")
def containment_suppress(spark, d):
    """Over all sequences of one to three ids."""
    kept = pruning.suppress_grams(_Corpus(spark, d).windows)
    return kept.select(F.array_join(F.transform("seq", lambda x: x.cast("string")), " ").alias("phrase"), "score")


# --- soft search ----------------------------------------------------------------------------------------

_SOFT2 = f"""WITH {_WIN}, e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / (sqrt({_DOT.format('embedding', 'embedding')}) + 1e-12)) AS v FROM embeddings),
q AS (SELECT token, v FROM voc JOIN e ON vec_id = tok WHERE token IN ('the', 'of')),
sim AS (SELECT token, vec_id AS tok, greatest({_DOT.format('q.v', 'e.v')}, 0) AS sim FROM q, e WHERE vec_id < (SELECT c FROM cap) - 1),
g2 AS (SELECT t0, t1, count(*) AS n FROM g GROUP BY ALL),
r AS (SELECT t0, t1, n, round(1 - ln(1 + (pow(1e4, 1 - a.sim) - 1) + (pow(1e4, 1 - b.sim) - 1)) / ln(1e4), 6) AS score FROM g2
  JOIN sim a ON a.token = 'the' AND a.tok = t0 AND a.sim >= {LOW} JOIN sim b ON b.token = 'of' AND b.tok = t1 AND b.sim >= {LOW})
SELECT w0.token || ' ' || w1.token AS phrase, r.n AS match_count, score FROM r JOIN voc w0 ON w0.tok = t0 JOIN voc w1 ON w1.tok = t1 WHERE score >= {LOW}"""


@query(_SOFT2)
def soft_search_match_only(spark, d):
    index = _index(spark, d)
    ids = index.ids(PHRASE.split())
    pattern = index.vectors.where(F.col("vec_id").isin(ids)).select((F.array_position(F.array(*[F.lit(x) for x in ids]), F.col("vec_id").cast("int")) - 1).cast("int").alias("idx"), "embedding")
    sims = V.similar_words(pattern, index.vectors, LOW, index.cap)
    near = sims.select("idx", "tok").toArrow()  # ids of the vocabulary
    places = [near.column("tok").filter(pc.equal(near.column("idx"), i)).to_pylist() for i in range(2)]
    found = soft.match_only(index.triples_of(places), sims, 2, LOW - 1e-6)
    return soft.render(found, index.vocab).select("phrase", "match_count", F.round("score", 6).alias("score")).where(F.col("score") >= LOW)


def _asked(searches: list[tuple[int, str, float, int | None]]) -> str:
    """SQL of a list of searches (query_id, phrase, level, k)."""
    return "VALUES " + ", ".join(f"({q}, {i}, '{w}', {level}, {len(p.split())}, {k or 'NULL'})" for q, p, level, k in searches for i, w in enumerate(p.split()))


def _soft(ask: str, size: int) -> str:
    """SQL of the soft searches that `ask` gives, of `size` words at most. States (done, gap, cost, mult) of sequences that
    occur grow by a match, an insertion or a deletion, as long as they reach the level."""
    longest = min(12, 4 * size - 3)
    score = "(1 - ln(1 + {c}) / ln(1e4)) * {m}"
    return f"""WITH RECURSIVE {_MOM}{_NORMS},
{_WIN.removeprefix(_TOK).lstrip(", ")},
ask(query_id, i, token, level, size, k) AS ({ask}),
good AS (SELECT query_id FROM ask LEFT JOIN voc USING (token) GROUP BY query_id HAVING bool_and(tok IS NOT NULL)),
e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / (sqrt({_DOT.format('embedding', 'embedding')}) + 1e-12)) AS v FROM embeddings),
pat AS (SELECT query_id, i, level, size, v, exp(-norm / (unit * size / 5.0)) AS drop_by FROM ask JOIN good USING (query_id) JOIN voc USING (token) JOIN e ON vec_id = tok JOIN ed USING (tok), coef),
q AS (SELECT query_id, max(level) AS level, max(size) AS size FROM pat GROUP BY query_id),
tr AS (SELECT query_id, i, vec_id::INTEGER AS tok, pow(1e4, 1 - greatest({_DOT.format('pat.v', 'e.v')}, 0)) - 1 AS add_cost, 1.0::DOUBLE AS fac, 1 AS step FROM pat, e, cap WHERE vec_id IN (SELECT tok FROM voc) AND greatest({_DOT.format('pat.v', 'e.v')}, 0) >= greatest(level, 0.2)
  UNION ALL SELECT query_id, i, tok::INTEGER, 0, exp(-norm / (unit * size / 5.0)), 0 FROM pat, ed, coef, cut WHERE tok IN (SELECT tok FROM voc) AND norm <= cut AND exp(-norm / (unit * size / 5.0)) >= greatest(level, 0.2)
  UNION ALL SELECT query_id, i, NULL, 0, drop_by, 1 FROM pat),
pre AS (SELECT [{_T.replace(" ", "")}][1:k] AS seq, count(*) AS cnt FROM g, (SELECT unnest(range(1, {longest} + 1)) AS k) WHERE t0 IN (SELECT tok FROM tr WHERE step = 1) GROUP BY ALL),
st AS (SELECT query_id, []::INTEGER[] AS seq, 0::BIGINT AS i, 0::BIGINT AS gap, 0.0::DOUBLE AS cost, 1.0::DOUBLE AS mult FROM q
  UNION SELECT st.query_id, CASE WHEN tok IS NULL THEN seq ELSE list_append(seq, tok) END, (st.i + step)::BIGINT, (CASE WHEN step = 0 THEN gap + 1 ELSE 0 END)::BIGINT, (cost + add_cost)::DOUBLE, (mult * fac)::DOUBLE
  FROM st JOIN q ON q.query_id = st.query_id JOIN tr ON tr.query_id = st.query_id AND tr.i = st.i
  WHERE (step = 1 OR (gap < 3 AND len(seq) > 0)) AND {score.format(c="(cost + add_cost)", m="(mult * fac)")} >= level - 1e-12
    AND (tok IS NULL OR list_append(seq, tok) IN (SELECT seq FROM pre))),
f0 AS (SELECT st.query_id, seq, round(max({score.format(c="cost", m="mult")}), 9) AS score FROM st JOIN q ON q.query_id = st.query_id AND i = size WHERE len(seq) > 0 GROUP BY ALL),
runs AS (SELECT query_id, seq, score, unnest(list_distinct(flatten(list_transform(range(1, len(seq) + 1), lambda a: list_transform(range(a, len(seq) + 1), lambda b: seq[a:b]))))) AS run FROM f0),
gone AS (SELECT DISTINCT r.query_id, r.seq FROM runs r JOIN f0 o ON o.query_id = r.query_id AND o.seq = r.run AND r.run <> r.seq WHERE o.score > r.score OR (o.score = r.score AND o.seq < r.seq)),
res AS (SELECT f0.query_id, row_number() OVER (PARTITION BY f0.query_id ORDER BY score DESC, seq) AS rank, score, cnt AS match_count, seq FROM f0 JOIN pre USING (seq) WHERE (f0.query_id, seq) NOT IN (SELECT query_id, seq FROM gone)),
top AS (SELECT * FROM res WHERE rank <= coalesce((SELECT max(k) FROM ask WHERE ask.query_id = res.query_id), 1e18)),
w AS (SELECT query_id, rank, score, match_count, unnest(seq) AS tok, unnest(range(len(seq))) AS nth FROM top)
SELECT query_id, CAST(rank AS INTEGER) AS rank, score, match_count, string_agg(token, ' ' ORDER BY nth) AS phrase FROM w JOIN voc USING (tok) GROUP BY ALL"""


BATCH = [(1, PHRASE), (2, SECOND), (3, "to the of in"), (4, "no-such-word")]


@query(f"SELECT * EXCLUDE (query_id) FROM ({_soft(_asked([(0, PHRASE, 0.30, None)]), 2)})")
def soft_search_full(spark, d):
    """All results at the lowest level, not only the best."""
    return _index(spark, d).search(PHRASE, None, 0.30)


@query(f"SELECT * EXCLUDE (query_id) FROM ({_soft(_asked([(0, SECOND, 0.45, 20)]), 3)})")
def soft_search_topk(spark, d):
    return _index(spark, d).search(SECOND, 20, 0.45)


@query(_soft(_asked([(q, p, 0.45, 20) for q, p in BATCH]), max(len(p.split()) for _, p in BATCH)))
def soft_search_batch(spark, d):
    """Four phrases, one of them unknown, in one pass a level."""
    return _index(spark, d).search_batch(BATCH, 20, 0.45)


_FIRST = r"""SELECT item_id, unnest(range(n)) AS i, l[unnest(range(n)) + 1], 0.45, n, 20
FROM (SELECT item_id, l, least(len(l), 2) AS n FROM (SELECT item_id, list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+'), lambda x: lower(x)) AS l FROM benchmark))"""


@query(_soft(_FIRST, 2))
def soft_search_benchmark(spark, d):
    """The first two words of every benchmark passage, in one batch. An item's phrase passes through the driver."""
    items = _table(spark, d, "benchmark").select("item_id", F.slice(LETTERS.tokens(F.col("text")), 1, 2).alias("w")).where(F.size("w") > 0)
    phrases = [(r.item_id, " ".join(r.w)) for r in items.collect()]
    return _index(spark, d).search_batch(phrases, 20, 0.45)


@query("""WITH w AS (SELECT r, i, CAST('0x' || left(md5(r || '-' || i || '-42'), 8) AS BIGINT) % 4 AS k FROM range(1000) t(r), range(1, 13) u(i))
SELECT CAST(r AS BIGINT) AS line_id, string_agg(['alpha', 'beta', 'gamma', 'delta'][k + 1], ' ' ORDER BY i) AS text FROM w GROUP BY r""")
def synthetic_corpus(spark, d):
    return S.synthetic_lines(spark, 1000, 12, ["alpha", "beta", "gamma", "delta"])


@query(r"WITH w AS (SELECT unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+|[^\p{L}\p{N}\s]'), lambda x: lower(x))) AS token FROM conversations) SELECT token, count(*) AS freq FROM w GROUP BY token")
def streaming_token_frequency(spark, d):
    """The table read as a stream and run to its end."""
    schema = _table(spark, d, "conversations").schema
    docs = S.corpus(spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/conversations.parquet*"), "conv_id")
    name = "stream_token_frequency"
    q = token_frequency_stream(docs).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return soft_search_topk(spark, d)
