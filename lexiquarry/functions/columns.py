"""Column expressions: vectors, scores, n-gram keys and sequences. All of them run in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Base of the soft minimum.
SOFTMIN_BASE = 1e4
#: Bits of a token id in a packed key, and tokens in a key.
ID_BITS, GRAM = 20, 12


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column | str) -> Column:
    """v / (|v| + 1e-12)."""
    length = F.sqrt(dot(v, v)) + F.lit(1e-12)
    return F.transform(col(v), lambda x: x.cast("double") / length)


def similarity(a: Column | str, b: Column | str) -> Column:
    """Inner product, 0 at least."""
    return F.greatest(dot(a, b), F.lit(0.0))


def softmin_cost(sim: Column) -> Column:
    """What a similarity adds: softmin is 1 - log_A(1 + the sum of these)."""
    return F.pow(F.lit(SOFTMIN_BASE), F.lit(1.0) - sim) - F.lit(1.0)


def softmin_of_cost(cost: Column) -> Column:
    return F.lit(1.0) - F.log(SOFTMIN_BASE, F.lit(1.0) + cost)


def softmin(*sims: Column | str) -> Column:
    """Associative soft minimum of any number of similarities; 1 for none."""
    costs = [softmin_cost(col(s)) for s in sims]
    return softmin_of_cost(reduce(lambda a, b: a + b, costs, F.lit(0.0)))


def softmin_fold(sims: Column | str) -> Column:
    """The same over an array."""
    return softmin_of_cost(F.aggregate(col(sims), F.lit(0.0), lambda s, x: s + softmin_cost(x.cast("double"))))


def edit_multiplier(norm: Column | str, coefficient: Column | float) -> Column:
    """What inserting or deleting a word costs: near 1 for words that say little."""
    return F.exp(-col(norm) / (coefficient if isinstance(coefficient, Column) else F.lit(float(coefficient))))


def trio_index(v0: Column | str, v1: Column | str, v2: Column | str, t: int) -> Column:
    """Dense number of a triple with v0 + v1 + v2 < t: one of t (t + 1) (t + 2) / 6, in whole numbers throughout."""
    a, b, c = (col(x).cast("long") for x in (v0, v1, v2))
    div = lambda x, y: F.call_function("div", x, F.lit(y).cast("long"))
    rest = F.lit(t).cast("long") + 2 - a
    below = F.lit(t * (t + 1) * (t + 2) // 6).cast("long") - div(rest * (rest - 1) * (rest - 2), 6)
    return below + b * (F.lit(t).cast("long") - a) - div(b * (b - 1), 2) + c


def gram_key(*tokens: Column | str) -> Column:
    """Ids of 20 bits, packed: a hex string that sorts as the ids do."""
    return F.concat(*[F.lpad(F.hex(col(t).cast("long")), ID_BITS // 4, "0") for t in tokens])


def gram_token(key: Column | str, k: int) -> Column:
    """The k-th id of a packed key."""
    return F.conv(F.substring(col(key), 1 + k * ID_BITS // 4, ID_BITS // 4), 16, 10).cast("int")


def contains_run(a: Column | str, b: Column | str) -> Column:
    """Whether array b stands contiguously in array a; the empty array does."""
    a, b = col(a), col(b)
    return (F.size(b) == 0) | ((F.size(a) >= F.size(b)) & F.exists(F.sequence(F.lit(1), F.greatest(F.size(a) - F.size(b) + 1, F.lit(1))), lambda i: F.slice(a, i, F.size(b)) == b))


def sorted_place(arr: Column | str, value: Column | str) -> Column:
    """First place of a value in an array from 0, -1 if it isn't there."""
    return (F.array_position(col(arr), col(value)) - 1).cast("int")


def byte_find(text: Column | str, part: Column | str) -> Column:
    """Byte place of the first occurrence, -1 if there is none."""
    at = F.instr(col(text), col(part)) if isinstance(part, str) is False else F.expr(f"instr({text}, {part})")
    return F.when(at == 0, -1).otherwise(F.octet_length(F.substring(col(text), F.lit(1), at - 1)))


def sequence_hash(seq: Column | str) -> Column:
    return F.xxhash64(col(seq))


def format_eta(seconds: float) -> str:
    """h:mm:ss, or mm:ss under an hour."""
    s = max(0, int(seconds))
    return f"{s // 3600}:{s % 3600 // 60:02d}:{s % 60:02d}" if s >= 3600 else f"{s // 60:02d}:{s % 60:02d}"
