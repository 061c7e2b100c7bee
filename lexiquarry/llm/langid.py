"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold
from .samples import labelled_sample
from .wordbytes import ALNUM, LOWER, NONSPACE, slices

HIDDEN, EPOCHS, BATCH, RATE, SEED = 12, 4, 128, 0.02, 5
#: A text is read in stretches of CORE bytes, each with CONTEXT bytes before it for the network that reads ahead and after
#: it for the one that reads back. A text ends with white space up to a multiple of STEP bytes, and CONTEXT more.
CORE, STEP, CONTEXT = 96, 32, 16
EDGE = 32
LETTER = ALNUM.copy()
LETTER[48:58] = False
#: Documents of each language, documents in all, windows of each language to learn from, and their bytes.
PER_LANG, TOTAL, WINDOWS_PER_LANG, WINDOW = 250, 20_000, 1500, 48
#: Windows without a language for each of one language, and what share of a text's letters may be taken for such.
NONSENSE_PER_LANG, MOST_NONSENSE = 2, 0.7
#: Stretches that are run at once.
STRETCHES = 2048


def _act(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|): like tanh, without an exponential. Its slope is (1 - |y|) squared where y is its value."""
    return x / (1 + np.abs(x))


class GRU:
    """One direction. Inputs are byte numbers, so the input weights are a table of rows. Gates are (1 + act) / 2; the reset
    gate acts on what the state gives to the candidate."""

    def __init__(self, rng, hidden: int):
        self.h = hidden
        self.w = (rng.standard_normal((256, 3 * hidden)) * 0.3).astype(np.float32)
        self.u = (rng.standard_normal((hidden, 3 * hidden)) / hidden**0.5).astype(np.float32)

    def run(self, x: np.ndarray):
        """The state after each of the steps of (n, steps) sequences, in one buffer: forward without a trace. Update
        gate, reset gate and candidate have arrays of their own, so that every operation runs over whole ones."""
        n, k, kind = len(x), self.h, self.w.dtype
        w, u = ([np.ascontiguousarray(m[:, i * k : (i + 1) * k]) for i in range(3)] for m in (self.w, self.u))
        h = np.zeros((n, k), kind)
        z, r, c, g, t = (np.empty((n, k), kind) for _ in range(5))
        for col in np.ascontiguousarray(x.T).astype(np.intp):
            for i, gate in enumerate((z, r)):
                np.take(w[i], col, axis=0, out=gate, mode="clip")
                np.matmul(h, u[i], out=g)
                gate += g
                np.abs(gate, out=t)
                t += 1
                gate /= t
                gate += 1
                gate *= 0.5
            np.take(w[2], col, axis=0, out=c, mode="clip")
            np.matmul(h, u[2], out=g)
            g *= r
            c += g
            np.abs(c, out=t)
            t += 1
            c /= t
            c -= h
            c *= z
            h += c
            yield h

    def forward(self, x: np.ndarray, trace: list | None = None) -> np.ndarray:
        """States of (n, steps) sequences: (steps, n, hidden). trace gets what backward needs."""
        n, k = len(x), self.h
        h = np.zeros((n, k), self.w.dtype)
        out = np.empty((x.shape[1], n, k), self.w.dtype)
        for t in range(x.shape[1]):
            a, g = self.w[x[:, t]], h @ self.u
            zr = (1 + _act(a[:, : 2 * k] + g[:, : 2 * k])) / 2
            z, r = zr[:, :k], zr[:, k:]
            c = _act(a[:, 2 * k :] + r * g[:, 2 * k :])
            if trace is not None:
                trace.append((h, z, r, c, g[:, 2 * k :]))
            h = h + z * (c - h)
            out[t] = h
        return out

    def backward(self, x: np.ndarray, trace: list, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of (w, u) through all steps, last to first."""
        dw, du = np.zeros_like(self.w), np.zeros_like(self.u)
        dh = np.zeros_like(trace[0][0])
        one = np.eye(256, dtype=self.w.dtype)
        gate_slope = lambda y: (1 - np.abs(2 * y - 1)) ** 2 / 2
        for t in range(len(trace) - 1, -1, -1):
            h, z, r, c, gc = trace[t]
            dh = dh + dout[t]
            da_c = dh * z * (1 - np.abs(c)) ** 2
            da_z = dh * (c - h) * gate_slope(z)
            da_r = da_c * gc * gate_slope(r)
            dg = np.concatenate([da_z, da_r, da_c * r], axis=1)
            du += h.T @ dg
            dw += one[x[:, t]].T @ np.concatenate([da_z, da_r, da_c], axis=1)
            dh = dh * (1 - z) + dg @ self.u.T
        return dw, du


class LanguageModel:
    """Two GRUs read from either end; each byte gets label probabilities from both states. With nonsense, a last label
    stands for no language."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, nonsense: bool = False):
        rng = np.random.default_rng(SEED)
        self.langs, self.nonsense = langs, nonsense
        n = len(langs) + nonsense
        self.ahead, self.back = GRU(rng, hidden), GRU(rng, hidden)
        self.out = (rng.standard_normal((2 * hidden, n)) * 0.1).astype(np.float32)
        self.bias = np.zeros(n, np.float32)

    def states(self, x: np.ndarray, traces: tuple | None = None) -> np.ndarray:
        """(steps, n, 2 hidden) of sequences of one length."""
        a = self.ahead.forward(x, traces[0] if traces else None)
        b = self.back.forward(x[:, ::-1], traces[1] if traces else None)[::-1]
        return np.concatenate([a, b], axis=2)

    @staticmethod
    def softmax(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(axis=-1, keepdims=True))
        return z / z.sum(axis=-1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of every position and language: (steps, n, languages)."""
        return self.softmax(self.states(x) @ self.out + self.bias)

    def step(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean cross entropy over positions."""
        traces = ([], [])
        s = self.states(x, traces)
        p = self.softmax(s @ self.out + self.bias)
        p[:, np.arange(len(y)), y] -= 1
        p /= np.float32(p.shape[0] * p.shape[1])
        flat = p.reshape(-1, p.shape[2])
        dout, dbias = s.reshape(len(flat), -1).T @ flat, flat.sum(0)
        ds, k = p @ self.out.T, self.ahead.h
        return [*self.ahead.backward(x, traces[0], ds[:, :, :k]), *self.back.backward(x[:, ::-1], traces[1], ds[::-1, :, k:]), dout, dbias]

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """Adam over batches of windows of one length."""
        rng = np.random.default_rng(SEED)
        params = [self.ahead.w, self.ahead.u, self.back.w, self.back.u, self.out, self.bias]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        total, k = EPOCHS * -(-len(y) // BATCH), 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for lo in range(0, len(y), BATCH):
                rows = order[lo : lo + BATCH]
                k += 1
                rate = RATE * (1 - (k - 1) / total)
                for p, d, mm, vv in zip(params, self.step(x[rows], y[rows]), m, v):
                    mm += 0.1 * (d - mm)
                    vv += 0.01 * (d * d - vv)
                    p -= (rate / (1 - 0.9**k)) * mm / (np.sqrt(vv / (1 - 0.99**k)) + 1e-8)

    def stretches(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the positions of (n, CONTEXT + size + CONTEXT) bytes but for the context: (size, n, languages)."""
        k, size = self.ahead.h, x.shape[1] - 2 * CONTEXT
        z = np.empty((size, len(x), len(self.bias)), np.float32)
        for t, h in enumerate(self.ahead.run(x[:, : CONTEXT + size])):
            if t >= CONTEXT:
                np.matmul(h, self.out[:k], out=z[t - CONTEXT])
        for t, h in enumerate(self.back.run(x[:, : CONTEXT - 1 : -1])):
            if t >= CONTEXT:
                z[size - 1 - (t - CONTEXT)] += h @ self.out[k:]
        z += self.bias
        z -= z.max(axis=2, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=2, keepdims=True)
        return z

    def documents(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Mean label probabilities over all positions of each text that are no white space; zeros without any."""
        return self.pooled(buf, off, NONSPACE)

    def nonsense_of(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Mean probability of no language over each text's letters, whatever the mix of languages; 0 without any."""
        return self.pooled(buf, off, LETTER)[:, len(self.langs)]

    def pooled(self, buf: np.ndarray, off: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Mean probabilities over the positions of each text whose bytes are of a kind."""
        low, lens = LOWER[buf], np.diff(off)
        n = -(-lens // CORE)
        doc = np.repeat(np.arange(len(lens)), n)
        start = off[:-1][doc] + CORE * (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n))
        size = -(-np.minimum(CORE, off[1:][doc] - start) // STEP) * STEP
        sums, count = np.zeros((len(lens), len(self.bias))), np.zeros(len(lens))
        for s in np.unique(size).tolist():
            at = np.flatnonzero(size == s)
            for lo in range(0, len(at), STRETCHES):
                mine = at[lo : lo + STRETCHES]
                pos = start[mine, None] + np.arange(-CONTEXT, s + CONTEXT)
                inside = (pos >= off[:-1][doc[mine], None]) & (pos < off[1:][doc[mine], None])
                x = np.where(inside, low[np.clip(pos, 0, len(low) - 1)], np.uint8(EDGE))
                told = kind[x[:, CONTEXT : CONTEXT + s]]
                p = np.einsum("tnl,nt->nl", self.stretches(x), told.astype(np.float32))
                for j in range(p.shape[1]):
                    sums[:, j] += np.bincount(doc[mine], p[:, j], len(lens))
                count += np.bincount(doc[mine], told.sum(1), len(lens))
        return sums / np.maximum(count, 1)[:, None]


def passages(texts: list[str], n: int, rng) -> list[str]:
    """n passages of up to four windows, of whole words where those are not long."""
    out = []
    for i in rng.integers(0, len(texts), n).tolist():
        t, size = texts[i], int(rng.integers(1, 4 * WINDOW))
        at = int(rng.integers(0, max(1, len(t) - size // 2)))
        first, last = t.rfind(" ", max(0, at - WINDOW), at + 1), t.find(" ", at + size, at + size + WINDOW)
        out.append(t[first + 1 if first >= 0 else at : last if last >= 0 else at + size])
    return out


def gibberish(texts: list[str], rng) -> list[str]:
    """Texts with the white space of those given, by turns of these and of other characters: their own in any order, letters
    and digits, and a stretch of Unicode."""
    out = []
    for i, t in enumerate(texts):
        own = [c for c in t if not c.isspace()]
        if i % 2 == 0:
            other = [own[k] for k in rng.permutation(len(own)).tolist()]
        else:
            low = int(rng.integers(0xC0, 0xD000))
            plain = ("abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz0123456789", "abcdef0123456789")[int(rng.integers(3))]
            alphabet = plain if i % 4 == 1 else [chr(c) for c in range(low, low + int(rng.integers(16, 2048)))]
            other = [alphabet[k] for k in rng.integers(0, len(alphabet), len(own)).tolist()]
        each = iter(other)
        out.append("".join(c if c.isspace() else next(each) for c in t))
    return out


def numbered(texts: list[str], rng) -> list[str]:
    """The texts, every other one with numbers between its words: these tell neither language nor nonsense."""
    out = []
    for i, t in enumerate(texts):
        words = t.split(" ")
        for _ in range(int(rng.integers(1, 4)) if i % 8 < 4 else 0):
            number = "".join(("0123456789" * 3 + ".-+")[k] for k in rng.integers(0, 33, int(rng.integers(1, 20))).tolist())
            words.insert(int(rng.integers(0, len(words) + 1)), number)
        out.append(" ".join(words))
    return out


def train(sample: list[tuple[str, str]], nonsense: bool = False) -> LanguageModel | None:
    """From (language, text): windows of each language's texts that start anywhere in them, or up to CONTEXT bytes before.
    With nonsense, also of texts that have no language."""
    langs = sorted({lang for lang, _ in sample})
    if not langs:
        return None
    rng = np.random.default_rng(SEED)
    xs, ys = [], []
    groups = [([t for name, t in sample if name == lang], WINDOWS_PER_LANG) for lang in langs]
    if nonsense:
        # short passages, of languages too: else the end of a text would tell
        draw = np.random.default_rng(SEED)
        groups = [(passages(texts, n, draw), n) for texts, n in [*groups, ([t for _, t in sample], NONSENSE_PER_LANG * WINDOWS_PER_LANG)]]
        groups[-1] = gibberish(groups[-1][0], draw), groups[-1][1]
        groups = [(numbered(texts, draw), n) for texts, n in groups]
    for k, (texts, windows) in enumerate(groups):
        texts = [t.encode(errors="ignore") for t in texts]
        edge = bytes([EDGE])
        low = LOWER[np.frombuffer(b"".join(edge * CONTEXT + t + edge * WINDOW for t in texts), np.uint8)]
        last = np.cumsum([CONTEXT + len(t) + WINDOW for t in texts])
        first = last - np.array([CONTEXT + len(t) + WINDOW for t in texts])
        room = np.cumsum([CONTEXT + max(len(t) - WINDOW // 2, 1) for t in texts])
        for spot in rng.integers(0, int(room[-1]), windows).tolist():
            i = int(np.searchsorted(room, spot, "right"))
            at = int(first[i]) + spot - (int(room[i - 1]) if i else 0)
            xs.append(low[at : at + WINDOW])
            ys.append(k)
    model = LanguageModel(langs, nonsense=nonsense)
    if len(groups) > 1:
        model.fit(np.array(xs), np.array(ys))
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, nonsense: bool = False) -> LanguageModel | None:
    """Learns from text and language of rows whose crc32(id as text) mod 3 is not 1; with nonsense, also what is no language."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("label"))
    return train(labelled_sample(base.select("id", "text"), base.where(fold(F.col("id"), 3) != 1).select("id", "label"), per_lang, TOTAL), nonsense)


def identify(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang_pred") -> DataFrame:
    """The language of every whole text: id, held_out, lang_pred, score.

    Every byte gets label probabilities; a document's are their mean. The largest is its language,
    ties going to the first by name, and its score. Null texts and texts without a letter, or any
    text if nothing was learned, are `und` with score 0. Repeated rows are labelled each.
    """

    def run(batches):
        for batch in batches:
            p = [model.documents(buf, off) for _, buf, off in slices(batch.column(3))] if model else []
            p = np.concatenate(p)[:, : len(model.langs)] if p else np.zeros((batch.num_rows, 1))
            letter = batch.column(2).to_numpy(zero_copy_only=False).astype(bool) & (model is not None)
            best = p.argmax(axis=1)
            names = [model.langs[b] if ok else "und" for b, ok in zip(best.tolist(), letter.tolist())]
            score = np.where(letter, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score)], names=[id_col, "held_out", lang_col, "score"])

    text = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(fold(F.col(id_col), 3) == 1, F.lit(False)).alias("held_out"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letter"), text.alias(text_col))
    return base.mapInArrow(run, f"{id_col} long, held_out boolean, {lang_col} string, score double")


def accepted(docs: DataFrame, model: LanguageModel | None, most: float = MOST_NONSENSE, text_col: str = "text") -> DataFrame:
    """Rows of docs, unchanged, that have languages: not null, with a letter, and, if the model knows nonsense, with letters
    that are nonsense with a mean probability of `most` or less. A text may mix languages."""
    letter = "_has_letter"
    while letter in docs.columns:
        letter += "_"
    at, flag = docs.columns.index(text_col), len(docs.columns)

    def run(batches):
        for batch in batches:
            ok = batch.column(flag).to_numpy(zero_copy_only=False).astype(bool) & (model is not None)
            if model and model.nonsense and batch.num_rows:
                ok &= np.concatenate([model.nonsense_of(buf, off) for _, buf, off in slices(batch.column(at))]) <= most
            yield batch.filter(pa.array(ok)).select(range(flag))

    return docs.withColumn(letter, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))).mapInArrow(run, docs.schema)
