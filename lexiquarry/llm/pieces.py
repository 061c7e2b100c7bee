"""SentencePiece sampling: forward filtering and backward sampling over the piece lattice."""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordbytes import mix, powers, slices

#: A piece's weight is exp(ALPHA * score), and exp(-34) at least, so that sums over 16 places hold.
ALPHA, LEAST = 0.0005, -34.0
SPACE = 0x2581
#: Stands for a U+2581 of the text itself, so that it isn't taken for a space.
LITERAL = 0x110000
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


class PieceModel:
    """The vocabulary as a trie, with (node, character) -> child in an open-addressing table."""

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        child: dict[tuple[int, int], int] = {}
        piece, self.bytes_of = [-1], []
        byte_ids = np.zeros(256, np.int32)
        inside, scores = set(), []
        cuts = True
        for i in range(sp.vocab_size()):
            text = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(text[3:5], 16)] = i
                self.bytes_of.append(bytes([int(text[3:5], 16)]))
                continue
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
                continue
            self.bytes_of.append(text.replace(chr(SPACE), " ").encode())
            node = 0
            for k, c in enumerate(map(ord, text)):
                if (node, c) not in child:
                    child[node, c] = len(piece)
                    piece.append(-1)
                node = child[node, c]
                cuts = cuts and not (k and c == SPACE and ord(text[k - 1]) != SPACE)
            piece[node] = i
            scores.append((i, sp.get_score(i)))
            if len(text) > 1:
                inside.update(map(ord, text))
        self.piece = np.array(piece, np.int32)
        self.longest = max((len(sp.id_to_piece(i)) for i, _ in scores), default=1)
        self.weight = np.zeros(sp.vocab_size())
        for i, s in scores:
            self.weight[i] = np.exp(max(alpha * s, LEAST))
        self.byte_ids, self.byte_weight = byte_ids, float(np.exp(max(LEAST, alpha * (min((s for _, s in scores if s > -1e6), default=0.0) - 10))))
        self.word_cuts = cuts
        self.joins = np.zeros(LITERAL + 1, bool)
        self.joins[list(inside)] = True
        self.slots = 1 << max(10, (4 * len(child)).bit_length())
        self.keys, self.children = np.full(self.slots, _EMPTY), np.full(self.slots, -1, np.int32)
        todo = np.array([n << 21 | c for n, c in child], np.uint64)
        value = np.array(list(child.values()), np.int32)
        at = self._slot(todo)
        while len(todo):
            free = self.keys[at] == _EMPTY
            _, one = np.unique(np.where(free, at, -1), return_index=True)
            one = one[free[one]]
            self.keys[at[one]], self.children[at[one]] = todo[one], value[one]
            rest = np.ones(len(todo), bool)
            rest[one] = False
            todo, value, at = todo[rest], value[rest], (at[rest] + 1) % self.slots
        size = np.array([len(b) for b in self.bytes_of], np.int64)
        self.byte_len, self.byte_start = size, np.cumsum(size) - size
        self.byte_flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.slots.bit_length() + 1)).astype(np.int64)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Children of the nodes by the characters, -1 where there is none."""
        key = node.astype(np.uint64) << np.uint64(21) | char
        at = self._slot(key)
        out = self.children[at]
        seen = self.keys[at]
        lost = np.flatnonzero(seen != key)
        out[lost] = -1
        lost = lost[seen[lost] != _EMPTY]
        while len(lost):
            at[lost] = (at[lost] + 1) % self.slots
            seen = self.keys[at[lost]]
            hit = seen == key[lost]
            out[lost[hit]] = self.children[at[lost[hit]]]
            lost = lost[~hit & (seen != _EMPTY)]
        return out

    def characters(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(characters, text bounds, UTF-8 lengths): spaces as SPACE, and one before each text."""
        raw = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        count = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[off]
        full = np.diff(count) > 0
        bounds = count + np.concatenate([[0], np.cumsum(full)])
        out = np.full(int(bounds[-1]), SPACE, np.uint32)
        inner = np.ones(len(out), bool)
        inner[bounds[:-1][full]] = False
        out[inner] = np.where(raw == 32, SPACE, np.where(raw == SPACE, LITERAL, raw))
        return out, bounds, 1 + (out > 0x7F).astype(np.int64) + (out > 0x7FF) + ((out > 0xFFFF) & (out < LITERAL))

    def chunks(self, chars: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where lattices start. No piece spans these places: a space after another character (if
        no piece has one there), and either side of a character that stands in no longer piece."""
        n = len(chars)
        head = np.zeros(n, bool)
        head[bounds[:-1][bounds[:-1] < n]] = True
        if self.word_cuts:
            head[1:] |= (chars[1:] == SPACE) & (chars[:-1] != SPACE)
        alone = ~self.joins[chars]
        head |= alone
        head[1:] |= alone[:-1]
        return np.flatnonzero(head)

    def filtered(self, chars: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the place after each character, row by row of the given chunks: the distribution of
        the last piece's length given what goes before (cumulative), and the piece of each length.

        Forward sums are kept for the last `longest` places only and scaled at each step, so long
        chunks neither overflow nor lose weight.
        """
        total = int(lens.sum())
        first = np.cumsum(lens) - lens
        flat = chars[np.repeat(starts - first, lens) + np.arange(total)]
        stop = np.repeat(first + lens, lens)
        found, wide = [], 1
        at, node = np.arange(total), np.zeros(total, np.int64)
        for n in range(1, self.longest + 1):
            node = self.step(node, flat[at + n - 1])
            keep = node >= 0
            at, node = at[keep], node[keep]
            pid = self.piece[node]
            hit = pid >= 0
            if hit.any():
                found.append((n, at[hit] + n - 1, pid[hit]))
                wide = n
            keep = at + n < stop[at]
            at, node = at[keep], node[keep]
            if not len(at):
                break
        weight, piece = np.zeros((total, wide), np.float32), np.full((total, wide), -1, np.int32)
        for n, row, pid in found:
            weight[row, n - 1], piece[row, n - 1] = self.weight[pid], pid
        bare = piece[:, 0] < 0
        weight[bare, 0] = self.byte_weight
        order = np.argsort(-lens, kind="stable")
        ordered, rows = lens[order], first[order]
        past = np.zeros((len(lens), wide))
        past[:, 0] = 1
        for t in range(int(ordered[0]) if len(ordered) else 0):
            m = int(np.searchsorted(-ordered, -t))  # chunks of more than t characters
            run = np.cumsum(past[:m] * weight[rows[:m] + t], axis=1)
            whole = run[:, -1:]
            weight[rows[:m] + t] = run / whole
            moved = np.empty((m, wide))
            moved[:, 1:] = past[:m, :-1]
            moved[:, :1] = whole
            past = moved / whole
        return weight, piece

    def sample(self, buf: np.ndarray, off: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids in each text, all ids): one segmentation of each text, drawn from all of its chunks'.

        The number drawn at a place is a hash of the row's seed and the place, so the result
        depends on neither the batch nor the task.
        """
        if not len(buf):
            return np.zeros(len(off) - 1, np.int64), np.zeros(0, np.int32)
        chars, bounds, utf8 = self.characters(buf, off)
        starts = self.chunks(chars, bounds)
        lens = np.diff(np.append(starts, len(chars)))
        value = (chars.astype(np.uint64) + np.uint64(1)) * powers(int(lens.max()))[np.arange(len(chars)) - np.repeat(starts, lens)]
        h = mix(np.add.reduceat(value, starts) + lens.astype(np.uint64))
        _, one, which = np.unique(h, return_index=True, return_inverse=True)
        cdf, piece = self.filtered(chars, starts[one], lens[one])
        ends = np.cumsum(lens[one])
        doc = np.searchsorted(bounds, starts, "right") - 1
        seed = mix(seeds.view(np.uint64) + np.uint64(0x632BE59BD9B4E019))[doc]
        # backward: from each chunk's end, a piece at a time
        row, place, live = ends[which] - 1, starts + lens - bounds[doc], np.arange(len(starts))
        left = lens.copy()
        text_at = starts + lens
        steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(live):
            u = (mix(seed[live] + place.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
            n = (cdf[row] <= u[:, None]).sum(axis=1)  # the last is 1
            steps.append((live, piece[row, n], text_at[live] - 1))
            n += 1
            left[live] -= n
            text_at[live] -= n
            go = left[live] > 0
            live, row, place = live[go], row[go] - n[go], place[go] - n[go]
        who = np.concatenate([s[0] for s in steps])
        got = np.concatenate([s[1] for s in steps])
        at = np.concatenate([s[2] for s in steps])
        # the last character of a piece tells its place among all pieces of the slice
        slot = np.full(len(chars), -2, np.int32)
        slot[at] = got
        ids = slot[slot > -2]
        where = np.flatnonzero(slot > -2)
        bare = ids < 0
        size = np.where(bare, utf8[where], 1)
        per = np.bincount(np.searchsorted(bounds, where, "right") - 1, size, minlength=len(off) - 1).astype(np.int64)
        if bare.any():
            raw = np.where(chars[where[bare]] == LITERAL, SPACE, chars[where[bare]]).astype(np.uint32)
            tail = np.frombuffer(raw.tobytes().decode("utf-32-le").encode("utf-8"), np.uint8)
            grown = np.repeat(ids, size)
            grown[np.repeat(bare, size)] = self.byte_ids[tail]
            ids = grown
        assert len(who) == len(where)
        return per, ids

    def decode(self, per: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, bytes) of the texts, without the space before each."""
        lens = self.byte_len[ids]
        total = int(lens.sum())
        out = self.byte_flat[np.repeat(self.byte_start[ids] - (np.cumsum(lens) - lens), lens) + np.arange(total)]
        upto = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(per)])]
        keep = np.ones(total, bool)
        full = np.diff(upto) > 0
        keep[upto[:-1][full]] = False
        return upto - np.concatenate([[0], np.cumsum(full)]), out[keep]


@cache
def model(path: str, alpha: float) -> PieceModel:
    return PieceModel(path, alpha)


def segment(docs: DataFrame, path: str, alpha: float = ALPHA, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """A sampled segmentation of every whole text: id, n_pieces, ids_crc32, lossless and, if asked for, ids.

    A segmentation is drawn with a probability in proportion to the product of its pieces' weights;
    the draw is seeded by the row's id, so a row has the same pieces in every run. Text is taken as
    it is, without normalisation, with a space put before it; characters without a piece, and a
    U+2581 of the text's own, become byte pieces. lossless says that the ids, decoded, gave the
    text's bytes again. Null and empty texts have no pieces; null ids share one seed; repeated rows
    have equal pieces. ids_crc32 is that of the ids as little-endian 32-bit integers.
    """
    names = [id_col, "n_pieces", "ids_crc32", "lossless"] + ["ids"] * ids

    def run(batches):
        m = model(path, alpha)
        for batch in batches:
            keys = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, buf, off in slices(batch.column(1)):
                hi = lo + len(off) - 1
                per, got = m.sample(buf, off, keys[lo:hi])
                back_off, back = m.decode(per, got)
                same = np.array_equal(back_off, off) and np.array_equal(back, buf)
                fine = [True] * (hi - lo) if same else [back[a:b].tobytes() == buf[c:d].tobytes() for a, b, c, d in zip(back_off[:-1], back_off[1:], off[:-1], off[1:])]
                upto = np.concatenate([[0], np.cumsum(per)])
                crc = [zlib.crc32(got[a:b].astype("<u4").data) for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]
                out = [batch.column(0).slice(lo, hi - lo), pa.array(per), pa.array(crc, pa.int64()), pa.array(fine, pa.bool_())]
                if ids:
                    out.append(pa.ListArray.from_arrays(upto.astype(np.int32), pa.array(got, pa.int32())))
                yield pa.RecordBatch.from_arrays(out, names=names)

    base = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(run, f"{id_col} long, n_pieces long, ids_crc32 long, lossless boolean" + ", ids array<int>" * ids)


def decode_ids(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from ids; the exact inverse of segment. Null ids give the empty text."""

    def run(batches):
        m = model(path, ALPHA)
        for batch in batches:
            col = batch.column(1)
            per = np.array([0 if x is None else x for x in pa.compute.list_value_length(col).to_pylist()], np.int64)
            off, raw = m.decode(per, col.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            text = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], names=[id_col, "text"])

    return rows.select(F.col(id_col), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, f"{id_col} long, text string")
