"""Token ids in directly addressable codes: any token is read without decoding a block.

An id is cut into chunks of 8 bits. Level 0 holds every id's lowest chunk and a bit that says whether
more follow; level 1 the next chunk of the ids that go on, and so forth. The place of a continued
id on the next level is the number of set bits before it, which a rank directory (one count for
each 512 bits) gives in constant time.

File, little-endian: 8 bytes magic, uint64 tokens, documents, levels; per document int64 id, uint8 id
present, and uint64 start (documents + 1 of them); per level uint64 chunks, the chunks, padding to
8, the bitmap in 512-bit blocks, uint64 ranks (blocks + 1).
"""

from __future__ import annotations

import os
import zlib
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import store
from .common import cut, scratch

MAGIC = b"LQDAC\x00\x00\x01"
#: Bytes of text after which a file is closed: what a task holds as codes.
FILE_TEXT_BYTES = 32 << 20
#: A range of ids has about so many bytes of text, and there are MOST_RANGES at most.
RANGE_TEXT_BYTES, MOST_RANGES = 32 << 20, 20_000
STRETCH = 1 << 20
#: Pieces of text whose ids a worker keeps.
MEMO = 800_000


class Writer:
    """Gathers documents' ids as chunks, then gives the file."""

    def __init__(self):
        self.ids: list[int | None] = []
        self.lens: list[np.ndarray] = []
        self.chunks: list[list[np.ndarray]] = []
        self.more: list[list[np.ndarray]] = []

    def add(self, doc_ids: list, lens: np.ndarray, tokens: np.ndarray) -> None:
        self.ids += doc_ids
        self.lens.append(lens)
        rest, level = tokens.astype(np.uint32), 0
        while level == 0 or len(rest):
            if level == len(self.chunks):
                self.chunks.append([])
                self.more.append([])
            go = rest > 255
            self.chunks[level].append((rest & 255).astype(np.uint8))
            self.more[level].append(go)
            rest, level = rest[go] >> 8, level + 1

    @property
    def tokens(self) -> int:
        return int(sum(int(x.sum()) for x in self.lens))

    def parts(self) -> list:
        starts = np.zeros(len(self.ids) + 1, np.uint64)
        if self.ids:
            np.cumsum(np.concatenate(self.lens), out=starts[1:])
        known = np.array([x is not None for x in self.ids], np.uint8)
        out = [MAGIC, np.array([int(starts[-1]), len(self.ids), len(self.chunks)], np.uint64).tobytes()]
        out += [np.array([x or 0 for x in self.ids], np.int64).tobytes(), known.tobytes(), b"\0" * (-len(known) % 8), starts.tobytes()]
        for chunks, more in zip(self.chunks, self.more):
            n = sum(map(len, chunks))
            bits = np.zeros(-(-n // 512) * 64, np.uint8)
            packed = np.packbits(np.concatenate(more), bitorder="little")
            bits[: len(packed)] = packed
            ranks = np.zeros(len(bits) // 64 + 1, np.uint64)
            np.cumsum(np.bitwise_count(bits.view(np.uint64)).reshape(-1, 8).sum(1, dtype=np.uint64), out=ranks[1:])
            out += [np.array([n], np.uint64).tobytes(), *chunks, b"\0" * (-n % 8), bits.tobytes(), ranks.tobytes()]
        return out


class Reader:
    def __init__(self, data):
        data = memoryview(data)
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a token file")
        self.tokens, self.documents, levels = map(int, np.frombuffer(data, np.uint64, 3, 8))
        at = 32

        def take(kind, n):
            nonlocal at
            x = np.frombuffer(data, kind, n, at)
            at += x.nbytes + -x.nbytes % 8
            return x

        ids, known = take(np.int64, self.documents), take(np.uint8, self.documents)
        self.ids = [int(i) if k else None for i, k in zip(ids, known)]
        self.starts = take(np.uint64, self.documents + 1).astype(np.int64)
        self.levels = []
        for _ in range(levels):
            n = int(take(np.uint64, 1)[0])
            chunks = take(np.uint8, n)
            blocks = -(-n // 512)
            self.levels.append((chunks, take(np.uint64, blocks * 8), take(np.uint64, blocks + 1)))

    def access(self, i) -> np.ndarray:
        """The ids at any places, each by one chunk and one rank a level."""
        i = np.asarray(i, np.int64)
        out, live, shift = np.zeros(i.shape, np.uint32), np.arange(i.size), 0
        flat = out.reshape(-1)
        i = i.reshape(-1)
        for chunks, bits, ranks in self.levels:
            if not len(i):
                break
            flat[live] |= chunks[i].astype(np.uint32) << np.uint32(shift)
            word, place = i >> 6, (i & 63).astype(np.uint64)
            go = (bits[word] >> place & np.uint64(1)).astype(bool)
            i, word, place, live = i[go], word[go], place[go], live[go]
            rank = ranks[i >> 9].astype(np.int64)
            for k in range(7):  # whole words before this one in its block
                w = (i >> 9 << 3) + k
                rank += np.where(w < word, np.bitwise_count(bits[np.minimum(w, word)]), 0)
            i = rank + np.bitwise_count(bits[word] & ((np.uint64(1) << place) - np.uint64(1)))
            shift += 8
        return out

    def range(self, lo: int, hi: int) -> np.ndarray:
        """The ids from lo to hi - 1: level by level, as ranks of a run are a run."""
        out, live, shift = np.zeros(hi - lo, np.uint32), None, 0
        for chunks, bits, ranks in self.levels:
            if lo >= hi:
                break
            part = chunks[lo:hi].astype(np.uint32) << np.uint32(shift)
            if live is None:
                out |= part
            else:
                out[live] |= part
            raw = bits.view(np.uint8)[lo >> 3 : (hi + 7) >> 3]
            go = np.unpackbits(raw, bitorder="little")[lo & 7 : (lo & 7) + hi - lo].astype(bool)
            live = np.flatnonzero(go) if live is None else live[go]
            block = lo >> 9
            before = int(ranks[block]) + int(np.bitwise_count(bits.view(np.uint8)[block * 64 : lo >> 3]).sum()) + int(np.bitwise_count(bits.view(np.uint8)[lo >> 3] & np.uint8((1 << (lo & 7)) - 1)))
            lo, hi, shift = before, before + len(live), shift + 8
        return out

    def document(self, k: int) -> np.ndarray:
        return self.range(int(self.starts[k]), int(self.starts[k + 1]))


class Places:
    """A token file read by places: no more than the bytes of the tokens asked for, whatever its size."""

    def __init__(self, uri: str):
        system, path = store.at(uri)
        self.file = system.open_input_file(path)
        if self._at(0, 8) != MAGIC:
            raise ValueError("not a token file")
        self.tokens, self.documents, levels = self._numbers(8, 3)
        self.starts = 32 + 8 * self.documents + -(-self.documents // 8) * 8
        at = self.starts + 8 * (self.documents + 1)
        self.levels = []
        for _ in range(levels):
            n = self._numbers(at, 1)[0]
            chunks, bits = at + 8, at + 8 + -(-n // 8) * 8
            ranks = bits + -(-n // 512) * 64
            self.levels.append((chunks, bits, ranks))
            at = ranks + 8 * (-(-n // 512) + 1)

    def _at(self, offset: int, size: int) -> bytes:
        return self.file.read_at(size, offset)

    def _numbers(self, offset: int, n: int) -> list[int]:
        return np.frombuffer(self._at(offset, 8 * n), np.uint64).tolist()

    def start(self, k: int) -> int:
        """Where the k-th document of the file starts."""
        return self._numbers(self.starts + 8 * k, 1)[0]

    def token(self, i: int) -> int:
        """One byte, one block of the bitmap and one rank a level."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        out = 0
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            out |= self._at(chunks + i, 1)[0] << 8 * level
            block = int.from_bytes(self._at(bits + (i >> 9) * 64, 64), "little")
            if not block >> (i & 511) & 1:
                break
            i = self._numbers(ranks + (i >> 9) * 8, 1)[0] + (block & (1 << (i & 511)) - 1).bit_count()
        return out

    def close(self) -> None:
        self.file.close()


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Byte-level BPE of whole texts, with the ids of pieces seen before kept.

    A text may be cut before a single space between two characters that are no white space: no
    pre-token of a byte-level tokenizer spans such a place, so the pieces' ids are the text's.
    New pieces are encoded as one text of their own, in which each token that starts with a space
    starts a piece. A text with other white space beside a space is encoded whole, as is one that
    holds an added token's content, which the library finds before it cuts pre-tokens.
    """

    def __init__(self, path: str, end: int):
        self.t = _tokenizer(path)
        self.added = [x.content for x in self.t.get_added_tokens_decoder().values()]
        vocab = self.t.get_vocab()
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        self.opens[[i for w, i in vocab.items() if w[0] == "\u0120"]] = True
        self.of: dict[str, int] = {}
        # place 0 is the end id, place 1 stands for pieces that can't stand alone; room is doubled
        self.room = {"flat": np.array([end], np.uint32), "start": np.zeros(2, np.int64), "length": np.array([1, 0], np.int64), "uses": np.zeros(2, np.int64)}
        self.size = {"flat": 1, "start": 2, "length": 2, "uses": 2}

    def __getattr__(self, name: str) -> np.ndarray:
        """flat, start, length and uses: the part of their room in use."""
        if name not in ("flat", "start", "length", "uses"):
            raise AttributeError(name)
        return self.room[name][: self.size[name]]

    def _extend(self, name: str, more: np.ndarray) -> None:
        n, kept = self.size[name] + len(more), self.room[name]
        if n > len(kept):
            self.room[name] = np.empty(2 * n, kept.dtype)
            self.room[name][: self.size[name]] = kept[: self.size[name]]
        self.room[name][self.size[name] : n] = more
        self.size[name] = n

    def _set(self, name: str, value: np.ndarray) -> None:
        self.room[name], self.size[name] = value, len(value)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.t.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _learn(self, new: list[str]) -> None:
        whole = [p for p in new if p and p.strip() == p]
        if len(whole) < len(new):
            self.of.update(dict.fromkeys([p for p in new if not p or p.strip() != p], 1))
        if not whole:
            return
        texts = [" " + " ".join(whole[i : i + 1024]) for i in range(0, len(whole), 1024)]
        ids = np.concatenate([np.array(x, np.uint32) for x in self._ids(texts)])
        heads = np.flatnonzero(self.opens[ids])
        if len(heads) != len(whole):  # another kind of tokenizer: piece by piece
            got = self._ids([" " + p for p in whole])
            lens = np.array([len(x) for x in got], np.int64)
            ids = np.concatenate([np.array(x, np.uint32) for x in got])
        else:
            lens = np.diff(np.append(heads, len(ids)))
        self.of.update(zip(whole, range(len(self.start), len(self.start) + len(whole))))
        self._extend("start", len(self.flat) + np.cumsum(lens) - lens)
        self._extend("length", lens)
        self._extend("flat", ids)
        self._extend("uses", np.zeros(len(whole), np.int64))

    def _forget(self) -> None:
        """Keeps what was used more than once, half of the room at most."""
        keep = self.uses > 1
        if keep.sum() > MEMO // 2:
            keep = self.uses > np.partition(self.uses, -MEMO // 2)[-MEMO // 2]
        keep[:2] = True
        place = np.cumsum(keep) - 1
        self.of = {p: int(place[i]) for p, i in self.of.items() if keep[i] and i > 1}
        start, lens = self.start[keep], self.length[keep]
        total = np.cumsum(lens)
        self._set("flat", self.flat[np.arange(int(total[-1])) + np.repeat(start - (total - lens), lens)])
        self._set("start", total - lens)
        self._set("length", lens)
        self._set("uses", np.zeros(len(lens), np.int64))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids in each text with its end, all ids)."""
        if not texts:
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        if len(self.of) > MEMO:
            self._forget()
        pieces: list[str] = []
        heads, counts = [], []
        for t in texts:
            p = [t] if any(a in t for a in self.added) else t.split(" ")
            heads.append(p[0])
            pieces += p[1:]
            counts.append(len(p) - 1)
        which = np.fromiter(map(self.of.get, pieces, repeat(-1)), np.int64, len(pieces))
        if len(missing := np.flatnonzero(which < 0)):
            names = [pieces[i] for i in missing.tolist()]
            self._learn(list(dict.fromkeys(names)))
            which[missing] = np.fromiter(map(self.of.__getitem__, names), np.int64, len(names))
        used, times = np.unique(which, return_counts=True) if len(which) < len(self.uses) // 8 else (slice(None), np.bincount(which, minlength=len(self.uses)))
        self.uses[used] += times
        counts = np.array(counts, np.int64)
        last = np.cumsum(counts)
        odd = np.add.reduceat(np.append(which == 1, False), last - counts) * (counts > 0) > 0
        odd |= [bool(h) != bool(h.strip()) or h[-1:].isspace() or (not h and c > 0) for h, c in zip(heads, counts)]
        own = self._ids([t if o else h for t, h, o in zip(texts, heads, odd)])
        # each text: its own ids (its head's, or all), then its pieces', then the end
        lens = self.length[which]
        lens[np.repeat(odd, counts)] = 0
        per = np.add.reduceat(np.append(lens, 0), last - counts) * (counts > 0) if len(texts) else last
        first = np.array([len(x) for x in own], np.int64)
        size = first + per + 1
        at = np.cumsum(size) - size
        tokens = np.empty(int(size.sum()), np.uint32)
        tokens[at + size - 1] = self.flat[0]
        run = np.arange(int(first.sum())) - np.repeat(np.cumsum(first) - first, first)
        tokens[run + np.repeat(at, first)] = np.concatenate([np.array(x, np.uint32) for x in own])
        run = np.arange(int(lens.sum()))
        got = self.flat[run + np.repeat(self.start[which] - (np.cumsum(lens) - lens), lens)]
        tokens[run + np.repeat(at + first - (np.cumsum(per) - per), per)] = got
        return size, tokens


@cache
def _encoder(path: str, end: int) -> Encoder:
    """One for each worker process: later tasks find what earlier ones have learned."""
    return Encoder(path, end)


FILES = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("uri", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])
FILES_DDL = "part int, seq int, uri string, docs long, tokens long"


def _write(folder: str, tokenizer: str, end: int, file_bytes: int):
    def run(batches):
        encoder, writer, part, held, done = _encoder(tokenizer, end), Writer(), -1, 0, []

        def close():
            uri = f"{folder}/tokens-{part:06d}-{len(done):06d}.dac"
            store.put(uri, writer.parts())
            done.append((part, len(done), uri, len(writer.ids), writer.tokens))

        for batch in batches:
            ids, lo = batch.column(1).to_pylist(), 0
            while lo < len(ids):
                part, texts, size, hi = batch.column(0)[lo].as_py(), [], 0, lo
                while hi < len(ids) and size < min(4 << 20, file_bytes):
                    texts.append(batch.column(2)[hi].as_py() or "")
                    size += len(texts[-1])
                    hi += 1
                writer.add(ids[lo:hi], *encoder.encode(texts))
                lo, held = hi, held + size
                if held >= file_bytes:
                    close()
                    writer, held = Writer(), 0
        if writer.ids:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*done), FILES)] if done else [pa.array([], t.type) for t in FILES], schema=FILES)

    return run


def _read(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            r = Reader(store.get(uri))
            for lo in range(0, r.documents, 512):
                hi = min(lo + 512, r.documents)
                first = int(r.starts[lo])
                tokens = r.range(first, int(r.starts[hi])).astype("<u4")
                at = r.starts[lo : hi + 1] - first
                crc = [zlib.crc32(tokens[a:b].data) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(r.ids[lo:hi], pa.int64()), pa.array(r.starts[lo:hi] + base), pa.array(np.diff(at)), pa.array(crc, pa.int64())], schema=schema)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end: int = 0, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_TEXT_BYTES) -> DataFrame:
    """Encodes every whole text and writes files in ascending id order; gives (part, seq, uri, docs, tokens).

    Rows go to ranges of ids (null ids first, rows of one id by a hash of the text, equal rows by
    where they came from, so that a repeated id is no hot range). A range's task writes its rows in
    that order and closes a file after file_bytes of text, so it holds one file's codes however
    large the range. Files in order of (part, seq) hold all rows in order. Null and empty texts have the
    end id alone. A file is written under another name and renamed, so tasks can run again.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = int(base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    ranges = max(1, min(MOST_RANGES, -(-size // min(file_bytes, RANGE_TEXT_BYTES))))
    keyed = base.withColumn("h", F.xxhash64("text")).withColumn("origin", F.spark_partition_id())
    dealt = keyed.repartitionByRange(ranges, "id", "h", "origin").sortWithinPartitions("id", "h", "origin")
    placed = dealt.select(F.spark_partition_id().alias("part"), "id", "text")
    return cut(placed.mapInArrow(_write(folder, tokenizer, end, file_bytes), FILES_DDL), "token-files")


def placed_files(written: DataFrame) -> DataFrame:
    """Files with base, the number of tokens in all files before: one sum a range passes through the driver
    (MOST_RANGES at most), the files of a range are summed where they are."""
    sums, base = [], 0
    for r in written.groupBy("part").agg(F.sum("tokens").alias("tokens")).orderBy("part").collect():
        sums.append((r.part, base))
        base += r.tokens
    first = F.broadcast(written.sparkSession.createDataFrame(sums, "part int, _first long"))
    before = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    inside = written.withColumn("_in", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    return inside.join(first, "part").select("part", "seq", "uri", "docs", "tokens", (F.col("_first") + F.col("_in")).alias("base"))


def read_tokens(written: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files."""
    tasks = max(1, min(written.count(), MOST_RANGES))
    files = placed_files(written).select("uri", "base", F.pmod(F.hash("part", "seq"), F.lit(tasks)).alias("task"))
    return files.repartitionById(tasks, F.col("task")).select("uri", "base").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_at(written: DataFrame, places: DataFrame, col: str = "place") -> DataFrame:
    """(place, token): any tokens by their place in the whole store, by bytes of their files alone.

    Places that are null, negative or past the end give no rows; repeated ones theirs each.
    """
    # places and files meet on stretches of STRETCH tokens, so that the join has an equal key
    files = placed_files(written).where("tokens > 0").select("uri", "base", (F.col("base") + F.col("tokens")).alias("end"))
    files = files.withColumn("s", F.explode(F.sequence(F.floor(F.col("base") / STRETCH), F.floor((F.col("end") - 1) / STRETCH))))
    asked = places.select(F.col(col).cast("long").alias("place")).withColumn("s", F.floor(F.col("place") / STRETCH))
    met = asked.join(files, "s").where((F.col("place") >= F.col("base")) & (F.col("place") < F.col("end")))
    schema = pa.schema([("place", pa.int64()), ("token", pa.int64())])

    def run(batches):
        uri, file = None, None
        for batch in batches:
            out = []
            for u, b, p in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if u != uri:
                    if file:
                        file.close()
                    uri, file = u, Places(u)
                out.append(file.token(p - b))
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(out, pa.int64())], schema=schema)
        if file:
            file.close()

    return met.select("uri", "base", "place").sortWithinPartitions("uri", "place").mapInArrow(run, "place long, token long")


def token_store(docs: DataFrame, tokenizer: str, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes every text's ids and reads the documents' places, lengths and checksums back; see write_tokens."""
    out = read_tokens(write_tokens(docs, scratch(docs.sparkSession, "tokens"), tokenizer, end, id_col, text_col))
    return out.withColumnRenamed("doc_id", id_col)
