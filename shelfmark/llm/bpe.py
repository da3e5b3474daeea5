"""Byte-level BPE encoding and decoding with padded numpy matrices.

The split pattern cuts a text into pieces. Pieces that a worker has not met before are encoded together: those of
about equal length form a matrix with one row per piece, padded on the right. Each round looks up the rank of every
adjacent pair, every row merges its leftmost pair of least rank, and rows without a pair left are compacted away. Pair
ranks come from an open-addressing hash table over (left id, right id); after a merge only the two pairs beside it are
looked up anew. Pieces longer than ``LONGEST_ROW`` bytes, where a matrix would be mostly padding, are merged with a
heap, which takes the same pairs in the same order.

The vocabulary is a file of ranks whose path is a parameter; nothing is trained here.

Defined results: null and empty texts have no tokens and decode to nothing; texts are strings of valid UTF-8, so decoding gives
back exactly the text (invalid bytes, which Spark's strings may hold, become U+FFFD first); repeated rows give repeated results, an empty table an empty one. Work is per row, without a
shuffle, and a text is never cut.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import slices, table

LONGEST_ROW = 256
#: Pieces a worker remembers before it starts afresh; bounds its memory.
REMEMBERED = 400_000
NONE = np.int32(2**31 - 1)
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


class PairTable:
    """Hash table from pairs of ids to the rank of their merger."""

    MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(4, (3 * len(pairs)).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.values = np.full(size, NONE, np.int32)
        left = np.array([a << 32 | b for a, b in pairs], np.int64)
        rank = np.array(list(pairs.values()), np.int32)
        slot = self._home(left)
        self.probes = 0
        while len(left):  # each round one key takes each free slot, the others move on by one
            self.probes += 1
            free = self.keys[slot] == -1
            _, first = np.unique(slot, return_index=True)
            wins = np.zeros(len(left), bool)
            wins[first] = True
            wins &= free
            self.keys[slot[wins]], self.values[slot[wins]] = left[wins], rank[wins]
            left, rank, slot = left[~wins], rank[~wins], (slot[~wins] + 1) & (size - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * self.MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE for those that do not merge; a negative id is padding."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        out = np.full(keys.shape, NONE, np.int32)
        open_ = np.nonzero(((left >= 0) & (right >= 0)).ravel())[0]
        flat, result = keys.ravel(), out.ravel()
        slot = self._home(flat[open_])
        for _ in range(self.probes):
            there = self.keys[slot]
            hit = there == flat[open_]
            result[open_[hit]] = self.values[slot[hit]]
            on = ~hit & (there != -1)
            open_, slot = open_[on], (slot[on] + 1) & (len(self.keys) - 1)
            if not len(open_):
                break
        return result.reshape(keys.shape)


class Encoder:
    """Encodes and decodes by the ranks of one vocabulary."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        self.bytes_of = [b""] * (max(self.rank.values()) + 1)
        for token, i in self.rank.items():
            self.bytes_of[i] = token
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        self.pairs = {
            (a, b): i for token, i in self.rank.items() for k in range(1, len(token)) if (a := self.rank.get(token[:k])) is not None and (b := self.rank.get(token[k:])) is not None
        }
        self.table = PairTable(self.pairs)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.start, self.length, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _matrix(self, rows: list[bytes], width: int) -> list[np.ndarray]:
        ids = np.full((len(rows), width), -1, np.int32)
        lengths = np.array([len(r) for r in rows])
        inside = np.arange(width) < lengths[:, None]
        ids[inside] = self.single[np.frombuffer(b"".join(rows), np.uint8)]
        rank = self.table.ranks(ids[:, :-1], ids[:, 1:])
        active, done = np.arange(len(rows)), [np.zeros(0, np.int32)] * len(rows)
        while len(active):
            at = rank.argmin(axis=1)  # the first of the least: leftmost
            best = rank[np.arange(len(active)), at]
            over = best == NONE
            if over.any():
                for k in np.nonzero(over)[0]:
                    done[active[k]] = ids[k, : lengths[k]].copy()
                ids, rank, lengths, active, at, best = (x[~over] for x in (ids, rank, lengths, active, at, best))
                if not len(active):
                    break
            n = np.arange(len(active))
            ids[n, at] = best
            column = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, column + (column > at[:, None]), axis=1)
            if ids.shape[1] == 1:
                rank = np.full((len(active), 1), NONE, np.int32)
            else:
                rank = np.take_along_axis(rank, column[:-1] + (column[:-1] >= at[:, None]), axis=1)
                for near in (at - 1, at):
                    ok = (near >= 0) & (near < ids.shape[1] - 1)
                    rank[n[ok], near[ok]] = self.table.ranks(ids[n[ok], near[ok]], ids[n[ok], near[ok] + 1])
            lengths = lengths - 1
        return done

    def _long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece, with a heap of (rank, position) over a linked list."""
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        after, before = [*range(1, len(ids)), -1], list(range(-1, len(ids) - 1))
        heap = [(r, k) for k in range(len(ids) - 1) if (r := self.pairs.get((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            if ids[k] < 0 or (j := after[k]) < 0 or self.pairs.get((ids[k], ids[j])) != r:
                continue
            ids[k], ids[j] = r, -1
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for p, q in ((before[k], k), (k, after[k])):
                if p >= 0 and q >= 0 and (s := self.pairs.get((ids[p], ids[q]))) is not None:
                    heapq.heappush(heap, (s, p))
        return np.array([i for i in ids if i >= 0], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece by itself."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            whole = self.rank.get(piece)
            if whole is not None:
                out[k] = np.array([whole], np.int32)
            elif len(piece) > LONGEST_ROW:
                out[k] = self._long(piece)
            else:
                width = len(piece) if len(piece) <= 32 else 1 << (len(piece) - 1).bit_length()
                buckets.setdefault(width, []).append(k)
        for width, members in buckets.items():
            for k in range(0, len(members), 65_536):
                part = members[k : k + 65_536]
                for m, ids in zip(part, self._matrix([pieces[m] for m in part], width), strict=True):
                    out[m] = ids
        return out

    def _learn(self, pieces: list[str]) -> None:
        ids = self.encode_pieces([p.encode("utf-8", "surrogatepass") for p in pieces])
        length = np.array([len(x) for x in ids], np.int64)
        start = len(self.flat) + np.cumsum(length) - length
        for p in pieces:
            self.known[p] = len(self.known)
        self.start, self.length = np.concatenate([self.start, start]), np.concatenate([self.length, length])
        self.flat = np.concatenate([self.flat, *ids])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. The texts of a call are looked up together; keep them to a few megabytes."""
        if len(self.known) > REMEMBERED:
            self._forget()
        split = [self.pattern.findall(t) for t in texts]
        fresh = {p for pieces in split for p in pieces}.difference(self.known)
        if fresh:
            self._learn(sorted(fresh))
        out, known = [], self.known
        for pieces in split:
            at = np.fromiter((known[p] for p in pieces), np.int64, len(pieces))
            n = self.length[at]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            out.append(self.flat[np.repeat(self.start[at] - (ends - n), n) + np.arange(total)])
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a sequence of ids."""
        of = self.bytes_of
        return b"".join(b"".join([of[i] for i in ids[k : k + 500_000].tolist()]) for k in range(0, len(ids), 500_000))


@cache
def encoder(path: str, pattern: str = public_tokenizers.PATTERN) -> Encoder:
    """One encoder per worker and vocabulary."""
    return Encoder(path, pattern)


Batches = Iterator[pa.RecordBatch]


def _encoding(path: str, text: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for part in slices(batch, text, 2_000_000):
                ids = encoder(path).encode([(x or b"").decode("utf-8", "replace") for x in part.column(text).to_pylist()])
                names = [n for n in part.schema.names if n != text]
                columns = [part.column(n) for n in names]
                n = pa.array([len(x) for x in ids], pa.int64())
                packed = pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([*columns, n, packed], [*names, "n_tokens", "ids"])

    return run


def _decoding(path: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for part in slices(batch, "ids", 4_000_000):
                texts = [encoder(path).decode(np.frombuffer(x or b"", "<u4")) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], [*part.schema.names, "decoded"])

    return run


def _fields(df: DataFrame, without: tuple[str, ...]) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes if n not in without)


def _input(docs: DataFrame, text: str) -> DataFrame:
    return docs.drop("n_tokens", "ids", "decoded").withColumn(text, F.col(text).cast("binary"))


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with the text replaced by ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers)."""
    given = _input(docs, text)
    return given.mapInArrow(_encoding(path, text), f"{_fields(given, (text,))}, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of its ``ids``."""
    given = encoded.drop("decoded")
    return given.mapInArrow(_decoding(path), f"{_fields(given, ())}, decoded binary")


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``decode(encode(docs))`` in one Python worker per task."""
    given = _input(docs, text)
    first, second = _encoding(path, text), _decoding(path)
    return given.mapInArrow(lambda batches: second(first(batches)), f"{_fields(given, (text,))}, n_tokens long, ids binary, decoded binary")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document and digests of the ids and of the decoded bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = round_trip(docs, public_tokenizers.path(VOCABULARY))
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op8_byte_bpe": op8_byte_bpe}
ORACLE_SQL: dict[str, str] = {}
