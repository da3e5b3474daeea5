"""Token ids in compressed binary files: an adaptive context-mixing range coder.

Ids are cut into blocks that are coded independently: every block starts with an empty model and carries its number of
ids and a CRC-32 of them. Within a block each id is predicted by the one that followed the last two ids (order 2), else by
the one that followed the last id (order 1), each with the length of the run for which that held. Whether the guess is
right is coded as one binary decision. Its probability mixes, in the logistic domain and with weights learned as it goes,
the run of order 2, the run of order 1 (for or against the guess) and the share that order 0 gives to the guess. An id
that is not guessed is coded by order 0: the adaptive frequency of its bucket (highest bit and the two below), then the
bits that the bucket leaves open.

The arithmetic coder has 48 bits of state and writes 16 bits at a time, carries included. All arithmetic is on integers
(divisions of numbers below 2**48 in floating point are exact), so any machine decodes what another has coded. The blocks
of a segment are coded in step, one numpy lane each; what is written for a block does not depend on the others.

Text becomes ids in pieces: the library encodes each distinct piece once, see ``Tokens``.

Files: a table with one row per segment (``part``, ``first``, ``n_ids``, ``doc_ids``, ``counts``, ``blob``), segments in
ascending order of doc_id. A blob is ``SHL2``, then the number of blocks, the number of buckets and for each block the
number of ids, the CRC-32 and the number of 16-bit words (all little-endian unsigned 32-bit integers), then the words.

Defined results: null and empty texts are coded as the end mark alone. Null doc_ids come first, rows of one doc_id in the
order of the 64-bit hash of their texts, then of the texts. A text is never cut: its ids may span any number of blocks.
Damage is reported as an error, not passed on. An empty table gives an empty file and an empty result. Ids have up to 32
bits. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain, repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import slices, stored, table

VOCABULARY = "byte_bpe_50k.json"
END = 2
BLOCK = 1024
LANES = 8192
SEGMENT = BLOCK * LANES
MAGIC = b"SHL2"
#: Pieces a worker remembers before it starts afresh; bounds its memory.
REMEMBERED = 1_000_000

#: Entries of the tables of guesses, and shares of the buckets, of a lane.
SLOTS, TOTAL = 1024, 1024
_X = np.arange(-2047, 2048)
#: The 16-bit probability of log-odds in 1/256: integers, so that every machine has the same.
SQUASH = np.clip(np.round(65536 / (1 + np.exp(-_X / 256))), 32, 65536 - 32).astype(np.int64)


def bucket_of(ids: np.ndarray) -> np.ndarray:
    """The bucket of each id: its highest bit and the two below it. Ids under 8 are buckets of their own."""
    high = np.frexp(np.maximum(ids, 1).astype(np.float64))[1].astype(np.int64) - 1
    return np.where(ids < 8, ids, 4 * high + ((ids >> np.maximum(high - 2, 0)) & 3) - 4)


_ALL = np.arange(bucket_of(np.array([(1 << 32) - 1]))[0] + 1)
#: How many low bits of an id its bucket leaves open, and its least id.
OPEN = np.where(_ALL < 8, 0, _ALL // 4 - 1)
LEAST = np.where(_ALL < 8, _ALL, (4 + _ALL % 4) << OPEN)
_SMALL = bucket_of(np.arange(1 << 17)).astype(np.uint8)
#: 256 times the log-odds of a guess that came true so often in a row (0 to 7), and the same for one that speaks against.
RUN = np.round(256 * np.log((np.arange(8) + 0.4) / 0.6)).astype(np.int64) * (np.arange(8) > 0)
RUN = np.concatenate([RUN, -RUN])
#: 256 times the natural logarithm of a share in 1/TOTAL.
SHARE = np.round(256 * np.log(np.maximum(np.arange(TOTAL + 1), 1) / TOTAL)).astype(np.int64)
#: The places in a block where the shares of the buckets are computed anew.
RENEWED = frozenset(12 * 3**k for k in range(20))


class Model:
    """The adaptive state of a number of lanes. Tables are flat: the part of a lane begins at its number times its size.

    Bucket number ``buckets`` stands for an id that the guess has settled: it takes the whole range and leaves nothing open.
    """

    def __init__(self, lanes: int, buckets: int):
        self.buckets, self.large = buckets, buckets > 60
        lane = np.arange(lanes, dtype=np.int64)
        self.at_slot = np.stack([lane, lane + lanes]) * SLOTS  # of orders 1 and 2
        self.at_bucket, self.at_place = lane * (buckets + 1), lane * TOTAL
        self.guess = np.zeros(2 * lanes * SLOTS, np.int64 if self.large else np.int32)  # id * 8 + run
        self.weight = np.repeat(np.array([[52000], [40000], [8000]], np.int64), lanes, axis=1)
        self.slot, self.s = np.zeros((2, lanes), np.int64), np.zeros((3, lanes), np.int64)
        self.count = np.ones((lanes, buckets), np.int64)
        self.seen: list[np.ndarray] = []
        self.mixed, self.mixed2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.open, self.least = np.append(OPEN[:buckets], 0), np.append(LEAST[:buckets], 0)
        self.renew(False)

    def renew(self, reading: bool) -> None:
        """Turn the counts of buckets into shares of TOTAL, every one at least 1."""
        if self.seen:
            self.count += 16 * np.bincount(np.concatenate(self.seen), minlength=len(self.count) * (self.buckets + 1)).reshape(len(self.count), -1)[:, : self.buckets]
            self.seen.clear()
        width = 1 + self.count * (TOTAL - self.buckets) // self.count.sum(axis=1)[:, None]
        width[np.arange(len(width)), self.count.argmax(axis=1)] += TOTAL - width.sum(axis=1)
        part = (np.cumsum(width, axis=1) - width) << 16 | width  # start and width of each bucket
        self.part = np.concatenate([part, np.full((len(width), 1), TOTAL)], axis=1).ravel()
        self.order0 = np.concatenate([SHARE[width] - 177 * self.open[:-1], np.zeros((len(width), 1), np.int64)], axis=1).ravel()
        if reading:
            self.place = np.repeat(np.tile(np.arange(self.buckets, dtype=np.uint8), len(width)), width.ravel())

    def bucket(self, ids: np.ndarray) -> np.ndarray:
        return bucket_of(ids) if self.large else _SMALL.take(ids, mode="clip")

    def predict(self) -> np.ndarray:
        """The 16-bit probability that the next id is ``self.id``, the guess of order 2, else of order 1; 0 without a guess."""
        slot, s = self.slot, self.s
        np.right_shift(self.mixed, 20, out=slot[0])
        np.right_shift(self.mixed ^ self.mixed2 >> 7, 13, out=slot[1])
        slot &= SLOTS - 1
        slot += self.at_slot
        self.e = self.guess.take(slot, mode="clip")
        self.t, self.g = self.e & 7, self.e >> 3
        (t1, t2), (g1, g2) = self.t, self.g
        self.id = np.where(t2 > 0, g2, g1)
        self.some = (t1 | t2) > 0
        self.guessed = self.bucket(self.id)
        RUN.take(t2, mode="clip", out=s[0])
        RUN.take(t1 + (g1 != self.id) * np.int8(8), mode="clip", out=s[1])
        self.order0.take(self.at_bucket + self.guessed, mode="clip", out=s[2])
        x = (self.weight * s).sum(axis=0)
        x >>= 16
        x += 2047
        self.p = SQUASH.take(x, mode="clip")
        self.p *= self.some
        return self.p

    def learn(self, hit: np.ndarray, ids: np.ndarray, bucket: np.ndarray) -> None:
        """Take note of whether the guess was right and of what the ids are."""
        error = hit * 65536 - self.p
        error *= self.some
        by = self.s * error
        by >>= 14
        self.weight += by
        ids = ids.astype(self.e.dtype, copy=False)
        self.guess[self.slot] = np.where(self.g == ids, self.e + (self.t < 7), ids * 8 + 1)
        self.seen.append(self.at_bucket + bucket)
        self.mixed2, self.mixed = self.mixed, ids.astype(np.int64) * 0x1E3779B1


class Writer:
    """48-bit arithmetic encoder, one per lane, that writes 16 bits at a time."""

    def __init__(self, lanes: int, ids: int):
        self.low, self.range = np.zeros(lanes, np.int64), np.full(lanes, 1 << 48, np.int64)
        self.words = np.zeros(lanes * (size := 4 * ids + 8), np.uint16)
        self.begin = np.arange(lanes) * size
        self.at = self.begin.copy()

    def ready(self, least: int = 1 << 32) -> None:
        """Make room in the ranges below ``least``, 32 bits for all in the end."""
        small = np.flatnonzero(self.range < least)
        if not len(small):
            return
        over = small[self.low[small] >> 48 > 0]
        if len(over):
            self._carry(over)
        while len(small):
            low, width, at = self.low[small], self.range[small] << 16, self.at[small]
            self.words[at] = (low >> 32).astype(np.uint16)
            self.at[small] = at + 1
            self.low[small], self.range[small] = (low & 0xFFFFFFFF) << 16, width
            small = small[width < least]

    def _carry(self, lanes: np.ndarray) -> None:
        self.low[lanes] &= (1 << 48) - 1
        at = self.at[lanes] - 1
        while len(at):
            self.words[at] += 1
            at = at[self.words[at] == 0] - 1

    def close(self, lane: int) -> bytes:
        """The words of a lane, up to the shortest that stand for a number in its range; what follows reads as zeros."""
        self.low[lane] += (1 << 32) - 1
        if self.low[lane] >> 48:
            self._carry(np.array([lane]))
        self.words[self.at[lane]] = self.low[lane] >> 32
        return self.words[self.begin[lane] : self.at[lane] + 1].astype("<u2").tobytes()


class Reader:
    """The decoder of the same."""

    def __init__(self, blobs: list[bytes]):
        lengths = np.array([len(b) // 2 for b in blobs]) + 4  # four zeros follow
        self.words = np.frombuffer(b"".join(b + bytes(8) for b in blobs), "<u2")
        self.at, self.end = np.cumsum(lengths) - lengths + 3, np.cumsum(lengths) - 1
        self.x = sum(self.words[self.at - k - 1].astype(np.int64) << 16 * k for k in range(3))
        self.range = np.full(len(blobs), 1 << 48, np.int64)

    def ready(self, least: int = 1 << 32) -> None:
        small = np.flatnonzero(self.range < least)
        while len(small):
            width, at = self.range[small] << 16, self.at[small]
            self.x[small] = self.x[small] << 16 | self.words[at]
            self.at[small], self.range[small] = np.minimum(at + 1, self.end[small]), width
            small = small[width < least]


def _parts(open_: np.ndarray, large: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The open bits of each lane in parts of 15 at most: how many, and how many follow."""
    for done in range(0, max(1, int(open_.max())) if large else 1, 15):
        few = np.minimum(np.maximum(open_ - done, 0), 15) if large else open_
        yield few, np.maximum(open_ - done - 15, 0) if large else 0


def _encode(grid: np.ndarray, last: int, buckets: int) -> list[bytes]:
    """The coded blocks of a grid of ids, a row each; the last has ``last`` ids."""
    ended = []
    model, to = Model(len(grid), buckets), Writer(*grid.shape)
    rows = np.ascontiguousarray(grid.T)
    for t in range(grid.shape[1]):
        if t in RENEWED:
            model.renew(False)
        ids = rows[t]
        own = model.bucket(ids)
        bound = (to.range >> 16) * model.predict()
        hit = (model.id == ids) & model.some
        miss = ~hit
        bucket = np.where(hit, buckets, own)
        part = model.part.take(model.at_bucket + bucket, mode="clip")
        unit = np.where(hit, bound, to.range - bound) >> 10
        to.low += bound * miss + unit * (part >> 16)
        to.range = unit * (part & 0xFFFF)
        to.ready(1 << 15)
        rest = (ids - model.least.take(bucket, mode="clip")) * miss
        for few, later in _parts(model.open.take(bucket, mode="clip"), model.large):
            to.range >>= few
            to.low += to.range * ((rest >> later) & ((1 << few) - 1) if model.large else rest)
            to.ready()
        model.learn(hit, ids, own)
        if t + 1 == last:
            ended.append(to.close(len(grid) - 1))
    return [to.close(k) for k in range(len(grid) - 1)] + ended


def _decode(blobs: list[bytes], steps: int, buckets: int) -> np.ndarray:
    """The grid of ids of coded blocks."""
    model, of = Model(len(blobs), buckets), Reader(blobs)
    model.renew(True)
    out = np.zeros((steps, len(blobs)), model.guess.dtype)
    for t in range(steps):
        if t in RENEWED:
            model.renew(True)
        bound = (of.range >> 16) * model.predict()
        hit = of.x < bound
        of.x -= bound * ~hit
        unit = np.where(hit, bound, of.range - bound) >> 10
        # Both are below 2**48, so the rounded quotient of floating-point numbers never reaches the next integer.
        place = np.minimum((of.x / unit).astype(np.int64), TOTAL - 1)
        bucket = np.where(hit, buckets, model.place.take(model.at_place + place, mode="clip"))
        part = model.part.take(model.at_bucket + bucket, mode="clip")
        of.x -= unit * (part >> 16)
        of.range = unit * (part & 0xFFFF)
        of.ready(1 << 15)
        rest = 0
        for few, _ in _parts(model.open.take(bucket, mode="clip"), model.large):
            of.range >>= few
            digit = (of.x / of.range).astype(np.int64)
            of.x -= digit * of.range
            rest = rest << few | digit
            of.ready()
        ids = np.where(hit, model.id, model.least.take(bucket, mode="clip") + rest)
        model.learn(hit, ids, np.where(hit, model.guessed, bucket))
        out[t] = ids
    return out.T


def _groups(blocks: int) -> list[tuple[int, int]]:
    """The first block and the number of blocks of each group that is coded in step, of about equal sizes."""
    lanes = -(-blocks // max(1, -(-blocks // LANES))) if blocks else 1
    return [(k, lanes) for k in range(0, blocks, lanes)]


def compress(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """The blob of a sequence of ids."""
    if len(ids) and (ids.min() < 0 or ids.max() >= 1 << 32):
        raise ValueError("ids must be of 32 bits")
    counts = np.array([min(block, len(ids) - k) for k in range(0, len(ids), block)], np.int64)
    sums = [zlib.crc32(ids[k : k + block].astype("<u4").tobytes()) for k in range(0, len(ids), block)]
    buckets = int(bucket_of(ids[ids.argmax() :][:1])[0]) + 1 if len(ids) else 0
    parts: list[bytes] = []
    for k, lanes in _groups(len(counts)):
        own = counts[k : k + lanes]
        grid = np.zeros((len(own), int(own.max())), np.int64 if buckets > 60 else np.int32)  # a shorter last block is filled up with zeros
        grid[np.arange(grid.shape[1]) < own[:, None]] = ids[k * block : k * block + int(own.sum())]
        parts += _encode(grid, int(own[-1]), buckets)
    head = np.array([len(counts), buckets, *(x for c, s, p in zip(counts, sums, parts, strict=True) for x in (c, s, len(p) // 2))], "<u4")
    return MAGIC + head.tobytes() + b"".join(parts)


def expand(blob: bytes) -> np.ndarray:
    """The ids of a blob; raises ValueError if a block does not match its checksum."""
    if blob[:4] != MAGIC or len(blob) < 12:
        raise ValueError("not a token file")
    n, buckets = (int(x) for x in np.frombuffer(blob, "<u4", 2, 4))
    head = np.frombuffer(blob, "<u4", 3 * n, 12).reshape(n, 3).astype(np.int64)
    ends = 12 + 12 * n + 2 * np.cumsum(head[:, 2])
    out = []
    for k, lanes in _groups(n):
        own = head[k : k + lanes]
        blobs = [blob[int(e) - 2 * int(w) : int(e)] for e, w in zip(ends[k : k + lanes], own[:, 2], strict=True)]
        grid = _decode(blobs, int(own[:, 0].max()), buckets)
        for row, (count, crc, _) in zip(grid, own, strict=True):
            ids = row[:count]
            if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
                raise ValueError("a block of the token file is damaged")
            out.append(ids)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


#: Kinds of bytes: nothing known, letter, digit, punctuation, apostrophe, space, other white space, part of another character.
ANY, LETTER, DIGIT, SIGN, MARK, SPACE, BREAK, OTHER = range(8)
_KIND = np.full(256, OTHER, np.uint8)
_KIND[:128] = [LETTER if c.isalpha() else DIGIT if c.isdigit() else SIGN if c.isprintable() else ANY for c in map(chr, range(128))]
_KIND[ord("'")], _KIND[ord(" ")], _KIND[list(b"\t\n\v\f\r")] = MARK, SPACE, BREAK
#: First bytes of two-byte characters that are letters (U+00C0 to U+017F, U+0400 to U+047F), but for the signs of ``_TIMES``.
_KIND[[0xC3, 0xC4, 0xC5, 0xD0, 0xD1]] = LETTER
_TIMES = [0xC397, 0xC3B7]
#: White space beyond ASCII, as the first three bytes of a number; U+180E is white space to some versions of Unicode.
_BLANK = [int.from_bytes(c.encode().ljust(3, b"\0")) for c in "\x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]
#: Where a text can be cut, by the kinds before and after: 1 always, 2 where the byte before is itself cut off.
_CUT = np.zeros((8, 8), np.uint8)
for _before in (LETTER, DIGIT, SIGN, MARK, OTHER):
    _CUT[_before, [SPACE, BREAK]], _CUT[BREAK, _before] = 1, 2
_CUT[LETTER, [DIGIT, SIGN, MARK]] = _CUT[DIGIT, [LETTER, SIGN, MARK]] = _CUT[SIGN, [LETTER, DIGIT]] = _CUT[MARK, DIGIT] = 1
_CUT = _CUT.ravel()
#: A piece that the pattern of the tokenizer takes in one match.
ONE = re.compile(rb" ?(?:(?:[A-Za-z]++|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF]|[\xC4\xC5\xD0\xD1][\x80-\xBF])++|[0-9]++|[!-/:-@\[-`{-~]++)")
#: The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves. Line feeds separate pieces here.
LEVEL = np.arange(256, dtype="<u4")
_MOVED = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
LEVEL[_MOVED] = 256 + np.arange(len(_MOVED))
LEVEL[ord("\n")] = ord("\n")


def cuts(data: np.ndarray) -> np.ndarray:
    """Whether UTF-8 text can be cut after each byte but the last without changing its tokens.

    Cuts are made where no match of the tokenizer's pattern reaches over: between ASCII letters, digits and punctuation (but
    not from an apostrophe to a letter), after what is no white space, and after a single line feed or the like.
    """
    kind = _KIND.take(data)
    at = np.flatnonzero((data >= 0xC2) & (data < 0xE4))
    if len(at):
        after, third = (np.where(at + k < len(data), data[np.minimum(at + k, len(data) - 1)], 0).astype(np.int64) for k in (1, 2))
        lead = data[at].astype(np.int64)
        letter = (kind[at] == LETTER) & ~np.isin(lead << 8 | after, _TIMES)
        kind[at] = np.where(letter, LETTER, OTHER)
        kind[at[letter] + 1] = LETTER
        blank = at[np.isin(lead << 16 | after << 8 | np.where(lead < 0xE0, 0, third), _BLANK)]
        for k in range(3):
            kind[(blank + k)[blank + k < len(data)]] = ANY
    cut = _CUT.take(kind[:-1] << 3 | kind[1:])
    soft = np.flatnonzero(cut == 2)
    cut[soft] = (soft > 0) & (cut[soft - 1] == 1)
    return cut.view(bool)


class Tokens:
    """Encodes texts with a tokenizer of the library, each distinct piece once.

    A byte-level tokenizer never merges over the places of ``cuts``, so the ids of a text are those of its pieces. Arrow finds
    the distinct pieces of a batch, and the numbers of those that are known come from a dictionary. Pieces that the
    tokenizer's pattern takes whole go to the library's merges at once, others to the library as texts. Texts with a string
    that the tokenizer treats as one special token are not cut, nor any text for a tokenizer of another pattern.
    """

    def __init__(self, path: str, end: int):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        whole = json.loads(self.library.to_str())
        before = whole["pre_tokenizer"] or {}
        #: Whether texts are split by the pattern that ``cuts`` and ``ONE`` stand for; else none is cut.
        self.cut = whole["normalizer"] is None and (before.get("type"), before.get("use_regex", True), before.get("add_prefix_space")) == ("ByteLevel", True, False)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.end = end
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.start, self.length, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self._keep([b""], [1], [self.end])  # no piece is empty

    def _keep(self, pieces: list[bytes], lengths: list[int], ids: list[int]) -> None:
        """Remember pieces whose ids stand one after the other in ``ids``."""
        n = np.array(lengths, np.int64)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(n) - n])
        self.length, self.flat = np.concatenate([self.length, n]), np.concatenate([self.flat, np.array(ids, np.int32)])
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces)), strict=True))

    def _learn(self, fresh: list[bytes]) -> None:
        """Learn pieces from the library."""
        ones, others = [], []
        for piece in fresh:
            one = self.cut and ((piece[1:] if piece[0] == 32 else piece).isalpha() or ONE.fullmatch(piece))  # most are of ASCII letters
            (ones if one else others).append(piece)
        lengths, ids = [], []
        for word in LEVEL.take(np.frombuffer(b"\n".join(ones), np.uint8)).tobytes().decode("utf-32-le").split("\n") if ones else ():
            own = self.model.tokenize(word)
            lengths.append(len(own))
            ids += [t.id for t in own]
        self._keep(ones, lengths, ids)
        found = [e.ids for e in self.library.encode_batch_fast([piece.decode() for piece in others], add_special_tokens=False)]
        self._keep(others, list(map(len, found)), list(chain.from_iterable(found)))

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by the end mark, and how many each has."""
        if len(self.known) > REMEMBERED or len(self.flat) > 8 * REMEMBERED:
            self._forget()
        texts = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
        _, at, held = texts.buffers()
        at = np.frombuffer(at, np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(held or b"", np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        bound = np.zeros(len(data) + 1, bool)
        if len(data) and self.cut:
            bound[1:-1] = cuts(data)
        for special in self.special:
            for k in np.flatnonzero(pc.match_substring(texts, special).to_numpy(zero_copy_only=False)):
                bound[at[k] : at[k + 1]] = False
        bound[at] = True
        bound = np.flatnonzero(bound)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bound) - 1, [None, pa.py_buffer(bound), pa.py_buffer(data)]).dictionary_encode()
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False)
        numbers = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(numbers < 0)
        fresh = distinct[new].tolist()
        self._learn(fresh)
        numbers[new] = np.fromiter(map(self.known.__getitem__, fresh), np.int64, len(fresh))
        stops = np.searchsorted(bound, at[1:])
        own = np.insert(numbers[pieces.indices.to_numpy()], stops, 0)  # number 0 is the end mark
        n = self.length[own]
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(self.start[own] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.diff(ends[stops + np.arange(len(stops))], prepend=0)


@cache
def tokens(path: str, end: int) -> Tokens:
    """One encoder per worker and vocabulary."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokens(path, end)


SCHEMA = "part int, first long, n_ids long, doc_ids array<long>, counts array<long>, blob binary"


def write(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """The segments of ``docs``, written in the shared folder: tokenised, in ascending order of doc_id."""
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    order = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, *order).sortWithinPartitions(*order, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, doc_ids, counts, held = TaskContext.get().partitionId(), 0, [], [], []

        def segment() -> pa.RecordBatch:
            ids = np.concatenate(held)
            given = ([part], [first], [len(ids)], [pa.concat_arrays(doc_ids)], [np.concatenate(counts)], [compress(ids)])
            types = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(given, types, strict=True)], ["part", "first", "n_ids", "doc_ids", "counts", "blob"])

        for batch in batches:
            for piece in slices(batch, "text"):
                ids, sizes = tokens(path, end).encode(piece.column("text"))
                doc_ids.append(piece.column("doc_id"))
                counts.append(sizes)
                held.append(ids)
                if (size := sum(map(len, held))) >= SEGMENT:
                    yield segment()
                    first, doc_ids, counts, held = first + size, [], [], []
        if held:
            yield segment()

    return stored(ordered.mapInArrow(run, SCHEMA), "tokens")


def read(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the decoded blobs.

    A segment knows how many ids its partition has before it; one row for each partition adds those of the partitions before.
    """
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                ids = expand(row["blob"].as_py()).astype("<u4")
                counts = row["counts"].values.to_numpy()
                stops = np.cumsum(counts)
                starts = stops - counts
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
                columns = [row["doc_ids"].values, pa.array(starts + row["first"].as_py() + row["before"].as_py()), pa.array(counts), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    joined = segments.join(F.broadcast(before), "part")  # a row for each partition of the files
    return joined.select("first", "before", "doc_ids", "counts", "blob").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of all documents and read them back."""
    return read(write(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(VOCABULARY)))


QUERIES = {"op5_token_files": op5_token_files}
ORACLE_SQL: dict[str, str] = {}
