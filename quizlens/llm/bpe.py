"""Byte-level BPE encoding and decoding on padded numpy matrices.

A batch's texts are split by the public pattern into pieces, and each distinct
piece is encoded once. Pieces are bucketed by length into padded matrices of
token ids; in every round each row merges its leftmost pair of lowest rank,
found by a hashed pair lookup, and its tail moves up by one (compaction).
Rows without a mergeable pair leave the matrix.

The rank file's path is a parameter that every executor opens by itself.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quizlens.llm.common import chunks

NONE = np.int32(2 ** 31 - 1)      # rank of a pair that merges to no token
WIDEST = 256                      # longer pieces are merged one by one, with a heap
ROWS = 4096                       # rows of a matrix
CACHED_CHUNKS = 200_000           # distinct chunks a worker remembers
_MIX = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Open-addressing hash table (left id, right id) -> merged id, looked up
    for whole arrays at once."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(4, int(np.ceil(np.log2(max(len(pairs), 1) * 4))))
        keys = np.array([a << 32 | b for a, b in pairs], dtype=np.uint64)
        values = np.fromiter(pairs.values(), dtype=np.int32, count=len(pairs))
        size = 1 << self.bits
        self.keys = np.full(size, 2 ** 64 - 1, dtype=np.uint64)
        self.values = np.full(size, NONE, dtype=np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.keys[slot] == np.uint64(2 ** 64 - 1)
            # one claimant of each free slot gets it, the others move on
            at, first = np.unique(slot[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[at], self.values[at] = keys[todo[won]], values[todo[won]]
            stay = np.ones(len(todo), dtype=bool)
            stay[won] = False
            todo, slot = todo[stay], (slot[stay] + 1) % size

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged id, which is the pair's rank, or NONE."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], NONE)
        empty = np.uint64(2 ** 64 - 1)
        flat_keys, flat_slot, flat_out = keys.ravel(), slot.ravel(), out.ravel()
        open_ = np.flatnonzero(((self.keys[slot] != keys) & (self.keys[slot] != empty)).ravel())
        while len(open_):
            flat_slot[open_] = (flat_slot[open_] + 1) & ((1 << self.bits) - 1)
            at = self.keys[flat_slot[open_]]
            hit = at == flat_keys[open_]
            flat_out[open_[hit]] = self.values[flat_slot[open_[hit]]]
            open_ = open_[~hit & (at != empty)]
        return flat_out.reshape(out.shape)


class Vocabulary:
    """Ranks of a tiktoken file, with the pair table derived from them: a pair
    merges when the two tokens' bytes together are a token."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.pairs = PairTable({
            (self.ranks[t[:i]], self.ranks[t[i:]]): rank for t, rank in self.ranks.items()
            for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks})
        self.packed = {t: rank.to_bytes(4, "little") for t, rank in self.ranks.items()}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _merge_rows(v: Vocabulary, ids: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges every row of the padded matrix to its end; ids and lengths."""
    out, out_len = ids.copy(), length.copy()
    rows = np.arange(len(ids))
    ids = ids.copy()
    pos = np.arange(ids.shape[1] - 1)
    rank = v.pairs.ranks(ids[:, :-1], ids[:, 1:])
    rank[pos[None, :] >= (length[:, None] - 1)] = NONE
    while len(rows):
        at = rank.argmin(axis=1)
        k = np.arange(len(rows))
        best = rank[k, at]
        done = best == NONE
        if done.any():
            out[rows[done], :ids.shape[1]], out_len[rows[done]] = ids[done], length[done]
            live = ~done
            rows, ids, rank, length, at, best = rows[live], ids[live], rank[live], length[live], at[live], best[live]
            if not len(rows):
                break
            width = max(int(length.max()), 2)
            ids, rank = np.ascontiguousarray(ids[:, :width]), np.ascontiguousarray(rank[:, :width - 1])
            k = np.arange(len(rows))
        # the merged id takes the left place, everything behind moves up by one
        width = ids.shape[1]
        ids[k, at] = best
        cols = np.arange(width - 1)[None, :]
        take = np.minimum(cols + (cols > at[:, None]), width - 1)
        ids = np.take_along_axis(ids, take, axis=1)
        length = length - 1
        if ids.shape[1] < 2:
            ids = np.pad(ids, ((0, 0), (0, 1)))
        rcols = np.arange(rank.shape[1])[None, :]
        rank = np.take_along_axis(rank, np.minimum(rcols + (rcols >= at[:, None] + 1), rank.shape[1] - 1), axis=1)
        rank = rank[:, :ids.shape[1] - 1]
        # only the pairs to the left and right of the merged place are new
        for side in (at - 1, at):
            ok = np.flatnonzero((side >= 0) & (side < length - 1))
            rank[k[ok], side[ok]] = v.pairs.ranks(ids[ok, side[ok]], ids[ok, side[ok] + 1])
        rank[np.arange(rank.shape[1])[None, :] >= (length[:, None] - 1)] = NONE
    return out, out_len


def _merge_long(v: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """One long row, by a heap of (rank, place) over linked neighbours: the
    leftmost pair of lowest rank each time, in n log n steps."""
    n, known = len(ids), v.ranks.get
    first = v.pairs.ranks(ids[:-1], ids[1:])
    at = np.flatnonzero(first != NONE)
    heap = list(zip(first[at].tolist(), at.tolist()))
    heapq.heapify(heap)
    token = [v.tokens[i] for i in ids.tolist()]       # None once merged into the one before
    rank = first.tolist() + [int(NONE)]               # of the pair that begins here
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        r, i = heapq.heappop(heap)
        if token[i] is None or rank[i] != r:
            continue                                   # the pair is gone
        j = after[i]
        token[i] += token[j]
        token[j] = None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
        for x, y in ((before[i], i), (i, k)):
            if x >= 0:
                new = known(token[x] + token[y]) if y < n else None
                rank[x] = int(NONE) if new is None else new
                if new is not None:
                    heapq.heappush(heap, (new, x))
    return np.array([v.ranks[t] for t in token if t is not None], dtype=ids.dtype)


def encode_pieces(v: Vocabulary, pieces: list[bytes]) -> list[bytes]:
    """Token ids of each piece (not empty), as little-endian 32-bit integers.
    A piece that is itself a token is that token, as in the public tokenizer
    library."""
    out = list(map(v.packed.get, pieces))
    buckets: dict[int, list[int]] = {}
    for i, done in enumerate(out):
        if done is None:
            buckets.setdefault(max(4, 1 << (len(pieces[i]) - 1).bit_length()), []).append(i)
    for width, members in buckets.items():
        if width > WIDEST:
            for i in members:
                out[i] = _merge_long(v, v.byte_ids[np.frombuffer(pieces[i], np.uint8)]).astype("<i4").tobytes()
            continue
        for a in range(0, len(members), ROWS):
            part = members[a:a + ROWS]
            raw = np.frombuffer(b"".join([pieces[i].ljust(width, b"\0") for i in part]), np.uint8)
            length = np.array([len(pieces[i]) for i in part])
            ids, n = _merge_rows(v, v.byte_ids[raw.reshape(len(part), width)], length)
            flat, begin = ids.astype("<i4").tobytes(), range(0, 4 * width * len(part), 4 * width)
            for i, at, k in zip(part, begin, n.tolist()):
                out[i] = flat[at:at + 4 * k]
    return out


class Encoder:
    """Encodes texts by way of their distinct space-led chunks, remembering a
    bounded number of them between batches.

    A space followed by a non-space always starts a match of the public
    pattern, which looks at nothing to its left, and the run of white space
    before it matches as it would at the end of a text. So where every space
    is followed by a non-space, a text's matches are those of its chunks cut
    before each space; any other text is matched in one go.
    """

    def __init__(self, path: str, pattern: str):
        self.v, self.matches, self.known = vocabulary(path), regex.compile(pattern).findall, {}
        self.uneven = re.compile(r" (?:\s|$)").search

    def _chunks(self, text: str) -> list[str]:
        if self.uneven(text):
            return self.matches(text)
        first, *rest = text.split(" ")
        return [first, *[" " + w for w in rest]] if first else [" " + w for w in rest]

    def _learn(self, new: list[str]) -> None:
        split = [self.matches(c) for c in new]
        pieces = list({p for ps in split for p in ps})
        ids = dict(zip(pieces, encode_pieces(self.v, [p.encode() for p in pieces])))
        for c, ps in zip(new, split):
            self.known[c] = ids[ps[0]] if len(ps) == 1 else b"".join([ids[p] for p in ps])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self._chunks(t) for t in texts]
        if len(self.known) > CACHED_CHUNKS:
            self.known = {}
        self._learn(list(set().union(*cut).difference(self.known)))
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, cs)), dtype="<u4") for cs in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.v.tokens.__getitem__, ids.tolist()))


def encode_rows(rows: DataFrame, path: str, pattern: str, text: str = "text",
                columns: tuple[str, ...] = (), with_ids: bool = False) -> DataFrame:
    """The named columns of ``rows`` plus n_tokens, ids_sha256, decoded_sha256
    (and ``ids``, array<int>, if asked for).

    Null counts as empty: no tokens, the digests of no bytes. The digests are
    of the ids as little-endian unsigned 32-bit integers and of the bytes
    decoded from the ids again. No special token is ever produced. Texts are
    never cut; a piece of any length is encoded whole. Columns that are not
    named are not looked at. An empty table gives an empty result.
    """
    src = rows.select(*columns, rows[text].alias("_bpe_text"))
    fields = [*src.schema.fields[:-1], T.StructField("n_tokens", T.LongType()),
              T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path, pattern)
        for whole in batches:
            for b in chunks(whole, "_bpe_text"):
                ids = enc.encode([t or "" for t in b.column("_bpe_text").to_pylist()])
                out = [*b.columns[:-1], pa.array([len(x) for x in ids], pa.int64()),
                       pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]),
                       pa.array([hashlib.sha256(enc.decode(x)).hexdigest() for x in ids])]
                if with_ids:
                    out.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, names=names)

    return src.mapInArrow(run, T.StructType(fields))
