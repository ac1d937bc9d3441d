"""Cross-tokenizer alignment of two vocabularies over a corpus.

A (byte-level BPE) encodes a space and the text, B (sentencepiece BPE, which
adds that space itself) the text. Where a token of either ends at the same
byte, the two streams are cut into groups; inside a group, tokens whose byte
ranges overlap are linked. For every link the corpus says in how many
documents its pair of ids is linked.

* Identity map: an array from each A id to the B id of the same bytes, made
  once. A link of such a pair, which a one-to-one group always is but for byte
  tokens that have a piece of their own, is counted in a vector as long as A's
  vocabulary; a document counts once.
* Only the links of irregular groups are pairs that need a shuffle: documents
  are counted per batch first, then summed by pair.
* Counts go back to the documents without moving the documents to the pairs:
  the identity vector, each A id's highest count, and the ``heavy`` most
  frequent pairs are small by a fixed bound and are sent to the tasks. The
  links of all other pairs, none of which has more than 2 / ``heavy`` of all
  linked documents, are joined with their counts by a shuffle.

A space between two characters that are no white space always starts an A
match, and no B piece goes on behind its first letter into a space. So where
every space of a text stands so, each distinct chunk that a space leads is
encoded and grouped once per worker; other texts are encoded whole.
"""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizlens.llm.common import chunks, written

HEAVY = 500_000            # pairs whose counts are sent to every task
CACHED_CHARS = 6 << 20     # of distinct chunks a worker remembers
JOINED = 500               # chunks encoded in one string
SPACE = "▁"           # B's sign for a space
_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace()]


def _uneven(text: str) -> bool:
    """Whether a space stands beside white space, or at either end."""
    return text[0] == " " or text[-1] == " " or any(c in text and (c + " " in text or " " + c in text) for c in _SPACES)


def _byte_level() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 stands for itself,
    every other byte, in order, for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """The two tokenizers, their tokens' bytes and the identity map."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # the task's own core only
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = _byte_level()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.bytes_b, n_b = [], self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(n_b)]
        for i, piece in enumerate(pieces):
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else
                                b"" if self.b.is_control(i) else piece.replace(SPACE, " ").encode())
        same = {self.bytes_b[i]: i for i in reversed(range(n_b)) if not self.b.is_byte(i)}
        for i in range(n_b):
            if self.b.is_byte(i):
                same.setdefault(self.bytes_b[i], i)
        self.size_a, self.size_b = (np.array([len(x) for x in xs], np.int64) for xs in (self.bytes_a, self.bytes_b))
        self.identity = np.array([same.get(x, -1) if x else -1 for x in self.bytes_a], dtype=np.int64)
        self.by_chunk = not any(SPACE in p.lstrip(SPACE) for p in pieces)


@functools.lru_cache(maxsize=2)
def tokenizers(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


class Chunks:
    """Distinct chunks of text in both tokenizations, held in flat arrays that
    grow by appending: per chunk its counts, its links of the identity map (A
    ids) and its other links (A id << 32 | B id), and its groups as text."""

    def __init__(self, p: Pair):
        self.p, self.place, self.size = p, {}, 0
        self.groups: list[str] = []
        self.counts = np.zeros((0, 3), np.int64)                  # n_a, n_b, n_groups; -1: bytes lost
        self.ident, self.ident_at = np.empty(0, np.int64), np.zeros(1, np.int64)
        self.pairs, self.pairs_at = np.empty(0, np.int64), np.zeros(1, np.int64)

    def learn(self, new: list[str], by_space: list[bool]) -> None:
        """Adds chunks; those that ``by_space`` marks are encoded many in one
        string, since neither tokenizer joins them, the others alone."""
        p, joint, alone = self.p, [], []
        for k, joined in enumerate(by_space):
            if not joined:
                alone.append([k])
            elif joint and len(joint[-1]) < JOINED:
                joint[-1].append(k)
            else:
                joint.append([k])
        found: list[tuple] = []
        for members in [*joint, *alone]:
            self._add([new[k] for k in members], found)
        counts, ident, n_ident, pairs, n_pairs = (np.concatenate(x) for x in zip(*found)) if found else [np.empty(0, np.int64)] * 5
        self.counts = np.concatenate((self.counts, counts.reshape(-1, 3)))
        self.ident, self.pairs = np.concatenate((self.ident, ident)), np.concatenate((self.pairs, pairs))
        self.ident_at = np.concatenate((self.ident_at, self.ident_at[-1] + np.cumsum(n_ident)))
        self.pairs_at = np.concatenate((self.pairs_at, self.pairs_at[-1] + np.cumsum(n_pairs)))
        for members in [*joint, *alone]:
            for k in members:
                self.place[new[k]] = len(self.place)
                self.size += len(new[k])

    def _add(self, chunks_: list[str], found: list[tuple]) -> None:
        p, text = self.p, "".join(chunks_)
        a = p.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        b = p.b.encode(text[1:], num_threads=1)
        raw = text.encode()
        if not (b"".join([p.bytes_a[i] for i in a]) == raw == b"".join([p.bytes_b[i] for i in b])):
            if len(chunks_) > 1:                                  # find those to blame
                for c in chunks_:
                    self._add([c], found)
                return
            self.groups.append("")
            none, no_link = np.empty(0, np.int64), np.zeros(1, np.int64)
            found.append((np.full((1, 3), -1), none, no_link, none, no_link))
            return
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        end_a, end_b = np.cumsum(p.size_a[a]), np.cumsum(p.size_b[b])
        # each stretch between two ends lies in one token of either: a link
        ends = np.union1d(end_a, end_b)
        at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        both = (end_a[at_a] == ends) & (end_b[at_b] == ends)
        chunk_end = np.cumsum([len(c.encode()) for c in chunks_])
        inside = lambda x: np.diff(np.searchsorted(x, chunk_end, side="right"), prepend=0)
        n_groups = inside(ends[both])
        same = p.identity[a[at_a]] == b[at_b]
        found.append((np.stack((inside(end_a), inside(end_b), n_groups), axis=1), a[at_a[same]], inside(ends[same]),
                      (a[at_a] << 32 | b[at_b])[~same], inside(ends[~same])))
        told_a, told_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        cut_a, cut_b = (at_a[both] + 1).tolist(), (at_b[both] + 1).tolist()
        told = [f"{told_a[i]}|{told_b[k]}" if j - i == 1 and m - k == 1 else f"{','.join(told_a[i:j])}|{','.join(told_b[k:m])}"
                for i, j, k, m in zip([0, *cut_a], cut_a, [0, *cut_b], cut_b)]
        at = 0
        for n in n_groups.tolist():
            self.groups.append(";".join(told[at:at + n]) if n != 1 else told[at])
            at += n


def _gather(values: np.ndarray, at: np.ndarray, chunk: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of each named chunk, one after another, and their rows."""
    size = at[chunk + 1] - at[chunk]
    total = np.cumsum(size)
    place = np.arange(total[-1] if len(total) else 0) + np.repeat(at[chunk] - (total - size), size)
    return values[place], np.repeat(row, size)


def _distinct(values: np.ndarray, row: np.ndarray, rows: int) -> tuple[pa.Array, pa.Array]:
    """Each row's distinct values and how often it has them, as list columns."""
    dense, which = np.unique(values, return_inverse=True)
    key, often = np.unique(row * max(len(dense), 1) + which, return_counts=True)
    at = pa.array(np.searchsorted(key, np.arange(rows + 1) * max(len(dense), 1)).astype(np.int32))
    found = dense[key % max(len(dense), 1)] if len(key) else values
    return pa.ListArray.from_arrays(at, pa.array(found)), pa.ListArray.from_arrays(at, pa.array(often.astype(np.int32)))


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.p = tokenizers(path_a, path_b)
        self.known = Chunks(self.p)

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], list[pa.Array]]:
        """Of each text n_a, n_b, n_groups, then its groups as text, then its
        identity links, other links, each with how often it has them."""
        if self.known.size > CACHED_CHARS:
            self.known = Chunks(self.p)
        cut: list[list[str]] = []
        split = []
        for t in texts:
            split.append(bool(t) and self.p.by_chunk and not _uneven(t))
            cut.append([] if not t else [" " + w for w in t.split(" ")] if split[-1] else [" " + t])
        known = self.known
        new: dict[str, bool] = {}
        for cs, s in zip(cut, split):
            for c in cs:
                if c not in known.place:
                    new[c] = s
        known.learn(list(new), list(new.values()))
        get = known.place.__getitem__
        size = np.array([len(cs) for cs in cut], np.int64)
        chunk = np.fromiter(map(get, chain.from_iterable(cut)), np.int64, int(size.sum()))
        row = np.repeat(np.arange(len(texts)), size)
        lost = np.zeros(len(texts), bool)
        lost[row[known.counts[chunk, 0] < 0]] = True
        chunk, row = chunk[~lost[row]], row[~lost[row]]
        counts = np.stack([np.bincount(row, weights=known.counts[chunk, i], minlength=len(texts)).astype(np.int64)
                           for i in range(3)], axis=1)
        told = known.groups.__getitem__
        edge = np.searchsorted(row, np.arange(len(texts) + 1)).tolist()
        listed = chunk.tolist()
        groups = [";".join(map(told, listed[i:j])) for i, j in zip(edge, edge[1:])]
        links = [*_distinct(*_gather(known.ident, known.ident_at, chunk, row), len(texts)),
                 *_distinct(*_gather(known.pairs, known.pairs_at, chunk, row), len(texts))]
        return counts, groups, links


def align_rows(rows: DataFrame, path_a: str, path_b: str, text_col: str = "text",
               columns: tuple[str, ...] = (), with_groups: bool = True) -> DataFrame:
    """The named columns plus n_a, n_b, n_groups, n_links, groups_sha256
    (and ``groups`` as text, ``a1,a2|b1;a3|b2,b3``), the document's distinct
    identity links and other links, and how often each occurs."""
    src = rows.select(*columns, rows[text_col].alias("_al_text"))
    fields = [*src.schema.fields[:-1], *T._parse_datatype_string(
        "n_a long, n_b long, n_groups long, n_links long, " + "groups string, " * with_groups +
        "groups_sha256 string, ident array<long>, ident_n array<int>, pairs array<long>, pairs_n array<int>").fields]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = Aligner(path_a, path_b)
        for whole in batches:
            for b in chunks(whole, "_al_text"):
                n, groups, links = al.align(b.column("_al_text").to_pylist())
                sha = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:-1], *[pa.array(n[:, i]) for i in range(3)], pa.array(n[:, 0] + n[:, 1] - n[:, 2]),
                     *[pa.array(groups, pa.string())] * with_groups, pa.array(sha, pa.string()), *links], names=names)

    return src.mapInArrow(run, T.StructType(fields))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values and the row each stands in."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return values, np.repeat(np.arange(len(column)), size)


def identity_counts(aligned: DataFrame, size: int) -> DataFrame:
    """(a, n): documents that link A id ``a`` with its like, by a vector of
    the vocabulary's length in each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = np.zeros(size, np.int64)
        for b in batches:
            v += np.bincount(_flat(b.column("ident"))[0], minlength=size)
        at = np.flatnonzero(v)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(v[at])], names=["a", "n"])

    return aligned.select("ident").mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): documents that hold each irregular pair linked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, n = np.unique(_flat(b.column("pairs"))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["pair", "n"])

    return aligned.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _heavy_from(counts: DataFrame, heavy: int) -> int:
    """The least power of two such that at most ``heavy`` pairs count as many
    documents. The number of pairs by power is all that is collected."""
    by_power = counts.groupBy(F.length(F.bin("n")).alias("bits")).agg(F.count(F.lit(1)).alias("k")).collect()
    most, total = max((r.bits for r in by_power), default=0), 0
    for bits in range(most, 0, -1):
        total += sum(r.k for r in by_power if r.bits == bits)
        if total > heavy:
            return 1 << bits
    return 1


def alignment(rows: DataFrame, path_a: str, path_b: str, text_col: str = "text", columns: tuple[str, ...] = (),
              heavy: int = HEAVY, with_groups: bool = False) -> DataFrame:
    """The named columns plus n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256 (and ``groups`` if asked for).

    A pair's count is the number of rows whose text links it. n_best counts a
    text's links whose pair has the highest count of all pairs with that A
    id, ties included; count_sum adds the counts of its links. Null and empty
    texts, and texts whose bytes either tokenizer does not give back, have no
    tokens: zeros, and '' for both text columns. Repeated rows are documents
    of their own. Texts are encoded whole; special tokens in them are plain
    text. Columns that are not named are not looked at; they may not be named
    like those added. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    aligned = written(align_rows(rows, path_a, path_b, text_col, columns, with_groups)
                      .withColumn("_al_row", F.monotonically_increasing_id()), "aligned")

    p = tokenizers(path_a, path_b)
    size = len(p.bytes_a)
    own, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for r in identity_counts(aligned, size).collect():             # as many rows as A has ids, at most
        own[r.a] = best[r.a] = r.n
    counts = written(pair_counts(aligned), "pair-counts")
    for r in counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("n")).collect():
        best[r.a] = max(best[r.a], r.n)
    least = _heavy_from(counts, heavy)
    top = counts.where(F.col("n") >= least).toPandas().sort_values("pair")   # ``heavy`` rows at most
    known = spark.sparkContext.broadcast((own, best, top["pair"].to_numpy(np.int64), top["n"].to_numpy(np.int64)))

    held = ["ident", "ident_n", "pairs", "pairs_n"]
    passed = [f for f in aligned.schema.fields if f.name not in held]
    fields = [*passed, *T._parse_datatype_string(
        "n_best long, count_sum long, light array<long>, light_n array<int>").fields]
    names = [f.name for f in fields]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, best, keys, n = known.value
        for b in batches:
            rows_ = b.num_rows
            total, n_best = np.zeros(rows_, np.int64), np.zeros(rows_, np.int64)

            def add(at: np.ndarray, a: np.ndarray, often: np.ndarray, count: np.ndarray) -> None:
                np.add.at(total, at, often * count)
                np.add.at(n_best, at, often * (count == best[a]))

            a, at = _flat(b.column("ident"))
            add(at, a, _flat(b.column("ident_n"))[0], own[a])
            pair, at = _flat(b.column("pairs"))
            often = _flat(b.column("pairs_n"))[0]
            place = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
            hit = keys[place] == pair if len(keys) else np.zeros(len(pair), bool)
            add(at[hit], pair[hit] >> 32, often[hit], n[place[hit]] if len(keys) else often[hit])
            size_ = np.bincount(at[~hit], minlength=rows_)
            offsets = pa.array(np.concatenate(([0], np.cumsum(size_))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*[b.column(f.name) for f in passed], pa.array(n_best), pa.array(total),
                 pa.ListArray.from_arrays(offsets, pa.array(pair[~hit])),
                 pa.ListArray.from_arrays(offsets, pa.array(often[~hit].astype(np.int32)))], names=names)

    scored = written(aligned.mapInArrow(score, T.StructType(fields)), "scored")
    tops = spark.createDataFrame(pd.DataFrame({"a": np.flatnonzero(best), "best": best[best > 0]}), "a long, best long")
    light = counts.where(F.col("n") < least).withColumn("a", F.shiftright("pair", 32)).join(
        F.broadcast(tops), "a").select("pair", "n", (F.col("n") == F.col("best")).cast("long").alias("is_best"))
    more = (scored.select("_al_row", F.explode(F.arrays_zip("light", "light_n")).alias("x"))
            .select("_al_row", F.col("x.light").alias("pair"), F.col("x.light_n").cast("long").alias("often"))
            .join(light, "pair").groupBy("_al_row").agg(
                F.sum(F.col("often") * F.col("n")).alias("_al_sum"), F.sum(F.col("often") * F.col("is_best")).alias("_al_best")))
    out = scored.join(more, "_al_row", "left")
    added = lambda c, x: (F.col(c) + F.coalesce(F.col(x), F.lit(0))).alias(c)
    return out.select(*[F.col(c) for c in columns], "n_a", "n_b", "n_groups", "n_links", added("n_best", "_al_best"),
                      added("count_sum", "_al_sum"), *["groups"] * with_groups, "groups_sha256")
