"""Source divergence audit: how far each source of a language departs, in its
use of terms, from the other sources and from the language as a whole.

Terms that at least ``min_docs`` documents of a language hold are kept. A
group (a source of a language, or the language) has for each kept term its
count and p = 1 + floor(10^9 (count + 1) / (N + V)), with N the group's count
over the V kept terms. A term's divergence from q to p is
f = floor((p - q)^2 / q); two sources diverge by the sum of f over all kept
terms. All arithmetic is in whole numbers.

The sums over pairs of sources are taken on hash-consed segment trees over
term ids. The ids of a language are cut into blocks, subtrees that are built
in tasks of their own: equal counts share a leaf, and two halves of equal
nodes share a node, over all groups. A pair of groups is priced by going down
both trees at once; a pair of nodes that comes up again is not entered again
but counted, so equal pairs of subtrees, such as the terms that neither group
has, are priced once. Sources are taken in tiles, so that a task's size is
bounded however many there are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizlens.llm.common import LOWER_AZ, chunks, text_bytes, written
from quizlens.session import small_side

TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")   # same on UTF-8 bytes as on characters
MIN_DOCS = 3
RANKS = 200              # ranks of the part ``term`` (the report's length)
SCALE = 1000             # p is scaled by its cube
BLOCK_TERMS = 2048       # mean number of terms in a block
TILE = 64                # sources in a tile
HELD = 700_000           # (group, term) counts a task holds before it passes them on
LONG = 4 << 20           # bytes of text from which words are taken one by one


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source",
                text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents as each task
    has added them up, in rows to be added up further. A group has rows of
    null term too, so that one without any term is not lost."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    src = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, in_docs) in held.items():
                terms = [None, *n]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                     pa.array(terms, pa.binary()).cast(pa.string()),
                     pa.array([0, *n.values()], pa.int64()), pa.array([0, *(in_docs[t] for t in n)], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"])
            held.clear()

        for whole in batches:
            for b in chunks(whole, "text"):
                for lang, source, raw in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(),
                                             text_bytes(b.column("text"))):
                    n, in_docs = held.setdefault((lang, source), (Counter(), Counter()))
                    low = raw.translate(LOWER_AZ)
                    if len(low) < LONG:
                        words = TERM.findall(low)
                        n.update(words)
                        in_docs.update(set(words))
                    else:
                        own = Counter(m[0] for m in TERM.finditer(low))
                        n.update(own)
                        in_docs.update(own.keys())
                if sum(len(n) for n, _ in held.values()) > HELD:
                    yield from out()
        yield from out()

    return src.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_terms(counts: DataFrame, min_docs: int) -> DataFrame:
    """(lang, source, term, n, n_lang, is_first): the kept terms of each group
    with the lang's count, one row of each (lang, term) marked, and a row of
    null term for each group. One exchange, by (lang, term), serves the sums
    by group and those by lang."""
    own = counts.repartition("lang", "term").groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    return own.select(
        "lang", "source", "term", "n", F.sum("n").over(of_term).alias("n_lang"), F.sum("docs").over(of_term).alias("docs"),
        F.row_number().over(of_term.orderBy("source")).alias("at")).where(
        F.col("term").isNull() | (F.col("docs") >= min_docs)).select(
        "lang", "source", "term", "n", "n_lang", (F.col("term").isNotNull() & (F.col("at") == 1)).alias("is_first"))


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 (count + 1) / total) exactly, by long division."""
    rest, q = count + 1, F.lit(0).cast("long")
    for _ in range(3):
        scaled = rest * SCALE
        q = q * SCALE + F.call_function("div", scaled, total)
        rest = scaled % total
    return q + 1


def priced(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def shares(count: np.ndarray, total: int) -> np.ndarray:
    rest, q = count + 1, np.zeros(len(count), np.int64)
    for _ in range(3):
        q = q * SCALE + rest * SCALE // total
        rest = rest * SCALE % total
    return q + 1


class Trees:
    """Hash-consed segment trees over the rows of a matrix (groups x terms).

    ``counts`` are the leaves; level k has one node for each distinct pair of
    nodes below; the root level is the last. Columns beyond the terms have
    leaves of count -1, which cost nothing."""

    def __init__(self, matrix: np.ndarray):
        groups, terms = matrix.shape
        width = 1 << max(terms - 1, 0).bit_length()
        full = np.full((groups, width), -1, np.int64)
        full[:, :terms] = matrix
        self.counts, at = np.unique(full, return_inverse=True)
        at = at.reshape(groups, width)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        while at.shape[1] > 1:
            n = int(at.max()) + 1
            key, at = np.unique(at[:, 0::2] * n + at[:, 1::2], return_inverse=True)
            at = at.reshape(groups, -1)
            self.levels.append((key // n, key % n))
        self.roots = at[:, 0]

    def meetings(self, x: int, y: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count in x, count in y, terms): how many terms have each pair of
        counts, by one walk down both trees."""
        u, v, n = self.roots[[x]], self.roots[[y]], np.ones(1, np.int64)
        for left, right in reversed(self.levels):
            size = int(max(left.max(), right.max())) + 1
            pair = np.concatenate((left[u] * size + left[v], right[u] * size + right[v]))
            pair, which = np.unique(pair, return_inverse=True)
            n = np.bincount(which, weights=np.concatenate((n, n)), minlength=len(pair)).astype(np.int64)
            u, v = pair // size, pair % size
        a, b = self.counts[u], self.counts[v]
        real = a >= 0
        return a[real], b[real], n[real]


def _price_block(rows: pa.Table, groups: pa.Table) -> list[tuple[int, int, int, int]]:
    """(x, y, value, terms) of every ordered pair of a block's groups, one of
    either tile, over the terms that occur in the block here."""
    if not rows.num_rows or not groups.num_rows:
        return []
    name, tile, total = (groups.column(c).to_pylist() for c in ("id_", "tile_", "total_"))
    term = rows.column("term").combine_chunks().dictionary_encode()
    if isinstance(term, pa.ChunkedArray):
        term = term.combine_chunks()
    term = term.indices.to_numpy()
    count, everywhere, source = (rows.column(c).to_numpy() for c in ("n", "n_lang", "place"))
    # ids by falling count of the lang: rare terms, which most groups lack, lie together
    of_lang = np.zeros(int(term.max()) + 1, np.int64)
    of_lang[term] = everywhere
    place = np.empty_like(of_lang)
    place[np.argsort(-of_lang, kind="stable")] = np.arange(len(of_lang))
    by_name = np.argsort(name)
    matrix = np.zeros((len(name), len(of_lang)), np.int64)
    matrix[by_name[np.searchsorted(np.array(name)[by_name], source)], place[term]] = count
    trees = Trees(matrix)
    crossed = rows.column("tile_a")[0] != rows.column("tile_b")[0]
    found = []
    for x in range(len(name)):
        for y in range(x + 1, len(name)):
            if crossed and tile[x] == tile[y]:
                continue                     # such a pair has a task of its own
            a, b, n = trees.meetings(x, y)
            p, q = shares(a, total[x]), shares(b, total[y])
            d = (p - q) * (p - q)
            found.append((name[x], name[y], int((d // q * n).sum()), len(of_lang)))
            found.append((name[y], name[x], int((d // p * n).sum()), len(of_lang)))
    return found


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
          min_docs: int = MIN_DOCS, ranks: int = RANKS, block_terms: int = BLOCK_TERMS, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part ``pair``: item is each other source of the lang, value the sum of f
    from it to the source over all kept terms; all ranks. Part ``term``: item
    is each kept term that the source has and uses more than the lang does,
    value its f, ranks up to ``ranks``. Ranks go by value from the largest,
    then by item in the order of its bytes.

    Null text, lang and source count as ''. Every group takes part, also one
    without terms; a lang without kept terms has pairs of value 0, a lang of
    one source no pairs. Repeated rows are documents of their own, and texts
    are read whole. Other columns are not looked at. An empty table gives an
    empty result.
    """
    counted = written(kept_terms(term_counts(docs, lang_col, source_col, text_col), min_docs), "kept-terms")
    kept = counted.where("term IS NOT NULL")

    # one row per lang, and one per group: totals and places
    langs = kept.groupBy("lang").agg(F.sum("n").alias("n"), F.count_if("is_first").alias("v"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    at = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = written(
        counted.where("term IS NULL").select("lang", "source").distinct().join(sums, ["lang", "source"], "left")
        .join(langs.select("lang", "v", F.col("n").alias("n_lang")), "lang", "left")
        .select("lang", "source", at.cast("long").alias("id"), F.coalesce("v", F.lit(0)).alias("v"),
                (F.coalesce("n", F.lit(0)) + F.coalesce("v", F.lit(0))).alias("total"),
                (F.coalesce("n_lang", F.lit(0)) + F.coalesce("v", F.lit(0))).alias("lang_total"))
        .withColumn("tile", F.floor(F.col("id") / tile).cast("long")), "divergence-groups")

    named = kept.join(small_side(groups, is_written=True), ["lang", "source"])
    p, q = share(F.col("n"), F.col("total")), share(F.col("n_lang"), F.col("lang_total"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = (named.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q"))
             .where("p > q").select("lang", "source", "item", priced(F.col("p"), F.col("q")).alias("value"))
             .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= ranks))

    # the blocks of a lang meet the tiles of its sources, two at a time
    last = groups.groupBy("lang").agg(F.max("tile").alias("last"), F.first("v").alias("v")).withColumn(
        "blocks", F.ceil(F.col("v") / block_terms).cast("long")).where("blocks > 0").drop("v")
    both = lambda t, z: F.transform(F.sequence(F.lit(0).cast("long"), z), lambda o: F.struct(
        F.least(t, o).alias("a"), F.greatest(t, o).alias("b")))
    keys = ["lang", "block", "tile_a", "tile_b"]
    last = small_side(last)
    rows = (named.select("lang", "id", "term", "n", "n_lang", "tile").join(last, "lang")
            .withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")))
            .withColumn("t", F.explode(both(F.col("tile"), F.col("last"))))
            .select("lang", "block", F.col("t.a").alias("tile_a"), F.col("t.b").alias("tile_b"), F.col("id").alias("place"), "term", "n", "n_lang"))
    members = (groups.join(last, "lang")
               .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
               .withColumn("t", F.explode(both(F.col("tile"), F.col("last"))))
               .select("lang", "block", F.col("t.a").alias("tile_a"), F.col("t.b").alias("tile_b"), "id", "tile", "total"))

    def price(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = _price_block(left, right)
        lang = pa.array([key[0].as_py()] * len(found), pa.string())
        return pa.table([lang, *(pa.array([f[i] for f in found], pa.int64()) for i in range(4))],
                        names=["lang", "x", "y", "value", "terms"])

    # both sides come from the same tables: new names keep their columns apart
    members = members.toDF(*[f"{c}_" for c in members.columns])
    parts = rows.groupBy(*keys).cogroup(members.groupBy(*[f"{c}_" for c in keys])).applyInArrow(
        price, "lang string, x long, y long, value long, terms long")
    parts = parts.groupBy("lang", "x", "y").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))

    # a term that none of a task's sources has costs each of its pairs the price of two zeros
    one = groups.select("lang", "source", F.col("id").alias("x"), "v", F.col("total").alias("total_x"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("id").alias("y"), F.col("total").alias("total_y"))
    zero = F.when(F.col("v") > 0, priced(share(F.lit(0).cast("long"), F.col("total_x")),
                                         share(F.lit(0).cast("long"), F.col("total_y")))).otherwise(0)
    pairs = (one.join(other, "lang").where("x <> y").join(parts, ["lang", "x", "y"], "left")
             .select("lang", "source", "item", (F.coalesce("value", F.lit(0)) + (
                 F.col("v") - F.coalesce("terms", F.lit(0))) * zero).alias("value"))
             .withColumn("rank", F.row_number().over(ranked)))
    order = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*order).unionByName(
        terms.withColumn("part", F.lit("term")).select(*order))
