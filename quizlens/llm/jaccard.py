"""N-gram Jaccard join by universe-partition pigeonhole.

Two sets with Jaccard similarity t or more differ in at most
H = (1 - t) / (1 + t) * (|x| + |y|) elements. The hash universe is cut into
more segments than that, so some segment of the two sets must be the same, or
differ by one element where segments are also indexed with one element left
out. Only pairs that share such a signature are verified, exactly.

* Sizes fall into bands [2^i, 2^(i+1)). Band i is a family with its own number
  of segments; a set joins the family of its band and, if it can have partners
  there, that of the band below.
* Allocation by cost: per family, either segments indexed as they are (one
  unit of difference each) or fewer, larger segments indexed with their
  one-deletion neighbourhoods too (two units each); see ``allocation``.
* A set takes segments from the low end of the universe until their units
  exceed its H, plus some slack, and no more. Of a pair, the member that stops
  earlier still covers both. A set whose segments clump so that the units do
  not suffice also takes single elements in hash order (segments as narrow as
  they get); two such sets meet there.
* A signature of more than ``HOT`` sets is hot. All pairs are candidates in
  the others. A set whose units still exceed H without its hot signatures
  does not need them. Only the rest, mainly members of large groups of near
  copies, is looked at in hot groups: first against a few hubs of the group
  (linear), then, block by block, against members that are not yet in the same
  component, pruned by bitmaps that bound the difference from below. No pair
  is lost, and a group's pairs are never emitted.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from math import ceil, floor

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quizlens.llm.common import chunks, text_bytes, written
from quizlens.llm.components import components
from quizlens.llm.shingles import mix, shingle_sets
from quizlens.session import small_side

SIMILARITY = 0.75
HOT = 16                 # sets of a signature whose pairs are all candidates
HUBS = 3                 # of a hot group
HUB_TURNS = 8            # rounds of hubs, at most, before what is left is compared in blocks
LINKED = 0.25            # share of a family that hubs have linked, for another round to be worth it
GAIN = 0.8               # share of those outside that a round may leave for another to follow
BLOCK = 1024             # members of a block of a family of hot groups
BLOCK_ELEMENTS = 1 << 23 # shingles of a block, unless it has fewer than 16 members
MAX_BITS = 1 << 14       # of a set's bitmap
PAIR_COST = 100.0        # a candidate's cost in signatures, for the allocation
SHARED = 0.1             # assumed chance that two texts of a band share an element
OWN, BELOW, OWN_FINE, BELOW_FINE = range(4)   # how a set takes part in a family
_U = np.uint64


@functools.lru_cache(maxsize=64)
def allocation(band: int, t: float) -> tuple[int, bool]:
    """(segments, with one-deletion neighbourhoods) of a family: the cheaper
    of the two ways to cover the largest difference in it, counting signatures
    and the candidates expected from their number of elements."""
    size = 2 ** (band + 1) - 1
    units = floor(difference(size, floor(size / t), t)) + 1

    def cost(signatures: float, elements: float) -> float:
        return signatures * (1 + PAIR_COST * SHARED ** max(1.0, elements))

    plain, wide = ceil(1.25 * units) + 4, ceil(units / 2)
    c_plain = cost(1.1 * units + 2, size / plain)
    c_wide = cost(wide + size, size / wide - 1)
    return (wide, True) if c_wide < c_plain else (plain, False)


def difference(a: int, b: int, t: float) -> float:
    return (1 - t) / (1 + t) * (a + b) + 1e-9


def _segments(h: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, first index) of the non-empty segments of the sorted set."""
    seg = ((h >> _U(32)) * _U(m)) >> _U(32)
    begin = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
    return seg[begin], begin


def signatures(h: np.ndarray, t: float) -> list[tuple[int, np.ndarray, int]]:
    """(role, signatures, slack) of a sorted set in its families. The slack is
    the number of signatures that may be hot before the set's units no longer
    exceed its largest possible difference."""
    n = len(h)
    band = n.bit_length() - 1
    roles = [(OWN, band, floor(difference(n, floor(n / t + 1e-9), t)) + 1)]
    if band > 0 and ceil(t * n - 1e-9) < 2 ** band:
        roles.append((BELOW, band - 1, floor(difference(n, 2 ** band - 1, t)) + 1))
    out = []
    element = mix(h)
    for role, family, need in roles:
        m, deletions = allocation(family, t)
        seg, begin = _segments(h, m)
        whole = np.add.reduceat(element, begin)
        salt = _U((family * 2 + 1) * 0x9E3779B97F4A7C15 % 2 ** 64)
        if deletions:
            count = np.diff(np.append(begin, n))
            which = np.repeat(np.arange(len(seg)), count)
            several = count[which] > 1
            left = (whole[which] - element)[several]
            sums, segs = np.concatenate((whole, left)), np.concatenate((seg, seg[which[several]]))
            units = int(np.minimum(count, 2).sum())
            slack = (units - need) // 2
        else:
            take = min(len(seg), need + need // 10 + 2)
            sums, segs, units = whole[:take], seg[:take], take
            slack = units - need
        out.append((role, mix(sums + mix(segs + salt)), slack))
        if units < need:
            take = min(n, need + need // 10 + 2)
            fine = mix(element[:take] + mix(np.array([salt + _U(2)], dtype=np.uint64)))
            out.append((role + 2, fine, take - need))
    return out


def _bitmap(h: np.ndarray) -> bytes:
    """Bit i is set where an element's low bits are i; 2 to 4 bits an element."""
    bits = min(MAX_BITS, max(64, 2 << len(h).bit_length()))
    b = np.zeros(bits, dtype=bool)
    b[(h & _U(bits - 1)).astype(np.int64)] = True
    return np.packbits(b).tobytes()


def _digest(h: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(h.tobytes())


def _tag(digest: bytes) -> int:
    """60 bits of the digest: names a set in signature rows. Two sets with one
    tag would share their candidates, which only adds some to verify."""
    return int.from_bytes(digest[:8], "little") >> 4


def describe(rows: DataFrame, id_col: str, text_col: str, t: float) -> DataFrame:
    """Every row's set: size, digest, tag, slack by role and bitmap."""
    src = rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, "text"):
                sets = shingle_sets(text_bytes(b.column("text")))
                digests = [_digest(h) for h in sets]
                slack = [[None] * 4 for _ in sets]
                for h, row in zip(sets, slack):
                    for role, _, spare in signatures(h, t) if len(h) else ():
                        row[role] = spare
                yield pa.RecordBatch.from_arrays([
                    b.column("id"), pa.array([len(h) for h in sets], pa.int64()),
                    pa.array(digests, pa.binary()), pa.array([_tag(d) for d in digests], pa.int64()),
                    pa.array(slack, pa.list_(pa.int32())),
                    pa.array([_bitmap(h) for h in sets], pa.binary())],
                    names=["id", "n", "digest", "tag", "slack", "bits"])

    return src.mapInArrow(run, "id long, n long, digest binary, tag long, slack array<int>, bits binary")


def signature_rows(rows: DataFrame, text_col: str, t: float) -> DataFrame:
    """(sig, member): member is the tag, 2 bits of role and a hot bit. Equal
    sets of a partition give their signatures once. Where a chunk alone holds
    more than HOT sets of a signature, all but HOT + 1 of them are marked hot
    at once, and dealt by their tag instead of the signature."""
    src = rows.select(F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for b in chunks(whole, "text"):
                sigs, members = [], []
                for h in shingle_sets(text_bytes(b.column("text"))):
                    if not len(h):
                        continue
                    tag = _tag(_digest(h))
                    if tag in seen:
                        continue
                    seen.add(tag)
                    for role, s, _ in signatures(h, t):
                        sigs.append(s)
                        members.append(np.full(len(s), tag << 3 | role << 1, dtype=np.int64))
                if not sigs:
                    continue
                sig, member = np.concatenate(sigs), np.concatenate(members)
                order = np.argsort(sig)
                sig, member = sig[order], member[order]
                start = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
                place = np.arange(len(sig)) - np.repeat(start, np.diff(np.append(start, len(sig))))
                member = member | (place > HOT)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(member)],
                                                 names=["sig", "member"])

    return src.mapInArrow(run, "sig long, member long")


def group_signatures(rows: DataFrame) -> DataFrame:
    """(pair, a, b, shared): candidate pairs of tags with the number of
    signatures they share (pair = true; a pair may come in several rows), and
    the members of hot signatures as (signature, member)."""
    hot_bit = F.col("member").bitwiseAND(F.lit(1)) == 1
    by = F.when(hot_bit, F.xxhash64("member")).otherwise(F.col("sig"))
    dealt = rows.repartition(by).sortWithinPartitions("sig")

    def found(sig: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of the rows, sorted by signature, none of them hot."""
        pairs = [np.empty((0, 2), np.int64)]
        for d in range(1, HOT):
            same = np.flatnonzero(sig[d:] == sig[:-d]) if d < len(sig) else np.empty(0, np.int64)
            if not len(same):
                break
            x, y = member[same], member[same + d]
            # two sets of the band above meet in their own family
            useful = ((x >> 1 & 1) + (y >> 1 & 1) < 2) & (x >> 3 != y >> 3)
            x, y = x[useful] >> 3, y[useful] >> 3
            pairs.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
        p, n = np.unique(np.concatenate(pairs), axis=0, return_counts=True)
        return p[:, 0], p[:, 1], n

    def out(pair: bool, a: np.ndarray, b: np.ndarray, shared: np.ndarray | None = None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(a), pair)), pa.array(a), pa.array(b),
             pa.array(np.ones(len(a), np.int64) if shared is None else shared)], names=["pair", "a", "b", "shared"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        held_sig, held_member, hot_sig = none, none, None      # the group that may go on
        for b in batches:
            sig, member = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            known = (member & 1) == 1
            if hot_sig is not None:
                known |= sig == hot_sig
            if known.any():
                yield out(False, sig[known], member[known] & ~1)
                sig, member = sig[~known], member[~known]
            if not len(sig):
                continue
            hot_sig = None
            sig, member = np.concatenate((held_sig, sig)), np.concatenate((held_member, member))
            start = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
            size = np.diff(np.append(start, len(sig)))
            size[-1] += 1                                       # look at the last group in any case
            several = np.repeat(size > 1, np.diff(np.append(start, len(sig))))
            sig, member = sig[several], member[several]
            order = np.lexsort((member, sig))
            sig, member = sig[order], member[order]
            new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (member[1:] != member[:-1])))
            sig, member = sig[new], member[new]
            start = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
            size = np.diff(np.append(start, len(sig)))
            hot = np.repeat(size > HOT, size)
            yield out(False, sig[hot], member[hot])
            rest = ~hot
            if size[-1] > HOT:
                hot_sig, held_sig, held_member = sig[-1], none, none
            else:
                held_sig, held_member = sig[start[-1]:], member[start[-1]:]
                rest[start[-1]:] = False
            yield out(True, *found(sig[rest], member[rest]))
        yield out(True, *found(held_sig, held_member))

    return dealt.mapInArrow(run, "pair boolean, a long, b long, shared long")


def _similar(x: np.ndarray, y: np.ndarray, t: float) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    percent = round(t * 100)
    return 100 * both >= percent * (len(x) + len(y) - both)


def _ends(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """The pairs (a, b) with the named columns of either set, as name_a and
    name_b."""
    for x in "ab":
        pairs = pairs.join(sets.select(F.col("tag").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns]), x)
    return pairs


def _sizes_fit(t: float):
    return F.least("n_a", "n_b") >= F.lit(t) * F.greatest("n_a", "n_b")


def shared_enough(found: DataFrame, sets: DataFrame) -> DataFrame:
    """Candidate pairs that share as many signatures as a link requires.

    A set takes ``slack`` more signatures than its largest difference can
    spoil, so of a linked pair the member that stops earlier finds at least
    slack + 1 of its signatures in the other, less those that are hot."""
    pairs = found.where("pair").groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    return _ends(pairs, sets, "spare").where(F.col("shared") > F.least("spare_a", "spare_b")).select("a", "b")


def bits_of(described: DataFrame, tags: DataFrame) -> DataFrame:
    """(tag, digest, bits) of the named tags only; sets may share a tag. The
    tags are broadcast where their measured bytes allow it, so the bitmaps need
    not be shuffled to find them."""
    return described.select("tag", "digest", "bits").join(small_side(tags.distinct()), "tag", "left_semi") \
        .dropDuplicates(["tag", "digest"])


def bits_fit(pairs: DataFrame, sets: DataFrame, described: DataFrame, t: float) -> DataFrame:
    """The pairs of tags that neither sizes nor bitmaps rule out, as pairs of
    document ids with their sets' digests."""
    p = written(_ends(pairs, sets, "n", "rep", "digest").where(_sizes_fit(t)), "sized")
    bits = bits_of(described, p.select(F.explode(F.array("a", "b")).alias("tag")))
    for x in "ab":
        p = p.join(bits.select(F.col("tag").alias(x), F.col("digest").alias(f"digest_{x}"),
                               F.col("bits").alias(f"bits_{x}")), [x, f"digest_{x}"])
    out = ["id_a", "id_b", "digest_a", "digest_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            limit = (1 - t) / (1 + t) * (b.column("n_a").to_numpy() + b.column("n_b").to_numpy()) + 1e-6
            fit = pa.array([_apart(x, y) <= k for x, y, k in zip(
                b.column("bits_a").to_pylist(), b.column("bits_b").to_pylist(), limit)], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [b.column(c).filter(fit) for c in ("rep_a", "rep_b", "digest_a", "digest_b")], names=out)

    return p.mapInArrow(run, "id_a long, id_b long, digest_a binary, digest_b binary")


def fetch_texts(rows: DataFrame, paired: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(need, text, paired, member): the texts of the documents that stand in
    a pair or are members of hot signatures (one column of ids each). The ids
    are broadcast where their measured bytes allow it; beyond that the
    documents are shuffled to them."""
    need = paired.toDF("need").select("need", F.lit(True).alias("paired"), F.lit(False).alias("member")).unionAll(
        members.toDF("need").select("need", F.lit(False), F.lit(True))).groupBy("need").agg(
        F.max("paired").alias("paired"), F.max("member").alias("member"))
    return written(rows.select(F.col(id_col).cast("long").alias("need"), F.col(text_col).alias("text"))
                   .join(small_side(need), "need"), "texts")


def verify(p: DataFrame, texts: DataFrame, t: float, flag: str = "paired") -> DataFrame:
    """Of the pairs (id_a, id_b, digests) the linked ones, as (u, v), by the
    whole texts, which are those of the named flag."""
    def text(x):
        return texts.where(flag).select(F.col("need").alias(f"id_{x}"), F.col("text").alias(f"text_{x}"))

    # the smaller id, often the hub of a group, first: the second join then
    # deals the rows by their other, mostly distinct, end
    joined = p.join(text("a"), "id_a").join(text("b"), "id_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, "text_b"):
                col = {c: b.column(c) for c in b.schema.names}
                ids = {x: col[f"id_{x}"].to_pylist() for x in "ab"}
                known: dict[tuple[int, bytes], np.ndarray] = {}
                for x in "ab":
                    # a document id may be repeated with other texts: of all
                    # texts that come under a key, that of its digest counts
                    todo: dict = {}
                    for key, text_ in zip(zip(ids[x], col[f"digest_{x}"].to_pylist()),
                                          text_bytes(col[f"text_{x}"])):
                        if key not in known:
                            todo[key, text_] = None
                    for (key, _), h in zip(todo, shingle_sets([t_ for _, t_ in todo]) if todo else ()):
                        if _digest(h) == key[1]:
                            known[key] = h
                u, v = [], []
                for i, j, di, dj in zip(ids["a"], ids["b"], col["digest_a"].to_pylist(),
                                        col["digest_b"].to_pylist()):
                    x, y = known.get((i, di)), known.get((j, dj))
                    if x is not None and y is not None and len(x) and len(y) and _similar(x, y, t):
                        u.append(i)
                        v.append(j)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())],
                                                 names=["u", "v"])

    return written(joined.mapInArrow(run, "u long, v long"), "links")


def needing(hot: DataFrame, sets: DataFrame) -> DataFrame:
    """(sig, tag, needs): members of the hot signatures that some member
    needs, because so many of its signatures in that role are hot that its
    slack is used up.

    A linked pair that shares no other signature shares more hot ones than the
    slack of one of the two. So members with fewer hot signatures than that,
    such as those that only hold a common passage, are left out; a pair that
    shares another signature too is a candidate already."""
    role_slack = F.coalesce(F.get("slack", F.col("role")), F.lit(0))
    per = hot.groupBy("tag", "role").agg(F.count(F.lit(1)).alias("hot")).join(
        sets.select("tag", "slack"), "tag").select("tag", "role", "hot", role_slack.alias("slack"))
    m = hot.join(per, ["tag", "role"]).withColumn("needs", F.col("hot") > F.col("slack"))
    wanted = m.where("needs").groupBy("sig").agg(F.min("slack").alias("least"))
    return m.join(small_side(wanted), "sig").where("hot > least(slack, least)").select("sig", "tag", "needs")


def hub_pairs(members: DataFrame) -> DataFrame:
    """(a, b): every member that needs hot signatures with its hubs. Hubs of
    a hot signature are a few members that need it too; of all that a member
    meets in its signatures, it takes the ``HUBS`` it shares most of them
    with. So a member has ``HUBS`` pairs at most of its own, however many hot
    signatures it has; what they do not link is compared in blocks."""
    m = members.where("needs").select("sig", "tag")
    low = [F.min(F.struct(F.xxhash64("tag", F.lit(j)).alias("h"), "tag")).alias(f"hub{j}") for j in range(HUBS)]
    hubs = m.groupBy("sig").agg(*low).select(
        "sig", F.explode(F.array_distinct(F.array(*[F.col(f"hub{j}.tag") for j in range(HUBS)]))).alias("hub"))
    met = m.join(hubs, "sig").where("hub != tag").groupBy("tag", "hub").agg(F.count(F.lit(1)).alias("shared"))
    most = Window.partitionBy("tag").orderBy(F.desc("shared"), F.xxhash64("hub"), "hub")
    return met.withColumn("place", F.row_number().over(most)).where(F.col("place") <= HUBS).select(
        F.least("hub", "tag").alias("a"), F.greatest("hub", "tag").alias("b")).distinct()


def _fold(bits: bytes, size: int) -> bytes:
    """The bitmap of ``size`` bytes: the halves of a larger one together. Bit
    i of a bitmap stands for the elements that are i modulo its width."""
    while len(bits) > size:
        half = len(bits) // 2
        bits = (int.from_bytes(bits[:half], "big") | int.from_bytes(bits[half:], "big")).to_bytes(half, "big")
    return bits


def _apart(x: bytes, y: bytes) -> int:
    """Bits that differ: no more than the elements that differ."""
    size = min(len(x), len(y))
    return (int.from_bytes(_fold(x, size), "big") ^ int.from_bytes(_fold(y, size), "big")).bit_count()


def _shared_counts(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of the sorted set x with each other set."""
    flat = np.concatenate(others)
    at = np.searchsorted(x, flat)
    hit = x[np.minimum(at, len(x) - 1)] == flat
    return np.add.reduceat(hit, np.cumsum([0, *[len(o) for o in others[:-1]]]), dtype=np.int64)


def _linked_across(rows: pd.DataFrame, t: float) -> pd.DataFrame:
    """Links (u, v) between a left and a right member of a block, one for each
    two components that any link joins: a component is connected already. A
    pair counts if either needs a hot signature; it is looked at by a bitmap
    of 16 bits an element and, where that does not rule it out, exactly."""
    rows = rows.reset_index(drop=True)
    once = rows.drop_duplicates(["node", "digest", "text"]).reset_index(drop=True)
    sets: list[np.ndarray] = []
    for i in range(0, len(once), 256):
        sets += shingle_sets([(x or "").encode() for x in once["text"][i:i + 256]])
    # a document id may be repeated with another text: that of the digest counts
    own = [i for i, (h, d) in enumerate(zip(sets, once["digest"])) if _digest(h) == d]
    members = once.iloc[own].drop_duplicates("tag")
    sets, members = [sets[i] for i in members.index], members.reset_index(drop=True)
    place = pd.Series(members.index, index=members["tag"])
    n, comp, node, needs = (members[c].to_numpy() for c in ("n", "component", "node", "needs"))
    side = lambda left: np.unique(place.reindex(rows.loc[rows["left"] == left, "tag"]).dropna().to_numpy(np.int64))
    lefts, rights = side(True), side(False)
    width = min(1 << max(6, int(16 * n.max(initial=1) - 1).bit_length()), MAX_BITS)
    bits = np.zeros((len(sets), width), dtype=bool)
    for b, h in zip(bits, sets):
        b[(h & _U(width - 1)).astype(np.int64)] = True
    bits = np.packbits(bits, axis=1).view(np.uint64)
    joined: dict[int, set[int]] = {}
    u, v = [], []
    percent = round(t * 100)
    for x in lefts:
        known = joined.setdefault(comp[x], {comp[x]})
        y = rights[~np.isin(comp[rights], list(known)) & (needs[x] | needs[rights])]
        y = y[np.minimum(n[x], n[y]) >= t * np.maximum(n[x], n[y])]
        if len(y):
            apart = np.bitwise_count(bits[y] ^ bits[x]).sum(axis=1, dtype=np.int64)
            y = y[apart <= (1 - t) / (1 + t) * (n[x] + n[y]) + 1e-6]
        if len(y):
            both = _shared_counts(sets[x], [sets[k] for k in y])
            for k in y[100 * both >= percent * (n[x] + n[y] - both)]:
                if comp[k] not in known:
                    known.add(comp[k])
                    u.append(node[x])
                    v.append(node[k])
    return pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})


def open_members(members: DataFrame, sets: DataFrame, linked: DataFrame) -> DataFrame:
    """(family, tag, node, n, digest, component, needs): the members of hot
    signatures that still hold several components. The groups of a family of
    near copies overlap in most members, so they are taken together: a family
    is named by the component with most members in the group."""
    named = sets.select("tag", F.col("rep").alias("node"), "n", "digest").join(linked, "node", "left").select(
        "tag", "node", "n", "digest", F.coalesce("component", "node").alias("component"))
    m = written(members.join(named, "tag"), "named-members")
    per = m.groupBy("sig", "component").agg(F.count(F.lit(1)).alias("k"))
    open_ = per.groupBy("sig").agg(F.max_by("component", F.struct("k", -F.col("component"))).alias("family"),
                                   F.count(F.lit(1)).alias("apart")).where("apart > 1").select("sig", "family")
    return written(m.join(small_side(open_), "sig").groupBy(
        "family", "tag", "node", "n", "digest", "component").agg(F.max("needs").alias("needs")), "open-members")


def family_hubs(own: DataFrame, turn: int) -> DataFrame:
    """(a, b): every member outside its family's component with a few members
    inside it and a few outside, other ones in each turn."""
    out = F.col("component") != F.col("family")
    low = [F.min(F.when(side, F.struct(F.xxhash64("tag", F.lit(turn * HUBS + j)).alias("h"), "tag")))
           .alias(f"hub{k}{j}") for k, side in enumerate((out, ~out)) for j in range(HUBS)]
    hubs = own.groupBy("family").agg(*low)
    hubs = hubs.select("family", F.explode(F.array_distinct(F.array_compact(F.array(
        *[F.col(f"{c}.tag") for c in hubs.columns[1:]])))).alias("hub"))
    return own.where(out).select("family", "tag").join(small_side(hubs), "family").where("hub != tag").select(
        F.least("hub", "tag").alias("a"), F.greatest("hub", "tag").alias("b")).distinct()


def hot_links(own: DataFrame, texts: DataFrame, t: float) -> DataFrame:
    """The links that only hot signatures show, but for those inside a
    component: between a member outside its family's component (left) and any
    other (right). Both sides are cut into blocks, and a task gets a block of
    either with their texts, so a family of F members of which k are outside
    takes F * k / BLOCK rows, about F as long as k stays below a block."""
    outside = F.col("component") != F.col("family")
    sizes = own.groupBy("family").agg(F.count_if(outside).alias("lefts"), F.count(F.lit(1)).alias("rights"),
                                      F.max("n").alias("widest"))
    room = F.greatest(F.lit(16), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_ELEMENTS) / F.col("widest"))))
    blocks = sizes.where("lefts > 0").select("family", *[F.ceil(F.col(c) / room).cast("int").alias(c) for c in ("lefts", "rights")])
    at = lambda blocks_: F.pmod(F.xxhash64("tag"), F.col(blocks_)).cast("int")
    spots = lambda side, spot: F.transform(F.sequence(F.lit(0), F.col(side) - 1), spot)
    place = lambda i, j, left: F.struct(i.alias("i"), j.alias("j"), F.lit(left).alias("left"))
    as_left = F.when(outside, spots("rights", lambda j: place(at("lefts"), j, True))).otherwise(F.array())
    as_right = spots("lefts", lambda i: place(i, at("rights"), False))
    placed = own.join(small_side(blocks), "family").withColumn("p", F.explode(F.concat(as_left, as_right))).select(
        "family", "p.i", "p.j", "p.left", "tag", "node", "n", "digest", "component", "needs").join(
        texts.where("member").select(F.col("need").alias("node"), "text"), "node")
    found = placed.groupBy("family", "i", "j").applyInPandas(lambda x: _linked_across(x, t), "u long, v long")
    return written(found.distinct(), "hot-links")


def near_duplicates(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: id, n_shingles, component_id.

    Documents are linked when the Jaccard similarity of their sets of distinct
    5-word shingles is ``similarity`` (a whole percentage from 0.5 to 1) or
    more; component_id is the smallest id reachable by links, the row's own
    included. Equal sets are one set, so copies cost no pairs. Null and empty
    texts, and texts without words, have an empty set and are linked with
    nothing: their component is their own id. Rows of null id are counted but
    are no one's component; with no other copy their component is null.
    Repeated rows are each returned. Other columns are not looked at. An empty
    table gives an empty result.
    """
    if not 0.5 <= similarity <= 1:
        raise ValueError("similarity must lie between 0.5 and 1")
    t = similarity
    d = written(describe(rows, id_col, text_col, t), "sets")
    found = written(group_signatures(signature_rows(rows, text_col, t)), "grouped")
    hot = found.where("NOT pair").select(
        F.col("a").alias("sig"), F.shiftright("b", 3).alias("tag"),
        F.shiftright("b", 1).bitwiseAND(F.lit(3)).cast("int").alias("role")).distinct()
    hot_own = hot.groupBy("tag").agg(*[F.count_if(F.col("role") == r).alias(f"hot{r}") for r in (OWN, BELOW)])
    distinct = d.where("n > 0").groupBy("digest").agg(
        F.min("id").alias("rep"), F.first("tag").alias("tag"), F.first("n").alias("n"),
        F.first("slack").alias("slack")).where("rep IS NOT NULL")
    spare = F.least(*[F.get("slack", F.lit(r)) - F.coalesce(f"hot{r}", F.lit(0)) for r in (OWN, BELOW)])
    sets = written(distinct.join(hot_own, "tag", "left").select(
        "digest", "rep", "tag", "n", "slack", spare.alias("spare")), "distinct_sets")
    members = written(needing(hot, sets), "members")
    first = shared_enough(found, sets).unionByName(hub_pairs(members)).distinct()
    pairs = written(bits_fit(first, sets, d, t), "pairs")
    held = sets.join(members.select("tag").distinct(), "tag", "left_semi").select("rep")
    texts = fetch_texts(rows, pairs.select(F.explode(F.array("id_a", "id_b"))), held, id_col, text_col)
    links = verify(pairs, texts, t)
    # connected labels are enough here: they only save comparisons
    labels = written(components(links, "u", "v", rounds=1), "labels")
    own = open_members(members, sets, labels)
    before = None
    for turn in range(1, HUB_TURNS):
        wide = written(own.groupBy("family").agg(
            F.count_if(F.col("component") != F.col("family")).alias("lefts"), F.count(F.lit(1)).alias("rights")).where(
            (F.col("lefts") > BLOCK) & (F.col("rights") - F.col("lefts") >= LINKED * F.col("rights"))), "wide-families")
        left = wide.agg(F.coalesce(F.sum("lefts"), F.lit(0))).first()[0]
        if not left or before is not None and left > GAIN * before:
            break                       # a block holds what is outside, or hubs do not help
        before = left
        narrow = own.join(small_side(wide, is_written=True), "family", "left_semi")
        closer = written(bits_fit(family_hubs(narrow, turn), sets, d, t), "hub-pairs")
        links = written(links.unionByName(verify(closer, texts, t, "member")), "links")
        labels = written(components(links, "u", "v", rounds=1), "labels")
        own = open_members(members, sets, labels)
    more = hot_links(own, texts, t)
    linked = written(components(links.unionByName(more), "u", "v"), "linked")
    of_set = sets.select("digest", F.col("rep").alias("node")).join(linked, "node", "left").select(
        "digest", F.coalesce("component", "node").alias("component"))
    return d.select("id", "n", "digest").join(of_set, "digest", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.coalesce("component", "id").alias("component_id"))
