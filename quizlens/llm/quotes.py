"""Quotation linking: conversations in reply order, without quotes.

A message is parsed into its own text and the passages it quotes, by nesting
level. Normalised passages are hashed and joined to the messages of the same
thread that have them as their own text; the latest earlier one is what was
quoted. The parent of a message is the message its shallowest quotes point to
most often. Parents give every message a root and a depth by pointer doubling.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quizlens.llm.common import written

POSITIONS = 1000           # positions of a thread that one window looks at
MAX_ROUNDS = 64            # doublings: chains of up to 2 ** 64 replies
_MARKS = re.compile(r"\s{0,3}((?:>\s?)+)")
_WROTE = re.compile(r"\s*\S.{0,200}(?:wrote|writes|schrieb|a écrit|escribió)\s*:\s*")


class Parsed(NamedTuple):
    own: str                            # the text outside quotes
    passages: list[tuple[int, str]]     # (level, normalised passage); level 0 is the message's own


def normalise(lines: list[str]) -> str:
    """White space made single spaces, letters lower-cased: wrapping a passage
    anew does not change it."""
    return " ".join(" ".join(lines).lower().split())


def parse(text: str | None) -> Parsed:
    """Own text and passages. A line's level is its number of leading ``>``
    marks (blanks between them allowed); a passage is a run of non-blank lines
    of one level. A line such as "Ann wrote:" right before a deeper line
    introduces the quote and belongs to neither. Blank lines at the ends of
    the own text are dropped, and runs of them inside become one."""
    lines = []
    for line in (text or "").split("\n"):
        m = _MARKS.match(line)
        lines.append((m[1].count(">"), line[m.end():]) if m else (0, line))
    kept = [(lv, line) for i, (lv, line) in enumerate(lines)
            if not (i + 1 < len(lines) and lines[i + 1][0] > lv and _WROTE.fullmatch(line))]
    own: list[str] = []
    passages: list[tuple[int, str]] = []
    run: list[str] = []
    level = 0
    for lv, line in [*kept, (-1, "")]:
        if run and (lv != level or not line.strip()):
            passages.append((level, normalise(run)))
            run = []
        level = lv
        if lv == 0 and (line.strip() or (own and own[-1])):
            own.append(line.rstrip() if line.strip() else "")
        elif lv > 0 and own and own[-1]:
            own.append("")
        if line.strip():
            run.append(line)
    return Parsed("\n".join(own).strip(), passages)


def _hash(passage: str) -> int:
    return xxhash.xxh64_intdigest(passage.encode()) - 2 ** 63


def parse_rows(messages: DataFrame) -> DataFrame:
    """(thread, position, role, own, passages array<struct<level, hash>>)."""
    out = "thread long, position long, role string, own string, passages array<struct<level:int,hash:bigint>>"
    kind = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parsed = [parse(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("thread"), b.column("position"), b.column("role"), pa.array([p.own for p in parsed], pa.string()),
                 pa.array([[{"level": lv, "hash": _hash(s)} for lv, s in p.passages] for p in parsed], kind)],
                names=["thread", "position", "role", "own", "passages"])

    return messages.mapInArrow(run, out)


def link_quotes(passages: DataFrame) -> DataFrame:
    """(thread, position, parent) of the messages whose quotes are found.

    ``passages``: (thread, position, level, hash). A quote's original is the
    latest earlier message of the thread with that passage of its own: an
    as-of match over originals and quotes in order of position, in blocks of
    positions, so that a passage repeated through a long thread needs neither
    all pairs nor one long window."""
    key = ["thread", "hash"]
    p = passages.withColumn("block", F.floor(F.col("position") / POSITIONS))
    own = F.when(F.col("level") == 0, F.col("position"))
    in_block = Window.partitionBy(*key, "block").orderBy("position").rangeBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("near", F.max(own).over(in_block))
    last = p.groupBy(*key, "block").agg(F.max(own).alias("last"))
    earlier = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("far", F.max("last").over(earlier)).select(*key, "block", "far")
    quoted = p.where("level > 0").join(last, [*key, "block"]).withColumn("parent", F.coalesce("near", "far"))
    votes = quoted.where("parent IS NOT NULL").groupBy("thread", "position", "level", "parent").count()
    best = F.max(F.struct((-F.col("level")).alias("shallow"), F.col("count"), F.col("parent")))
    return votes.groupBy("thread", "position").agg(best["parent"].alias("parent"))


def with_ancestry(messages: DataFrame) -> DataFrame:
    """``messages`` (thread, position, parent, ...) plus root and depth, by
    pointer doubling: each round doubles a message's jump. A message whose
    jump has reached a root is set aside, so later rounds join only what is
    left of the long chains."""
    up = written(messages.select(
        "thread", "position", F.coalesce("parent", "position").alias("top"),
        F.col("parent").isNotNull().cast("long").alias("depth")).distinct(), "ancestry")
    done = [up.where("depth = 0")]
    live = up.where("depth > 0")
    for _ in range(MAX_ROUNDS):
        above = up.select("thread", F.col("position").alias("top"), F.col("top").alias("top2"),
                          F.col("depth").alias("more"))
        # a jump that ends on a root stays there
        moved = written(live.join(above, ["thread", "top"]).select(
            "thread", "position", F.col("top2").alias("top"), (F.col("depth") + F.col("more")).alias("depth"),
            (F.col("more") == 0).alias("done")), "ancestry")
        done.append(moved.where("done").drop("done"))
        live = moved.where("NOT done").drop("done")
        if live.isEmpty():
            break
        # what is set aside ends chains: its jump is to its root
        up = functools.reduce(DataFrame.unionByName, [*done, live])
    else:
        raise RuntimeError(f"a chain of replies did not end in {MAX_ROUNDS} doublings")
    all_ = functools.reduce(DataFrame.unionByName, done)
    return messages.join(all_.select("thread", "position", F.col("top").alias("root"), "depth"), ["thread", "position"])


def conversations(messages: DataFrame, thread: str = "conv_id", position: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """One row per message: thread, position, role, text without quotes,
    parent, root, depth (all under the names given, then parent, root, depth).

    A conversation reads in reply order when sorted by (root, depth,
    position). Messages that quote nothing known are roots. Null text counts
    as empty: no passages, a root, text "". Rows of null thread or position
    cannot be linked: they come back with their own position as root. Rows
    that repeat a thread and position count as one message for links, and each
    comes back. Other columns are not looked at. An empty table gives an empty
    result.
    """
    src = messages.select(F.col(thread).cast("long").alias("thread"), F.col(position).cast("long").alias("position"),
                          F.col(role).cast("string").alias("role"), F.col(text).alias("text"))
    parsed = written(parse_rows(src), "parsed")
    placed = parsed.where("thread IS NOT NULL AND position IS NOT NULL")
    passages = placed.select("thread", "position", F.explode("passages").alias("p")).select(
        "thread", "position", "p.level", "p.hash").distinct()
    parents = link_quotes(passages)
    named = placed.select("thread", "position").distinct().join(parents, ["thread", "position"], "left")
    tree = with_ancestry(written(named, "parents"))
    out = parsed.join(tree, ["thread", "position"], "left")
    return out.select(F.col("thread").alias(thread), F.col("position").alias(position), F.col("role").alias(role),
                      F.col("own").alias(text), "parent", F.coalesce("root", "position").alias("root"),
                      F.coalesce("depth", F.lit(0)).alias("depth"))


def as_mail(messages: DataFrame, thread: str = "conv_id", position: str = "turn", role: str = "role",
            text: str = "text") -> DataFrame:
    """The messages as a mail client sends them: each quotes the text of the
    message one position before it and, one level deeper, of the one before
    that. Joins by (thread, position), so no thread is gathered."""
    one = messages.groupBy(thread, position).agg(F.max(role).alias("r"), F.max(text).alias("t"))

    def earlier(k: int) -> DataFrame:
        marks = "> " * k
        quoted = F.concat(F.lit(marks), F.regexp_replace("t", "\n", "\n" + marks))
        return one.where(F.trim("t") != "").select(
            thread, (F.col(position) + k).alias(position), quoted.alias(f"q{k}"), F.col("r").alias(f"r{k}"))

    wrote = lambda k: F.concat(F.lit("> " * (k - 1)), F.col(f"r{k}"), F.lit(" wrote:"))
    m = messages.join(earlier(1), [thread, position], "left").join(earlier(2), [thread, position], "left")
    deep = F.when(F.col("q1").isNotNull() & F.col("q2").isNotNull(), F.concat_ws("\n", wrote(2), "q2"))
    body = F.concat_ws("\n", F.when(F.col("q1").isNotNull(), wrote(1)), deep, "q1", F.col(text))
    return m.select(thread, position, role, body.alias(text))
