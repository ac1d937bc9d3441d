"""Longest-processing-time sharding: whole groups, balance, gapless slots."""
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quizlens.llm import sharding as SH

SCHEMA = "doc_id long, text string"


def shards_of(df, **kw):
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 8
    return SH.shard_rows(df, "doc_id", SH.text_key("text"), size, **kw)


def check(rows, got, shards):
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    home, slots, load = {}, defaultdict(list), Counter({k: 0 for k in range(shards)})
    for r in got:
        assert home.setdefault(r.text or "", r._sh_shard) == r._sh_shard
        assert r._sh_size == len((r.text or "").encode()) + 8
        slots[r._sh_shard].append(r._sh_slot)
        load[r._sh_shard] += r._sh_size
    assert set(slots) <= set(range(shards)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    return load


def brute(rows, shards):
    """Loads of the plain rule: all groups by falling size, each to the least loaded shard."""
    size = Counter()
    for _, t in rows:
        size[t or ""] += len((t or "").encode()) + 8
    load = [0] * shards
    for s in sorted(size.values(), reverse=True):
        load[load.index(min(load))] += s
    return load


@pytest.mark.parametrize("least_parts", [1, 7, 64])
def test_balance_against_the_plain_rule(frame, least_parts):
    rng = random.Random(3)
    rows = [(i, "é" * int(rng.paretovariate(1.1) * 10)) for i in range(2000)]
    rows += [(5000 + i, "copied text") for i in range(700)]
    load = check(rows, shards_of(frame(rows, SCHEMA), least_parts=least_parts).collect(), 24)
    want = brute(rows, 24)
    biggest = max(want)
    assert sum(load.values()) == sum(want)
    assert max(load.values()) <= max(biggest, 1.02 * sum(want) / 24)
    if least_parts == 1:
        # one part and as many bins as shards is the plain rule itself
        groups = frame([(t.encode() or b"-", n) for t, n in sizes(rows).items()], "group binary, bytes long")
        placed = SH.schedule_groups(groups, 24, 1, bins=1).groupBy("shard").agg(F.sum("bytes").alias("b")).collect()
        assert sorted(r.b for r in placed) == sorted(want)


def sizes(rows):
    out = Counter()
    for _, t in rows:
        out[t] += len(t.encode()) + 8
    return out


def test_hot_group_has_a_shard_to_itself(frame):
    rows = [(i, f"text {i}") for i in range(600)] + [(1000 + i, "hot") for i in range(600)]
    got = shards_of(frame(rows, SCHEMA), many=10).collect()
    load = check(rows, got, 24)
    hot = next(r._sh_shard for r in got if r.text == "hot")
    rest = [v for k, v in load.items() if k != hot]
    assert load[hot] == 600 * 11 and max(rest) - min(rest) <= 40


def test_does_not_depend_on_row_order(frame):
    rows = [(i, f"text {i % 300} " * (i % 7)) for i in range(900)]
    key = lambda rs: sorted((r.doc_id, r._sh_shard, r._sh_slot) for r in rs)
    a, b = shards_of(frame(rows, SCHEMA)).collect(), shards_of(frame(rows[::-1], SCHEMA, parts=5)).collect()
    assert key(a) == key(b)


def test_edges(frame, empty):
    assert shards_of(empty(SCHEMA)).collect() == []
    rows = [(None, None), (None, ""), (1, None), (1, "a"), (1, "a"), (2, "x" * 300_000)]
    got = shards_of(frame(rows, SCHEMA), shards=3).collect()
    load = check(rows, got, 3)
    assert max(load.values()) == 300_008
    clash = frame([(1, "a", "p", 2)], "doc_id long, text string, part string, n long")
    assert shards_of(clash).columns[:4] == ["doc_id", "text", "part", "n"]
    with pytest.raises(ValueError):
        shards_of(frame([(1, "a", 2)], "doc_id long, text string, _sh_slot long"))
    one = shards_of(frame([(1, "a"), (2, "b")], SCHEMA), shards=1).collect()
    assert {r._sh_shard for r in one} == {0} and {r._sh_slot for r in one} == {0, 1}


def test_schedule_is_largest_first():
    assert SH.schedule([(5, "a"), (4, "b"), (3, "c"), (3, "d")], 2) == {"a": 0, "b": 1, "c": 1, "d": 0}


def test_written_shards_hold_their_rows_in_order(spark, frame, tmp_path):
    rows = [(i, f"text {i % 50}") for i in range(200)]
    SH.write_shards(shards_of(frame(rows, SCHEMA), shards=4), str(tmp_path / "out"), block_rows=20)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and set(back.columns) >= {"doc_id", "text", "shard", "_sh_slot"}


def test_query_contract(spark):
    from quizlens.llm import queries as Q
    sf = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = Q.QUERIES["op12_sharding"](spark, sf).collect()
    load, home, slots = Counter(), {}, defaultdict(list)
    for r in got:
        raw = text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        assert home.setdefault(raw, r.shard) == r.shard
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(got) == len(text) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) <= 1.1 * sum(load.values()) / 24
