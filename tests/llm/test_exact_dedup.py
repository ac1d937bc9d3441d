import hashlib
import random
from collections import defaultdict

import pytest

from quizlens.llm import exact_dedup as ED

AZ = {c: c + 32 for c in range(65, 91)}


def brute(rows, largest):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(AZ)].append(i)
    out = []
    for i, t in rows:
        low = (t or "").translate(AZ)
        ids = [x for x in groups[low] if x is not None]
        keep = (max(ids) if largest else min(ids)) if ids else None
        out.append((i, keep, len(groups[low]), hashlib.sha256(low.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("fan,rounds", [(2, 1), (2, 3), (4, 2), (64, 2)])
@pytest.mark.parametrize("largest", [True, False])
def test_equals_brute_force(frame, fan, rounds, largest):
    rnd = random.Random(fan * 10 + rounds)
    rows = [(i, rnd.choice(["", "a", "A", "b c", "É", "é", None, f"t{rnd.randrange(40)}", "hot"])) for i in range(400)]
    rows += [(7, "again"), (7, "again"), (None, "alone"), (None, "a"), (8, "x" * 200_000), (9, "X" * 200_000)]
    got = ED.exact_dedup(frame(rows, "doc_id long, text string", 7), keep_largest=largest, fan=fan, rounds=rounds)
    r = got.collect()
    assert sorted(((x.doc_id, x.keep_id, x.group_size, x.text_sha256) for x in r), key=repr) == brute(rows, largest)
    kept = defaultdict(list)
    for x in r:
        kept[x.text_sha256].append((x.kept, x.doc_id, x.keep_id))
    for rows_ in kept.values():
        assert sum(k for k, _, _ in rows_) == 1          # repeated rows too: one stays
        assert all(i == keep for k, i, keep in rows_ if k)


def test_hot_text(frame):
    rows = [(i, "same" if i % 3 == 0 else f"t{i}") for i in range(900)]
    got = ED.exact_dedup(frame(rows, "doc_id long, text string", 9)).where("group_size > 1")
    assert got.count() == 300 and got.where("kept").collect()[0].doc_id == 0


def test_empty_table_and_clashing_columns(frame, empty):
    assert ED.exact_dedup(empty()).count() == 0
    assert ED.drop_exact_copies(empty()).count() == 0
    rows = [(1, "a", "x", 5), (2, "A", "y", 6), (3, None, "z", 7), (4, "", "w", 8)]
    df = frame(rows, "doc_id long, text string, digest string, size long")
    assert {r.doc_id for r in ED.exact_dedup(df).where("kept").collect()} == {1, 3}
    kept = ED.drop_exact_copies(df, keep_largest=True)
    assert kept.columns == df.columns
    assert {tuple(r) for r in kept.collect()} == {(2, "A", "y", 6), (4, "", "w", 8)}


def test_copies_with_repeated_and_null_ids(frame):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "c"), (None, "c"), (None, "a")]
    kept = ED.drop_exact_copies(frame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=repr) == [(1, "a"), (1, "b"), (None, "c")]


def test_clashing_columns(frame):
    rows = frame([(1, "a", 1, 2, "x"), (2, "A", 3, 4, "y"), (3, "b", 5, 6, "z")],
                 "doc_id long, text string, _ed_n int, _ed_key int, text_sha256 string")
    got = ED.drop_exact_copies(rows, keep_largest=True)
    assert got.columns == rows.columns and sorted(map(tuple, got.collect())) == [(2, "A", 3, 4, "y"), (3, "b", 5, 6, "z")]
