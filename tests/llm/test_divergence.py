"""The divergence audit against a plain computation with Python's whole numbers."""
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quizlens.llm import divergence as DV

SCHEMA = "doc_id long, text string, lang string, source string"
AZ = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_docs=3, ranks=200):
    n, in_docs, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(AZ))
        n[lang, source].update(terms)
        in_docs[lang].update(set(terms))
        sources[lang].add(source)
    out = set()
    for lang in sources:
        kept = [t for t, k in in_docs[lang].items() if k >= min_docs]
        everything = Counter()
        for s in sources[lang]:
            everything.update(n[lang, s])

        def ps(count):
            total = sum(count[t] for t in kept) + len(kept)
            return {t: 1 + 10 ** 9 * (count[t] + 1) // total for t in kept}

        p = {s: ps(n[lang, s]) for s in sources[lang]}
        whole = ps(everything)
        f = lambda x, y: (x - y) ** 2 // y
        for s in sources[lang]:
            pair = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources[lang] if o != s]
            term = [(f(p[s][t], whole[t]), t) for t in kept if n[lang, s][t] and p[s][t] > whole[t]]
            for part, found, top in (("pair", pair, None), ("term", term, ranks)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(found[:top])}
    return out


def check(frame, rows, **kw):
    got = [tuple(r) for r in DV.audit(frame(rows, SCHEMA), **kw).collect()]
    kw = {k: v for k, v in kw.items() if k in ("min_docs", "ranks")}
    assert len(got) == len(set(got)) and set(got) == brute(rows, **kw)


WORDS = ["a", "B", "b", "the", "Ärger", "ärger", "日本", "x1y", "don't", "aa", "ab", "ac", "😀"]


def some_rows(n=150, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        text = " ".join(WORDS[k] for k in rng.zipf(1.5, rng.integers(0, 30)) % len(WORDS))
        rows.append((i, text, ["en", "de", None][i % 3], f"s{rng.integers(0, 6)}" if i % 11 else None))
    return rows + [(999, "", "en", "empty"), (998, None, "en", "none"), (997, "only once", "fr", "x"), (996, "1 2 3", "fr", "y")]


@pytest.mark.parametrize("kw", [{}, {"block_terms": 2}, {"tile": 2, "block_terms": 3}, {"ranks": 2, "tile": 1}])
def test_equals_brute_force(frame, kw):
    check(frame, some_rows(), **kw)


def test_documents_equal_brute_force(spark, frame):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    check(frame, rows, block_terms=500)


def test_edges(frame, empty):
    assert DV.audit(empty(SCHEMA)).collect() == []
    check(frame, [(1, "alone", "en", "a")])
    check(frame, [(None, "w " * 5, None, None)] * 4 + [(1, "w v v v", None, "b")] * 3)
    clash = frame([(1, "a a", "en", "x", 3, "t")] * 3, "doc_id long, text string, lang string, source string, n long, term string")
    assert DV.audit(clash).count() == 0


def test_long_text_is_read_whole(frame):
    long = "word " * 1_000_000 + "tail"
    check(frame, [(1, long, "en", "a"), (2, "tail word", "en", "b"), (3, "tail word", "en", "b")])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), min_size=1, max_size=20), min_size=2, max_size=5))
def test_meetings_count_every_term(rows):
    width = min(map(len, rows))
    m = np.array([r[:width] for r in rows])
    trees = DV.Trees(m)
    for x in range(len(m)):
        for y in range(len(m)):
            a, b, n = trees.meetings(x, y)
            assert dict(zip(zip(a.tolist(), b.tolist()), n.tolist())) == Counter(zip(m[x].tolist(), m[y].tolist()))


def test_equal_subtrees_share_nodes():
    trees = DV.Trees(np.zeros((3, 1024), int))
    assert [len(left) for left, _ in trees.levels] == [1] * 10
    assert len(trees.meetings(0, 1)[0]) == 1


@given(st.integers(0, 10 ** 14), st.integers(1, 10 ** 15))
def test_shares_are_exact(count, more):
    total = count + more
    assert DV.shares(np.array([count]), total)[0] == 1 + 10 ** 9 * (count + 1) // total
