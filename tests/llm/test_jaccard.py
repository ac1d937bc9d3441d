import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quizlens.llm import jaccard as J
from quizlens.llm.components import components
from quizlens.llm.shingles import shingle_sets

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
AZ = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text):
    return WORD.findall((text or "").encode().translate(AZ))


def shingles_of(text):
    w = words_of(text)
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, percent=75):
    """{id: (size, component)} by counting shared shingles over all texts."""
    sets = {i: shingles_of(t) for i, t in rows}
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    shared = Counter(p for ids in where.values() for p in itertools.combinations(sorted(ids), 2))
    group = {i: {i} for i in sets}
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n) and group[a] is not group[b]:
            merged = group[a] | group[b]
            for x in merged:
                group[x] = merged
    return {i: (len(s), min(group[i])) for i, s in sets.items()}


def corpus(seed, n=120):
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)]
    passage = " ".join(rnd.choice(vocab) for _ in range(55))
    texts = []
    for _ in range(n):
        size = rnd.choice([0, 1, 2, 3, 4, 5, 6, 7, 9, 12, 20, 40, 90, 200])
        w = [rnd.choice(vocab) for _ in range(size)]
        kind = rnd.random()
        if kind < .5 and texts:                       # an edited copy of an earlier text
            w = (rnd.choice(texts) or "").split()
            for _ in range(rnd.randrange(0, 1 + len(w) // 12)):
                k = rnd.randrange(len(w))
                w[k:k + rnd.choice([0, 1, 2])] = [rnd.choice(vocab)] * rnd.choice([0, 1])
        elif kind < .7:                               # a passage that many texts share
            w = w[:size // 2] + passage.split() + w[size // 2:]
        texts.append(" ".join(w))
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,hot", [(1, 16), (2, 16), (3, 2), (4, 1), (5, 3)])
def test_equals_brute_force(frame, monkeypatch, seed, hot):
    # the value travels to the workers with the pickled task
    monkeypatch.setattr(J, "HOT", hot)
    rows = corpus(seed)
    got = J.near_duplicates(frame(rows, "doc_id long, text string", 5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_group_of_near_copies_is_linked_whole(frame):
    """More near copies of one text than a signature may have, some only
    linked by way of others."""
    rnd = random.Random(9)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rnd.randrange(0, 7)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10 ** 6)}"
        rows.append((i, " ".join(w)))
    got = J.near_duplicates(frame(rows, "doc_id long, text string", 6)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_edges(frame, empty):
    assert J.near_duplicates(empty()).count() == 0
    long_ = " ".join(f"w{k}" for k in range(60_000))
    rows = [(5, None, 1, "a"), (4, "", 2, "b"), (3, "\t \n", 3, "c"), (9, "One two", 4, "d"), (2, "one\x0btwo", 5, "e"),
            (11, long_, 6, "f"), (10, long_ + " end", 7, "g"), (None, "one two", 8, "h"), (None, "alone here", 9, "i"),
            (2, "one\x0btwo", 5, "e")]
    got = J.near_duplicates(frame(rows, "doc_id long, text string, n long, digest string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == sorted([
        (5, 0, 5), (4, 0, 4), (3, 0, 3), (9, 1, 2), (2, 1, 2), (2, 1, 2), (11, 59_996, 10), (10, 59_997, 10),
        (None, 1, 2), (None, 1, None)], key=repr)


@pytest.mark.parametrize("order", [1, -1])
def test_two_texts_under_one_id(frame, order):
    """Each text of the repeated id keeps its own links, in either order."""
    one, two = (" ".join(f"{c}{k}" for k in range(40)) for c in "xy")
    texts = frame([(2, t, True) for t in (one, two)][::order] + [(3, one, True), (4, two, True)],
                  "need long, text string, paired boolean", parts=1)
    d = {t: J._digest(h) for t, h in zip((one, two), shingle_sets([one.encode(), two.encode()]))}
    pairs = frame([(2, 3, d[one], d[one]), (2, 4, d[two], d[two])],
                  "id_a long, id_b long, digest_a binary, digest_b binary", parts=1)
    assert {(r.u, r.v) for r in J.verify(pairs, texts, 0.75).collect()} == {(2, 3), (2, 4)}
    rows = [(2, t) for t in (one, two)][::order] + [(3, one), (4, two)]
    got = J.near_duplicates(frame(rows, "doc_id long, text string", parts=1)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(2, 2), (2, 2), (3, 2), (4, 2)]


def test_shingle_sets_agree_with_tuples():
    texts = [t.encode() for _, t in corpus(7, 60)] + [b"", b" A b\tC\x0cd  e f ", "é É ü x".encode()]
    for t, s in zip(texts, shingle_sets(texts)):
        assert len(s) == len(shingles_of(t.decode())) and (np.diff(s.astype(object)) > 0).all()
    assert (shingle_sets([b"A B c D e"])[0] == shingle_sets([b"a b C d E"])[0]).all()


@pytest.mark.parametrize("t", [0.5, 0.75, 0.9, 1.0])
def test_pigeonhole_covers_every_similar_pair(t):
    """Any two sets that are similar enough share a signature, by the rule
    alone: sets are drawn without texts."""
    rng = np.random.default_rng(int(t * 100))
    for size in [*range(1, 40), 64, 100, 127, 128, 300]:
        for _ in range(6):
            x = np.unique(rng.integers(0, 2 ** 63, size, dtype=np.uint64))
            common = x[:max(1, int(np.ceil(len(x) * rng.uniform(t, 1))))]
            extra = rng.integers(0, 2 ** 63, rng.integers(0, 1 + size // 3), dtype=np.uint64)
            y = np.unique(np.concatenate((common, extra)))
            both = len(np.intersect1d(x, y))
            if both / (len(x) + len(y) - both) < t:
                continue
            sx = {int(s) for _, a, _ in J.signatures(x, t) for s in a}
            sy = {int(s) for _, a, _ in J.signatures(y, t) for s in a}
            assert sx & sy


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500}


def test_components_without_links(spark):
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_more_hub_rounds_and_blocks_lose_no_link(frame, monkeypatch):
    """Two groups of near copies with a passage in common, with blocks and
    hubs so few that rounds, blocks and several families are needed."""
    monkeypatch.setattr(J, "BLOCK", 8)
    monkeypatch.setattr(J, "HUBS", 1)
    monkeypatch.setattr(J, "HOT", 4)
    monkeypatch.setattr(J, "LINKED", 0.0)
    rnd = random.Random(11)
    passage = [f"p{k}" for k in range(60)]
    bases = [passage + [f"{c}{k}" for k in range(80)] for c in "ab"]
    rows = []
    for i in range(100):
        w = list(bases[i % 2]) if i < 70 else passage + [f"z{i}x{k}" for k in range(rnd.randrange(5, 60))]
        for _ in range(rnd.randrange(0, 6)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10 ** 6)}"
        rows.append((i, " ".join(w)))
    got = J.near_duplicates(frame(rows, "doc_id long, text string", 4)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_hubs_of_a_member_do_not_grow_with_its_signatures(frame):
    """Members of many hot groups that overlap: each has its hubs, those it
    shares most groups with, and the pairs stay within HUBS a member."""
    rnd = random.Random(13)
    groups = {sig: rnd.sample(range(60), 40) for sig in range(50)}
    rows = [(sig, tag, True) for sig, tags in groups.items() for tag in tags]
    rows += [(sig, 100 + sig, False) for sig in groups]                # others need them, these do not
    got = J.hub_pairs(frame(rows, "sig long, tag long, needs boolean", 4)).collect()
    pairs = {(r.a, r.b) for r in got}
    assert len(pairs) == len(got) <= J.HUBS * 60
    assert {x for p in pairs for x in p} == set(range(60))
    assert all(a < b and any(a in g and b in g for g in groups.values()) for a, b in pairs)
    near = frame([*((s, t, True) for s in range(9) for t in (1, 2)), (9, 1, True), *((9, t, True) for t in range(3, 40))],
                 "sig long, tag long, needs boolean", 4)
    assert (1, 2) in {(r.a, r.b) for r in J.hub_pairs(near).collect()}
