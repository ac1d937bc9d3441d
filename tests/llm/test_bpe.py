import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from quizlens.llm import bpe as B

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.vocabulary(PATH).ranks, special_tokens={})


def odd_texts():
    rnd = random.Random(5)
    out = ["", " ", "  ", "a  b", "a \n b", "x\n y", "a ", "  a", "\n a\n\n b  c \t d\u00a0 e", "a \u00a0b", "\u3000 x",
           "<|endoftext|>", "don't I'll WE'RE", "a" * 5000, "ab" * 3000, " " * 3000 + "x", "日本語" * 700, "é" * 999, "😀" * 300 + "x",
           "".join(rnd.choice("abeinrst") for _ in range(20_000)), "\x00\x01 \x7f", "1234567890" * 40]
    out += ["".join(rnd.choice("aaaabbeé ") for _ in range(rnd.randrange(1, 700))) for _ in range(80)]
    out += ["".join(chr(rnd.randrange(32, 0x2FFF)) for _ in range(400)) for _ in range(10)]
    return out


def test_equals_library_and_round_trip(library):
    enc, texts = B.Encoder(PATH, P.PATTERN), odd_texts()
    for t, ids in zip(texts, enc.encode(texts)):
        assert ids.tolist() == library.encode_ordinary(t)
        assert enc.decode(ids) == t.encode()


def test_long_pieces_equal_short_ones(monkeypatch, library):
    """The row-by-row path of long pieces, forced onto short ones."""
    monkeypatch.setattr(B, "WIDEST", 1)
    texts = odd_texts()[:40]
    for t, ids in zip(texts, B.Encoder(PATH, P.PATTERN).encode(texts)):
        assert ids.tolist() == library.encode_ordinary(t)


def test_forgets_and_goes_on(monkeypatch, library):
    monkeypatch.setattr(B, "CACHED_CHUNKS", 3)
    enc = B.Encoder(PATH, P.PATTERN)
    for t in odd_texts()[:20] * 2:
        assert enc.encode([t])[0].tolist() == library.encode_ordinary(t)


def test_pair_table():
    rnd = random.Random(0)
    pairs = {(rnd.randrange(50_000), rnd.randrange(50_000)): k for k in range(5000)}
    t = B.PairTable(pairs)
    keys = list(pairs) + [(rnd.randrange(50_000), rnd.randrange(50_000)) for _ in range(5000)]
    a, b = (np.array(x, dtype=np.int32) for x in zip(*keys))
    assert t.ranks(a, b).tolist() == [pairs.get(k, int(B.NONE)) for k in keys]
    assert B.PairTable({}).ranks(a[:3], b[:3]).tolist() == [int(B.NONE)] * 3


def test_rows(frame, empty, library):
    assert B.encode_rows(empty(), PATH, P.PATTERN).count() == 0
    rows = [(1, None, 9), (2, "", 9), (3, "Hello world", 9), (3, "Hello world", 9), (None, "w " * 100_000, 9)]
    df = frame(rows, "doc_id long, text string, n_tokens long")
    got = B.encode_rows(df, PATH, P.PATTERN, columns=("doc_id",), with_ids=True).collect()
    assert len(got) == 5
    for r in got:
        text = {1: "", 2: "", 3: "Hello world", None: "w " * 100_000}[r.doc_id]
        ids = library.encode_ordinary(text)
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_a_very_long_piece_in_n_log_n(library):
    import time
    rnd = random.Random(8)
    text = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(160_000))
    began = time.process_time()
    ids = B.Encoder(PATH, P.PATTERN).encode([text])[0]
    assert time.process_time() - began < 8
    assert library.decode(ids.tolist()) == text
    assert ids[:2000].tolist() == library.encode_ordinary(text[:20_000])[:2000]
