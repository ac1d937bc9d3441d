import random

import pytest

from quizlens.llm import langid as LG

SCHEMA = "doc_id long, text string, lang string, score double"
SYLLABLES = {"aa": ["ka", "to", "mi", "re"], "bb": ["sch", "ung", "ei", "pf"], "cc": ["eau", "oi", "ça", "tion"]}


def text(rnd, lang, n):
    return " ".join("".join(rnd.choices(SYLLABLES[lang], k=rnd.randrange(1, 4))) for _ in range(n)).capitalize() + "."


def corpus(seed, n):
    rnd = random.Random(seed)
    return [(i, text(rnd, lang, rnd.choice([15, 60, 300])), lang, 0.0) for i in range(n) for lang in [rnd.choice(list(SYLLABLES))]]


def test_held_out_accuracy(frame):
    learned = LG.learn(frame(corpus(1, 300), SCHEMA), "doc_id", "text", "lang")
    assert sorted(learned) == sorted(SYLLABLES) and all(len(d) <= LG.DICTIONARY_BYTES for d in learned.values())
    test = corpus(2, 300)
    got = {r.doc_id: r for r in LG.identify(frame(test, SCHEMA), learned, columns=("doc_id",), min_margin=0.0).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang, _ in test) >= 0.98 * len(test)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_rejects_narrow_margins_and_letterless_texts(frame):
    learned = LG.learn(frame(corpus(1, 200), SCHEMA), "doc_id", "text", "lang")
    rnd = random.Random(3)
    both = " ".join(text(rnd, lang, 40) for _ in range(6) for lang in ("aa", "bb"))
    rows = [(1, None, "aa", 0.0), (2, "", "aa", 0.0), (3, "12 !! _ 34", "aa", 0.0), (4, both, "aa", 0.0),
            (5, text(rnd, "bb", 100_000), "aa", 0.0), (5, text(rnd, "cc", 50), None, 0.0), (None, text(rnd, "aa", 50), "x", 0.0)]
    df = frame(rows, SCHEMA)
    sure = {(r.doc_id, r.lang_pred) for r in LG.identify(df, learned, columns=("doc_id", "lang"), min_margin=0.02).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "und"), (5, "bb"), (5, "cc"), (None, "aa")} == sure
    any_ = {r.doc_id: r.lang_pred for r in LG.identify(df.where("doc_id = 4"), learned, columns=("doc_id",), min_margin=0.0).collect()}
    assert any_[4] in ("aa", "bb")


def test_nothing_learned_and_empty_tables(frame, empty):
    assert LG.learn(empty(SCHEMA), "doc_id", "text", "lang") == {}
    assert LG.learn(frame([(1, None, "aa", 0.0), (2, "x", None, 0.0)], SCHEMA), "doc_id", "text", "lang") == {}
    assert LG.identify(empty(SCHEMA), {"aa": b"kato"}).count() == 0
    r = LG.identify(frame([(1, "kato", "aa", 0.0)], SCHEMA), {}).collect()[0]
    assert (r.lang_pred, r.score) == ("und", 0.0)
    one = LG.identify(frame([(1, "kato", "aa", 0.0)], SCHEMA), {"aa": b"kato mire"}).collect()[0]
    assert (one.lang_pred, one.score) == ("aa", 1.0)


def test_the_order_of_rows_does_not_matter(frame):
    rows = corpus(5, 60)
    assert LG.learn(frame(rows, SCHEMA, 2), "doc_id", "text", "lang") == LG.learn(
        frame(rows[::-1], SCHEMA, 5), "doc_id", "text", "lang")


def test_many_languages_share_the_room(frame):
    rows = [(i, f"word{i % 300} text " * 400, f"l{i % 300:03d}", 0.0) for i in range(900)]
    learned = LG.learn(frame(rows, SCHEMA), "doc_id", "text", "lang", all_bytes=300 * 2000)
    assert len(learned) == 300 and {len(d) for d in learned.values()} == {2000}
    assert LG.Classifier(learned, 0.0).classify("word7 text word7 text")[0] == "l007"


def test_dictionaries_are_the_first_bytes_of_the_sampled_texts(frame):
    rows = [(i, f"Text {i} é " * (50 * i + 1), "aa", 0.0) for i in range(40)]
    got = LG.learn(frame(rows, SCHEMA), "doc_id", "text", "lang", all_bytes=5000)["aa"]
    order = [r.id for r in frame(rows, SCHEMA).selectExpr("doc_id AS id", "xxhash64(doc_id, 7) AS h").orderBy("h", "id").collect()]
    want = b""
    for i in order:
        want += b"\n" + rows[i][1].lower().encode()
    assert got == want[:5000]


@pytest.mark.parametrize("text", ["²³ ½", "①", "１２", "", None, "…!"])
def test_no_letter_is_undetermined(text):
    assert LG.Classifier({"aa": b"kato"}, 0.0).classify(text) == ("und", 0.0)


def test_equals_a_plain_loop(spark):
    """Every document against every dictionary, compressed one by one."""
    import zstandard as zstd
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    learned = LG.learn(docs.where("doc_id % 3 <> 1"), "doc_id", "text", "lang")
    got = {r.doc_id: r.lang_pred for r in LG.identify(docs, learned, columns=("doc_id",), min_margin=0.0).collect()}
    for r in docs.collect():
        sizes = {}
        for lang in sorted(learned):
            d = zstd.ZstdCompressionDict(learned[lang], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            parts = [r.text[a:a + LG.WINDOW].lower().encode() for a in range(0, len(r.text), LG.WINDOW)]
            sizes[lang] = sum(len(zstd.ZstdCompressor(dict_data=d, compression_params=LG.PARAMETERS).compress(x)) for x in parts)
        assert got[r.doc_id] == min(sorted(sizes), key=sizes.get)


def test_clashing_names_are_refused(frame):
    with pytest.raises(ValueError):
        LG.identify(frame([(1, "kato", "aa", 0.0)], SCHEMA), {}, columns=("doc_id", "score"))
