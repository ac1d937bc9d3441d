import random

from quizlens.llm import quotes as QT

SCHEMA = "conv_id long, turn long, role string, text string"


def result(df):
    return {(r.conv_id, r.turn): (r.parent, r.root, r.depth, r.text) for r in df.collect()}


def test_parse_nested_quotes():
    mail = ("I agree.\n\nBob wrote:\n> Ann wrote:\n> > Shall  we\n>> start?\n> Yes,\n> LET us\n>\n> Second part\n"
            "And more.\n\n\nBye > 1\n")
    p = QT.parse(mail)
    assert p.own == "I agree.\n\nAnd more.\n\nBye > 1"
    assert p.passages == [(0, "i agree."), (2, "shall we start?"), (1, "yes, let us"), (1, "second part"),
                          (0, "and more."), (0, "bye > 1")]
    assert QT.parse(None) == QT.parse("") == QT.Parsed("", [])
    assert QT.parse("> only quoted") == QT.Parsed("", [(1, "only quoted")])
    assert QT.parse("He wrote: fine") == QT.Parsed("He wrote: fine", [(0, "he wrote: fine")])
    assert QT.parse("\n \n").own == ""


def test_links_and_order(frame):
    rows = [(1, 0, "a", "Hello there\nfriend"), (1, 1, "b", "> hello   THERE friend\nHi"),
            (1, 2, "c", "> Hello there\n> friend\nAlso hi"), (1, 3, "a", "c wrote:\n> b wrote:\n> > Hello there friend\n> Also hi\nThanks"),
            (1, 4, "b", "> never said\nWhat?"), (1, 5, "d", "> > Also hi\nlate"), (2, 0, "a", "> Hello there friend\nother thread")]
    assert result(QT.conversations(frame(rows, SCHEMA))) == {
        (1, 0): (None, 0, 0, "Hello there\nfriend"), (1, 1): (0, 0, 1, "Hi"), (1, 2): (0, 0, 1, "Also hi"),
        (1, 3): (2, 0, 2, "Thanks"), (1, 4): (None, 4, 0, "What?"), (1, 5): (2, 0, 2, "late"),
        (2, 0): (None, 0, 0, "other thread")}


def test_original_is_the_latest_earlier_one(frame):
    rows = [(1, t, "a", "same") for t in range(0, 5000, 10)] + [(1, 2005, "b", "> same\nre"), (1, 3, "c", "> same\nre")]
    got = result(QT.conversations(frame(rows, SCHEMA)))
    assert got[1, 2005][:3] == (2000, 2000, 1) and got[1, 3][:3] == (0, 0, 1)


def test_round_trip_of_mails(frame):
    """Messages, sent as mails with two levels of quotes, come back as they were."""
    rnd = random.Random(1)
    rows = []
    for c in range(40):
        for t in range(rnd.randrange(1, 9)):
            rows.append((c, t, rnd.choice("ab"), "\n".join(
                " ".join(rnd.choice("uvwxyz") * 3 for _ in range(rnd.randrange(1, 6))) + str(rnd.random())
                for _ in range(rnd.randrange(1, 4)))))
    rows += [(99, t, "a", f"link {t}") for t in range(300)]         # a long chain
    mails = QT.as_mail(frame(rows, SCHEMA))
    assert mails.where("text LIKE '%> > %'").count() > 0
    got = result(QT.conversations(mails))
    assert got == {(c, t): (t - 1 if t else None, 0, t, x) for c, t, _, x in rows}


def test_edges(frame, empty):
    assert QT.conversations(empty(SCHEMA)).count() == 0
    assert QT.as_mail(empty(SCHEMA)).count() == 0
    rows = [(1, 0, "a", None, 1), (1, 1, None, "", 1), (None, 2, "a", "> x\nq", 1), (1, None, "a", "r", 1),
            (3, 0, "a", "twin", 1), (3, 0, "a", "twin", 1), (3, 1, "b", "> twin\nyes", 1), (3, 2, "c", "z " * 100_000, 1)]
    df = frame(rows, "conv_id long, turn long, role string, text string, root int")
    got = QT.conversations(df).collect()
    assert len(got) == len(rows)
    assert sorted(((r.conv_id, r.turn, r.parent, r.root, r.depth) for r in got), key=repr) == sorted([
        (1, 0, None, 0, 0), (1, 1, None, 1, 0), (None, 2, None, 2, 0), (1, None, None, None, 0),
        (3, 0, None, 0, 0), (3, 0, None, 0, 0), (3, 1, 0, 0, 1), (3, 2, None, 2, 0)], key=repr)
