"""Text normalisation: clean -> tokens -> stop words -> lemmas -> text.

All steps are native column expressions (regexp_replace, split, filter,
transform), so a whole question set is cleaned in one narrow stage. Lemmas
that need a lexicon are a join (see ``lemma_dictionary``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ------------------------------------------------------------
# White space as Python's ``\s`` matches it in a str pattern (str.isspace()).
# Java's ``\s`` is ASCII only and RE2's lacks \x0B, so the class is spelled out
# once here and used by Spark and by the DuckDB oracle alike.
WS = (r"\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
URL_RE = rf"(http|www)[^{WS}]+"
NON_WORD_RE = rf"[^a-zA-Z0-9{WS}]"
SPACE_RE = rf"[{WS}]+"
# The same white space minus the ASCII part [\t\n\f\r ]: mapped to a blank
# first (a per-character lookup), so the three regexes only test ASCII.
OTHER_SPACES = ("\x0b\x1c\x1d\x1e\x1f\x85\xa0\u1680"
                "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
                "\u2028\u2029\u202f\u205f\u3000")

# All of it, as a text to strip from the ends.
STRIPPED = " \t\n\f\r" + OTHER_SPACES

# Contractions the Treebank word tokenizer splits that can survive cleaning
# (all others contain an apostrophe, which cleaning deletes).
CONTRACTIONS = {
    "cannot": ["can", "not"],
    "gimme": ["gim", "me"],
    "gonna": ["gon", "na"],
    "gotta": ["got", "ta"],
    "lemme": ["lem", "me"],
    "wanna": ["wan", "na"],
}

# English stop words (the classic 179-word list). Entries with an apostrophe
# can never match a cleaned token but are kept so the list stays the list.
STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you",
    "you're", "you've", "you'll", "you'd", "your", "yours", "yourself",
    "yourselves", "he", "him", "his", "himself", "she", "she's", "her", "hers",
    "herself", "it", "it's", "its", "itself", "they", "them", "their",
    "theirs", "themselves", "what", "which", "who", "whom", "this", "that",
    "that'll", "these", "those", "am", "is", "are", "was", "were", "be",
    "been", "being", "have", "has", "had", "having", "do", "does", "did",
    "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as",
    "until", "while", "of", "at", "by", "for", "with", "about", "against",
    "between", "into", "through", "during", "before", "after", "above",
    "below", "to", "from", "up", "down", "in", "out", "on", "off", "over",
    "under", "again", "further", "then", "once", "here", "there", "when",
    "where", "why", "how", "all", "any", "both", "each", "few", "more", "most",
    "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so",
    "than", "too", "very", "s", "t", "can", "will", "just", "don", "don't",
    "should", "should've", "now", "d", "ll", "m", "o", "re", "ve", "y", "ain",
    "aren", "aren't", "couldn", "couldn't", "didn", "didn't", "doesn",
    "doesn't", "hadn", "hadn't", "hasn", "hasn't", "haven", "haven't", "isn",
    "isn't", "ma", "mightn", "mightn't", "mustn", "mustn't", "needn",
    "needn't", "shan", "shan't", "shouldn", "shouldn't", "wasn", "wasn't",
    "weren", "weren't", "won", "won't", "wouldn", "wouldn't",
]

# Noun suffix rules (suffix, replacement), in the order they are tried.
NOUN_RULES = [
    ("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"),
    ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"),
]

# Irregular English plurals used when no lemma table is given.
IRREGULAR_NOUNS = {
    "children": "child", "feet": "foot", "geese": "goose", "men": "man",
    "mice": "mouse", "teeth": "tooth", "women": "woman", "oxen": "ox",
    "lice": "louse", "indices": "index", "matrices": "matrix",
    "vertices": "vertex", "analyses": "analysis", "criteria": "criterion",
    "phenomena": "phenomenon",
}
# -----------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_text(text) -> Column:
    """null -> ''; lower; drop URLs; drop all but ASCII letters, digits and
    white space; collapse white space; trim."""
    t = F.lower(F.coalesce(_c(text), F.lit("")))
    t = F.translate(t, OTHER_SPACES, " " * len(OTHER_SPACES))
    t = F.regexp_replace(t, r"(http|www)[^\t\n\f\r ]+", "")
    t = F.regexp_replace(t, r"[^a-zA-Z0-9\t\n\f\r ]+", "")
    t = F.regexp_replace(t, r"[\t\n\f\r ]+", " ")
    return F.trim(t)


def _split_contraction(t: Column) -> Column:
    expr = F.array(t)
    for word, parts in reversed(list(CONTRACTIONS.items())):
        expr = F.when(t == word, F.array(*[F.lit(p) for p in parts])).otherwise(expr)
    return expr


def tokenize(clean) -> Column:
    """Word tokens of a cleaned text (which holds single blanks only)."""
    words = F.filter(F.split(_c(clean), " "), lambda w: w != "")
    return F.flatten(F.transform(words, _split_contraction))


def remove_stop_words(tokens, stop_words: list[str] | None = None) -> Column:
    """Drop stop words, keeping order and repeats (not array_except)."""
    sw = STOP_WORDS if stop_words is None else stop_words
    return F.filter(_c(tokens), lambda w: ~w.isin(sw))


def join_tokens(tokens) -> Column:
    """T5: tokens joined by single blanks."""
    return F.array_join(_c(tokens), " ")


def strip(x) -> Column:
    """Without white space of any kind (tabs and line breaks too) at its ends."""
    return F.btrim(_c(x), F.lit(STRIPPED))


def normalise_email(e) -> Column:
    """E-mail as stored: stripped and lower-cased."""
    return F.lower(strip(e))


def normalise_name(n) -> Column:
    """Names as stored: stripped."""
    return strip(n)


def strip_answer(a) -> Column:
    """Answer as stored: stripped; null counts as empty."""
    return strip(F.coalesce(_c(a), F.lit("")))


def is_blank(a) -> Column:
    """True for a null answer and one of white space only."""
    return strip_answer(a) == ""


def rule_candidates(token: Column) -> Column:
    """array<struct<idx:int, form:string>>: the token itself (idx 0) and every
    noun-rule form whose suffix matches and leaves a non-empty stem."""
    forms = [F.struct(F.lit(0).alias("idx"), token.alias("form"))]
    for i, (suf, rep) in enumerate(NOUN_RULES, start=1):
        stem_len = F.length(token) - len(suf)
        form = F.concat(F.left(token, stem_len), F.lit(rep))
        forms.append(F.when(token.endswith(suf) & (stem_len > 0),
                            F.struct(F.lit(i).alias("idx"), form.alias("form"))))
    return F.array_compact(F.array(*forms))
