"""Lemmas as a join (T4).

The lemma of a token is looked up in a (token, lemma) table; failing that,
the noun suffix rules are tried and a form is accepted only if a lexicon
(a table of known words) holds it; among accepted forms the shortest wins,
ties going to the earlier rule, the token itself first. Unknown tokens stay.

Work is done on the distinct tokens (partially aggregated); the changes found
are joined to each row's distinct tokens and applied to its list in place, so
order, repeats and empty lists survive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlens.functions import text as TX
from quizlens.session import small_side, spread, written


def lemma_dictionary(tokens: DataFrame, lemmas: DataFrame | None = None,
                     lexicon: DataFrame | str | None = None, token: str = "token") -> DataFrame:
    """(token, lemma) for every distinct token of ``tokens``. ``lexicon`` is a
    table of known words, or ``"corpus"`` for the distinct tokens themselves
    (then one distinct aggregate serves both sides)."""
    distinct = tokens.select(F.col(token).alias("token")).where(F.col("token").isNotNull()).distinct()
    if lexicon is not None:
        if isinstance(lexicon, str):
            lex = distinct.select(F.col("token").alias("form"))
        else:
            lex = lexicon.select(F.col(lexicon.columns[0]).alias("form")).where(
                F.col("form").isNotNull()).distinct()
        cands = distinct.select("token", F.explode(TX.rule_candidates(F.col("token"))).alias("c"))
        cands = cands.select("token", F.col("c.idx").alias("idx"), F.col("c.form").alias("form"))
        ok = cands.join(lex, "form", "left_semi")
        best = ok.groupBy("token").agg(
            F.min_by("form", F.struct(F.length("form"), F.col("idx"))).alias("rule_lemma"))
        d = distinct.join(best, "token", "left")
    else:
        d = distinct.withColumn("rule_lemma", F.lit(None).cast("string"))
    if lemmas is not None:
        lt = lemmas.select(F.col(lemmas.columns[0]).alias("token"),
                           F.col(lemmas.columns[1]).alias("table_lemma"))
        d = d.join(lt, "token", "left")
    else:
        d = d.withColumn("table_lemma", F.lit(None).cast("string"))
    return d.select("token", F.coalesce("table_lemma", "rule_lemma", "token").alias("lemma"))


def lemmatize_rows(df: DataFrame, key: str, tokens_col: str, out: str,
                   lemmas: DataFrame | None = None, lexicon: DataFrame | str | None = None,
                   is_written: bool = False, carried: list[str] | None = None, again=None) -> DataFrame:
    """(key, out): the lemmas of ``tokens_col`` in order for every row of df
    (``key`` must be unique). ``lexicon='corpus'`` takes the tokens of df
    themselves as the lexicon.

    The (key, tokens) pairs are written once (unless df already is): the
    lexicon, the dictionary, the changes and the rows read them, each only its
    columns. Of a row only the distinct tokens that change are joined and
    collected, into a map; the row's list is then mapped in place, so the
    other tokens never cross the network by themselves. With ``carried``, the
    result also has these columns of df, and the token lists do not cross the
    network at all: ``again(rows)`` adds them to the rows anew, by the carried
    columns, after the join.
    """
    rows = df.select(key, tokens_col, *(carried or []))
    base = rows if is_written else written(spread(rows), "tokens")
    tokens = base.select(F.explode(tokens_col).alias("token"))
    d = lemma_dictionary(tokens, lemmas, lexicon)
    changes = written(d.where(F.col("lemma") != F.col("token")), "changes")
    own = base.select(key, F.explode(F.array_distinct(tokens_col)).alias("token"))
    maps = own.join(small_side(changes, is_written=True), "token").groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("token", "lemma"))).alias("_m"))
    mapped = F.transform(tokens_col, lambda t: F.coalesce(F.element_at("_m", t), t))
    lemmatized = F.when(F.col("_m").isNull(), F.col(tokens_col)).otherwise(mapped)
    if carried is None:
        return base.join(maps, key, "left").select(key, lemmatized.alias(out))
    return again(base.drop(tokens_col).join(maps, key, "left")).withColumn(out, lemmatized).drop("_m")


def remove_stop_words_table(df: DataFrame, key: str, tokens_col: str, out: str,
                            stop_words: DataFrame) -> DataFrame:
    """T3 with the stop-word list given as a table (one string column):
    (key, out) with the tokens of ``tokens_col`` that are not in it, order
    and repeats kept. The list is broadcast after its size is checked; the
    positions are re-collected per row."""
    sw = stop_words.select(F.col(stop_words.columns[0]).alias("token")).distinct() \
                   .withColumn("_stop", F.lit(True))
    pos = spread(df.select(key, tokens_col)).select(
        key, F.posexplode_outer(tokens_col).alias("pos", "token"))
    kept = F.when(F.col("pos").isNotNull() & F.col("_stop").isNull(), F.struct("pos", "token"))
    return (pos.join(small_side(sw), "token", "left")
            .groupBy(key)
            .agg(F.sort_array(F.collect_list(kept)).alias("_k"))
            .select(key, F.col("_k.token").alias(out)))
