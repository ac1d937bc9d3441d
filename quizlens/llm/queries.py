"""The registered query of each operator (thin: production parameters over
the whole intended table) and, where SQL can say it, its DuckDB form."""

from __future__ import annotations

from pyspark.sql import functions as F

from quizlens.llm import align as AL
from quizlens.llm import bpe as BPE
from quizlens.llm import divergence as DV
from quizlens.llm import exact_dedup as ED
from quizlens.llm import html_text as HT
from quizlens.llm import jaccard as JC
from quizlens.llm import langid as LG
from quizlens.llm import mixing as MX
from quizlens.llm import quotes as QT
from quizlens.llm import sharding as SH
from quizlens.llm import toxicity as TX
from quizlens.llm import url_filter as UF
from quizlens.llm import vptree as VP
from quizlens.llm.common import table, written

URL_RULES = [UF.Rule("net", "/", "block"), UF.Rule("example.net", "/en/", "allow"),
             UF.Rule("example.com", "/de/", "block"), UF.Rule("org", "/fr/", "allow")]


def _fold(n):
    """The documents' fold: crc32 of the id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def q_op1_exact_dedup(spark, sf):
    """Exact copies by tree-merged digest runs; the largest doc_id stays."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    return ED.exact_dedup(d, keep_largest=True)


def q_op2_nearest_vectors(spark, sf):
    """The 5 nearest rows of every 50th vector, by exact vantage-point search."""
    return VP.nearest(table(spark, sf, "embeddings"), F.col("id") % 50 == 0, "vec_id", "embedding", k=5, factor=1.0)


def q_op3_quote_linking(spark, sf):
    """All conversations, sent as mails that quote the two messages before
    them (the table itself holds no quotes), linked and freed of quotes."""
    mails = QT.as_mail(table(spark, sf, "conversations"))
    return QT.conversations(mails)


def q_op4_html_text(spark, sf):
    """The main text of every page."""
    return HT.main_text(table(spark, sf, "pages"))


def q_op5_language_id(spark, sf):
    """Every document's language by compression; learned from the labelled
    documents of two folds of three."""
    d = table(spark, sf, "documents")
    learned = LG.learn(d.where(_fold(3) != 1), "doc_id", "text", "lang")
    named = d.select("doc_id", (_fold(3) == 1).alias("held_out"), "text")
    return LG.identify(named, learned, columns=("doc_id", "held_out"), min_margin=0.0)


def q_op6_ngram_jaccard(spark, sf):
    """Components of all documents by shared 5-word shingles, 0.75 or more."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    return JC.near_duplicates(d)


def q_op7_byte_bpe(spark, sf):
    """Every document encoded and decoded with the public byte-level ranks."""
    import public_tokenizers as P
    d = table(spark, sf, "documents").select("doc_id", "text")
    return BPE.encode_rows(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, columns=("doc_id",))


def toxicity_model(spark, docs, sf):
    """Trained on labels of the folds that are not held out; the class prior
    is the toxic share of those labels."""
    labels = table(spark, sf, "labels").where((_fold(5) != 0) & F.col("toxic").isNotNull())
    prior = labels.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    return TX.fit(docs.where(_fold(5) != 0), labels.where("toxic = 1").select("doc_id"), prior)


def q_op10_toxicity(spark, sf):
    """Every document scored by the positive-unlabelled classifier."""
    d = table(spark, sf, "documents")
    model = toxicity_model(spark, d.select("doc_id", "text"), sf)
    rows = d.select("doc_id", (_fold(5) == 0).alias("held_out"), "text")
    return TX.score_rows(rows, model, columns=("doc_id", "held_out")).select(
        "doc_id", "held_out", F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))


def q_op8_url_filter(spark, sf):
    """Every page's url judged by the trie of block and allow entries."""
    p = table(spark, sf, "pages").select("page_id", "url")
    return UF.filter_urls(p, URL_RULES).select(
        "page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"),
        F.col("url_rule").alias("rule"), F.col("url_verdict").alias("verdict"))


def q_op9_mixing(spark, sf):
    """All documents mixed to 150 % of their words, sources weighing 3, 1, 2."""
    d = table(spark, sf, "documents")
    sizes = written(d.select("doc_id", "source", MX.n_words("text").alias("_mx_size")), "sizes")
    return MX.mix(sizes, "doc_id", "source", F.col("_mx_size"), counted=sizes).select(
        "doc_id", F.col("_mx_size").alias("size"), F.col("_mx_source_size").alias("source_size"),
        F.col("_mx_target").alias("target"), (F.col("_mx_copies") * F.col("_mx_size")).alias("taken"))


def q_op11_token_alignment(spark, sf):
    """Every document's alignment of the two public tokenizers."""
    import public_tokenizers as P
    d = table(spark, sf, "documents").select("doc_id", "text")
    return AL.alignment(d, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), columns=("doc_id",))


def q_op12_sharding(spark, sf):
    """All documents in 24 shards of near equal bytes, equal texts together."""
    d = table(spark, sf, "documents")
    told = d.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
                    F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
                    SH.text_key("text").alias("content"))
    return SH.shard_rows(told, "doc_id", F.col("content"), F.col("size")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("_sh_shard").alias("shard"),
        F.col("_sh_slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def q_op13_source_divergence(spark, sf):
    """Divergence of every source of a language from the others and from the language."""
    return DV.audit(table(spark, sf, "documents"))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_op")}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE = {
    "op1_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), {_AZ})) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op2_nearest_vectors": """
        WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
                   WHERE embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                     AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM s
        WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER w <= 5""",
    "op3_quote_linking": """
        WITH m AS (SELECT conv_id, turn, role, trim(text, ' \n') AS text,
                          lag(turn) OVER w AS prev, trim(lag(text) OVER w) <> '' AS said
                   FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
        p AS (SELECT *, CASE WHEN prev = turn - 1 AND said THEN prev END AS parent FROM m),
        s AS (SELECT *, max(CASE WHEN parent IS NULL THEN turn END)
                        OVER (PARTITION BY conv_id ORDER BY turn) AS root FROM p)
        SELECT conv_id, turn, role, text, parent, root, turn - root AS depth FROM s""",
    "op8_url_filter": f"""
        WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest
                   FROM pages),
        p AS (SELECT page_id,
                     translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), {_AZ}) AS host,
                     coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u)
        SELECT page_id, host, path, r.h || r.p AS rule, coalesce(r.v, 'allow') AS verdict
        FROM p LEFT JOIN (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                                 ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) r(h, p, v)
          ON (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p)
        QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY len(r.h) DESC, len(r.p) DESC) = 1""",
    "op9_mixing": """
        WITH d AS (SELECT doc_id, coalesce('1' || source, '2') AS k, substr(md5(doc_id::VARCHAR), 1, 3) AS slot,
                          coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
                   FROM documents),
        s AS (SELECT k, sum(size)::BIGINT AS source_size,
                     [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY k)) - 1) % 3 + 1] AS w
              FROM d GROUP BY k),
        l AS (SELECT *, (1.5 * sum(source_size) OVER ()::DOUBLE
                         - coalesce(sum(2.0 * source_size) OVER ahead, 0.0)::DOUBLE)
                        / (sum(w) OVER () - coalesce(sum(w) OVER ahead, 0.0))::DOUBLE AS level
              FROM s WINDOW ahead AS (ORDER BY 2.0 * source_size / w, k
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (SELECT k, source_size, least(2.0 * source_size, w * max(level) OVER ())::DOUBLE AS target,
                     ('0x' || substr(md5('mix:' || k), 1, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE AS u FROM l),
        r AS (SELECT doc_id, size, source_size, target, u,
                     CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS e,
                     row_number() OVER (PARTITION BY k ORDER BY size, slot, doc_id) AS i
              FROM d JOIN t USING (k))
        SELECT doc_id, size, source_size, target,
               ((floor(u + e * i) - floor(u + e * (i - 1)))::BIGINT * size)::BIGINT AS taken FROM r""",
    "op13_source_divergence": """
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                              'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws
                   FROM documents),
        w AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
        c AS (SELECT r, lang, source, term, count(*) AS n FROM w GROUP BY ALL),
        k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING count(*) >= 3),
        l AS (SELECT lang, sum(n) AS n, count(*) AS v FROM k GROUP BY lang),
        s AS (SELECT lang, source, term, sum(c.n) AS n FROM c JOIN k USING (lang, term) GROUP BY ALL),
        g AS (SELECT DISTINCT lang, source FROM d),
        t AS (SELECT lang, source, coalesce(sum(s.n), 0) AS n FROM g LEFT JOIN s USING (lang, source) GROUP BY ALL),
        p AS (SELECT g.lang, g.source, k.term, coalesce(s.n, 0) AS n,
                     1 + (1000000000::HUGEINT * (coalesce(s.n, 0) + 1)) // (t.n + l.v)::HUGEINT AS p,
                     1 + (1000000000::HUGEINT * (k.n + 1)) // (l.n + l.v)::HUGEINT AS q
              FROM g JOIN l USING (lang) JOIN t USING (lang, source) JOIN k USING (lang)
              LEFT JOIN s ON s.lang = g.lang AND s.source = g.source AND s.term = k.term),
        pairs AS (SELECT a.lang, a.source, b.source AS item,
                         coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0)::BIGINT AS value
                  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                  LEFT JOIN (p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source)
                    ON x.lang = a.lang AND x.source = a.source AND y.source = b.source
                  GROUP BY ALL),
        terms AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value
                  FROM p WHERE n > 0 AND p > q),
        u AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs
              UNION ALL SELECT lang, source, 'term', item, value FROM terms)
        SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::INTEGER AS rank
        FROM u QUALIFY part = 'pair'
          OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) <= 200""",
}
