"""Language ID by compression: a text's language is the one whose dictionary
compresses it best.

Per language a zstandard raw-content dictionary is cut from a bounded sample
of labelled texts. A text is lower-cased and encoded in windows, each against
every dictionary from the start, so that a long text cannot replace the
dictionary by its own repetitions; the sizes are summed over all windows. The
language with the smallest sum wins, unless its lead over the second is
narrower than ``min_margin``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizlens.llm.common import written
from quizlens.session import small_side

SAMPLE_TEXTS = 200             # labelled texts per language, at most
DICTIONARY_BYTES = 256 * 1024  # per language, at most
ALL_BYTES = 50 << 20           # of all dictionaries: with many languages each is smaller
LEAST_BYTES = 1024             # of a dictionary, however many languages there are
WINDOW = 8 * 1024              # characters encoded at a time
# short matches count in short texts: matches from 4 bytes, searched lazily
PARAMETERS = zstd.ZstdCompressionParameters(
    window_log=19, hash_log=16, chain_log=17, search_log=4, min_match=4, target_length=16,
    strategy=zstd.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
UNKNOWN = "und"

def _plain(text: str) -> bytes:
    return text.lower().encode()


def learn(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE_TEXTS,
          all_bytes: int = ALL_BYTES) -> dict[str, bytes]:
    """{language: dictionary} from at most ``sample`` texts of each language,
    chosen by a hash of the id; whole texts are joined until the dictionary is
    full (DICTIONARY_BYTES, or a language's share of ``all_bytes``). Rows
    without text or language teach nothing. What a dictionary cannot hold is
    cut off in the tasks: the driver gets twice its size at most."""
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    named = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    # ids alone are ranked (with a partial limit before the exchange)
    pick = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id", F.lit(7)), "id"))
    ids = small_side(named.select("id", "lang").withColumn("n", pick).where(F.col("n") <= sample))
    room = max(LEAST_BYTES, min(DICTIONARY_BYTES, all_bytes // max(1, ids.select("lang").distinct().count())))
    picked = written(named.join(ids, ["id", "lang"]).select("lang", "n", F.substring("text", 1, room).alias("text")), "samples")
    ahead = Window.partitionBy("lang").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    needed = picked.withColumn("ahead", F.coalesce(F.sum(F.length("text")).over(ahead), F.lit(0))).where(F.col("ahead") < room)
    out: dict[str, bytes] = {}
    for r in needed.orderBy("lang", "n").toLocalIterator():
        held = out.get(r.lang, b"")
        if len(held) < room:
            out[r.lang] = (held + b"\n" + _plain(r.text))[:room]
    return out


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], min_margin: float):
        self.langs, self.min_margin, self.encoders = sorted(dictionaries), min_margin, []
        for lang in self.langs:
            d = zstd.ZstdCompressionDict(dictionaries[lang], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=PARAMETERS)
            self.encoders.append(zstd.ZstdCompressor(dict_data=d, compression_params=PARAMETERS).compress)

    def classify(self, text: str | None) -> tuple[str, float]:
        """(language or und, margin): the margin is the winner's lead over the
        second as a share of the second's size, 1 if only one is known."""
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        sizes = [0] * len(self.langs)
        for a in range(0, len(text), WINDOW):
            part = _plain(text[a:a + WINDOW])
            for i, enc in enumerate(self.encoders):
                sizes[i] += len(enc(part))
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        if len(order) == 1:
            return self.langs[0], 1.0
        margin = 1.0 - sizes[order[0]] / sizes[order[1]]  # sizes are never 0
        return (self.langs[order[0]] if margin >= self.min_margin else UNKNOWN), margin


def identify(rows: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text",
             columns: tuple[str, ...] = (), min_margin: float = 0.01) -> DataFrame:
    """The named columns plus lang_pred and score (the margin, 0 to 1).

    Null texts, and texts without a letter, are ``und`` with score 0; so is
    every text if nothing was learned. Equal sizes go to the language whose
    name sorts first. A margin below ``min_margin`` gives ``und`` with that
    margin; 0 always decides. Texts are read whole. Columns that are not
    named are not looked at; a named one may not be called lang_pred or score.
    An empty table gives an empty result.
    """
    taken = {"lang_pred", "score"}.intersection(c.lower() for c in columns)
    if taken:
        raise ValueError(f"these names are those of the result: {sorted(taken)}")
    src = rows.select(*columns, rows[text_col].alias("_lang_text"))
    held = src.sparkSession.sparkContext.broadcast(dictionaries)
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Classifier(held.value, min_margin)
        for b in batches:
            found = [c.classify(t.as_py()) for t in b.column("_lang_text")]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())], names=schema.names)

    return src.mapInArrow(run, schema)
