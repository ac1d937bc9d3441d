"""URL filters: a trie over reversed host labels and path segments.

The rules (host, path prefix, verdict) are a configured list whose size is
checked against ``MAX_RULES`` before it is broadcast. Each url walks the trie
once: host labels from the right, then the path's segments, and keeps the
deepest entry it meets, so the longest match wins between allow and block.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_RULES = 1_000_000
DEFAULT_VERDICT = "allow"


class Rule(NamedTuple):
    """``host`` fits itself and its subdomains, ``path`` (starting with "/")
    every path that starts with it; ``verdict`` is allow or block."""
    host: str
    path: str
    verdict: str


def build_trie(rules: list[Rule]) -> dict:
    """Nested dicts. A node's string keys lead to the next host label; the key
    0 leads to the trie of path segments; there, string keys are whole
    segments, 1 holds {path tail: (rule, verdict)} for prefixes that end
    inside the next segment. Of equal rules, block beats allow."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} may be broadcast")
    root: dict = {}
    for r in sorted(set(rules), key=lambda r: r.verdict):
        node = root
        for label in reversed(r.host.lower().split(".")):
            node = node.setdefault(label, {})
        node = node.setdefault(0, {})
        *whole, tail = r.path.split("/")
        for segment in whole:
            node = node.setdefault(segment, {})
        node.setdefault(1, {})[tail] = (f"{r.host}{r.path}", r.verdict)
    return root


def _path_match(node: dict, segments: list[str]):
    found = None
    for segment in segments:
        tails = node.get(1)
        if tails:
            # prefixes ending inside this segment, the longest first
            for k in range(len(segment), -1, -1):
                hit = tails.get(segment[:k])
                if hit:
                    found = hit
                    break
        node = node.get(segment)
        if node is None:
            break
    return found


def match(trie: dict, host: str, path: str):
    """(rule, verdict) of the longest match, host labels first, or None."""
    segments = path.split("/")
    found, node = None, trie
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        if 0 in node:
            found = _path_match(node[0], segments) or found
    return found


def filter_urls(rows: DataFrame, rules: list[Rule], url: str = "url",
                default: str = DEFAULT_VERDICT) -> DataFrame:
    """``rows`` plus url_host, url_path, url_rule and url_verdict.

    Host: after the first "://" up to "/", "?", "#" or the end, with A-Z
    lower-cased; path: from there up to "?" or "#". A null url, or one
    without "://", has an empty host and path. No fitting rule: the rule is
    null and the verdict is ``default``. Among fitting rules the one with most
    host labels wins, then the one with the longest path. Other columns pass
    through; columns already named like the four results are replaced. An
    empty table gives an empty result.
    """
    new = ["url_host", "url_path", "url_rule", "url_verdict"]
    kept = rows.drop(*new)
    trie = rows.sparkSession.sparkContext.broadcast(build_trie(rules))
    after = F.when(F.col(url).contains("://"), F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.coalesce(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))
    az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    parsed = kept.select("*", F.translate(host, az, az.lower()).alias("url_host"), path.alias("url_path"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = [match(trie.value, h, p) for h, p in zip(
                b.column("url_host").to_pylist(), b.column("url_path").to_pylist())]
            names = [*b.schema.names, "url_rule", "url_verdict"]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([h and h[0] for h in hits], pa.string()),
                 pa.array([h[1] if h else default for h in hits], pa.string())], names=names)

    schema = T.StructType([*parsed.schema.fields, T.StructField("url_rule", T.StringType()),
                           T.StructField("url_verdict", T.StringType())])
    return parsed.mapInArrow(judge, schema)
