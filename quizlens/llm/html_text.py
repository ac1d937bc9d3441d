"""HTML extraction by host: page structure plus the host's suffix array.

Each page is cut into blocks of text, and every block is judged by its place:
inside the article, inside a part that is never article text (navigation,
adverts, forms, comments, ...), or neither. A part is named by its element or
by a whole class, id or role of a fixed list, or, for containers inside the
article, by its first word. A name that only holds a word of the list is
weaker: it decides only outside the article of a page that has one. Blocks
that are neither, and those weakly named otherwise, are decided by the host: the pages' token streams of a host are concatenated, a
suffix array finds the runs of tokens that stand on several distinct pages,
and what they cover is boilerplate; runs that only one page has are kept.

The suffix array alone cannot decide article text: a host of one page repeats
nothing, and copies of an article repeat on purpose. So what the markup calls
the article is kept whole, and what it calls navigation is dropped.

Pages travel to their host compressed, as one zstandard frame each, and a
host is processed in parts of bounded size. What repeats is counted over the
whole host: for a host of several parts, Spark counts the distinct pages of
every window of tokens that an undecided block needs, and the parts' suffix
arrays take those counts, so the size of the parts decides no text.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlens.session import small_side, written

MIN_RUN = 8            # tokens of a repeated run, at least
MIN_PAGES = 2          # distinct pages it must stand on
PART_BYTES = 8 << 20   # of html in a part of a host
END = -1               # token between blocks
BASES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)   # of a window's two hashes
KNOWN_TOKENS = 100_000 # token hashes held by a worker

# Elements whose text is never shown or never article text, and
# words that name such parts in class, id or role.
DROPPED = frozenset("""head title script style noscript template nav footer aside form button select option
textarea input label fieldset iframe object svg canvas menu dialog audio video map""".split())
NAMED = frozenset("""ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion
menu nav navbar navigation breadcrumb breadcrumbs sidebar side aside footer header masthead topbar toolbar
notice notices alert cookie cookies consent gdpr popup modal newsletter subscribe signup login
comment comments disqus replies share sharing social related recommended widget pagination pager
search copyright complementary contentinfo""".split())
# Inside a line of text: what they hold is left out, and the line goes on.
INLINE = frozenset("svg button select label canvas object audio video map".split())
# What may stand in the head; any other element ends it.
HEAD = frozenset("head base link meta title style script noscript template".split())
# Never judged by their names, but that a reader's comment may be an article.
WHOLE = frozenset("html body main article".split())
COMMENT = frozenset(["comment"])
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption".split())
WEAK = -2              # place of a weakly named part outside the article
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body br dd details div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th
thead tr ul""".split()) - {"br"}
ARTICLE = frozenset(["article", "main"])
RAW = "script|style|textarea|title|noscript|template|iframe"

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)"                                        # a comment, closed or not
    rf"|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"         # an element whose content is no markup
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z|[\"'][^>]*(?:>|\Z))"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)", re.S | re.I)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")


class Block(NamedTuple):
    text: str
    place: int      # 1 article, 0 undecided, -1 never article text


def _place(name: str, attrs: str, inner: int) -> int:
    """The place of what an element holds, by that of the element around it."""
    if inner == -1 or name in DROPPED or name == "header" and inner != 1:
        return -1
    names = [n for m in _NAMES.findall(attrs) for n in "".join(m).lower().split()] if attrs else []
    if name in WHOLE:
        if name == "article" and COMMENT.intersection(names):
            return -1
        return 1 if name in ARTICLE else inner
    if NAMED.intersection(names):
        return -1
    words = [_SPLIT.split(n) for n in names]
    if inner == 1 and name not in TEXT and any(w[0] in NAMED for w in words):
        return -1
    if any(NAMED.intersection(w) for w in words):
        return 0 if inner == 1 else WEAK
    return inner


def blocks(page: str | None) -> list[Block]:
    """The page's blocks of text in order, white space made single spaces,
    character references decoded, empty ones left out. Unclosed and cut tags
    are tolerated; a closing tag without its opening one is ignored, and a
    head that is not closed ends where the body's content begins."""
    out: list[Block] = []
    text: list[str] = []
    stack: list[tuple[str, int]] = []        # open elements and their place
    place, hidden = 0, False                 # of the block now; inside an inline part that is left out

    def flush() -> None:
        t = " ".join("".join(text).split())
        text.clear()
        if t:
            out.append(Block(t, place))

    def look() -> None:
        nonlocal place, hidden
        hidden = any(n in INLINE for n, _ in stack)
        place = next((p for n, p in reversed(stack) if n not in INLINE), 0) if hidden else stack[-1][1] if stack else 0

    def end_head() -> None:
        at = next((i for i, (n, _) in enumerate(stack) if n == "head"), None)
        if at is not None:
            flush()
            del stack[at:]
            look()

    for m in _TOKEN.finditer(page or ""):
        kind = m.lastgroup
        if m["text"] is not None:
            if stack and stack[-1][0] == "head" and m["text"].strip():
                end_head()
            if not hidden:
                t = m["text"]
                text.append(html.unescape(t) if "&" in t else t)
        elif m["name"] is not None:
            name = m["name"].lower()
            if not m["close"] and name not in HEAD:
                end_head()
            if name == "br":
                text.append(" ")
                continue
            if name in BLOCK or name in DROPPED - INLINE:
                flush()
            if m["close"]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
                    if name not in BLOCK and stack[i][0] in BLOCK:
                        break                # an inline end tag closes no block
            elif name not in VOID and not (m["attrs"] or "").endswith("/"):
                if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
                    # these end an open one of their kind
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == name:
                            del stack[i:]
                            break
                        if stack[i][0] in BLOCK - {"p"}:
                            break
                stack.append((name, _place(name, m["attrs"], stack[-1][1] if stack else 0)))
            look()
        elif kind != "text" and m["raw"]:
            flush() if m["raw"].lower() not in ("noscript", "template") else None
    flush()
    weak = -1 if any(b.place == 1 for b in out) else 0
    return [b if b.place != WEAK else Block(b.text, weak) for b in out]


def tokens(bs: list[Block]) -> tuple[list[str], list[tuple[int, int]]]:
    """The page's stream, an empty token after each block, and the blocks' spans in it."""
    stream: list[str] = []
    span = []
    for b in bs:
        a = len(stream)
        stream.extend(b.text.split())
        span.append((a, len(stream)))
        stream.append("")
    return stream, span


class Windows:
    """128-bit hashes of each window of ``min_run`` tokens of a stream."""

    def __init__(self, min_run: int):
        self.min_run, self.known = min_run, {}

    def of(self, stream: list[str]) -> np.ndarray:
        n = len(stream) - self.min_run + 1
        if n <= 0:
            return np.zeros(0, "V16")
        if len(self.known) > KNOWN_TOKENS:
            self.known = {}
        known = self.known
        for t in set(stream).difference(known):
            known[t] = hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        h = np.frombuffer(b"".join(map(known.__getitem__, stream)), np.uint64).reshape(-1, 2)
        out = np.zeros((n, 2), np.uint64)
        for k in range(self.min_run):
            out = out * BASES + h[k:k + n]
        return np.ascontiguousarray(out).view("V16").ravel()


def undecided(bs: list[Block], span: list[tuple[int, int]], n: int, min_run: int) -> np.ndarray:
    """Which of a stream's n windows hold a token of an undecided block."""
    hit = np.zeros(max(n, 0), bool)
    for b, (a, z) in zip(bs, span):
        if b.place == 0:
            hit[max(0, a - min_run + 1):z] = True
    return hit


def repeated(streams: list[list[int]], min_run: int, min_pages: int,
             known: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """Per stream which of its tokens lie in a run of ``min_run`` tokens or
    more that stands in ``min_pages`` distinct streams, here or, by the starts
    that ``known`` gives for each stream, on the rest of the host.

    The streams are concatenated and their suffixes ordered by prefix
    doubling, as far as the first ``min_run`` tokens: suffixes that agree that
    far share a rank. A stream's end agrees with nothing."""
    size = np.array([len(s) for s in streams], dtype=np.int64)
    total = int(size.sum())
    covered = np.zeros(total, dtype=bool)
    if total:
        page = np.repeat(np.arange(len(streams)), size)
        end = np.repeat(np.cumsum(size), size)
        rank = np.unique(np.fromiter((t for s in streams for t in s), np.int64, total), return_inverse=True)[1]
        at, have = np.arange(total), 1
        while have < min_run:
            step = min(have, min_run - have)
            ahead = at + step
            alone = ahead + have > end                    # the prefix would cross the end
            nxt = np.where(alone, total + at, rank[np.minimum(ahead, total - 1)])
            pair = rank * (2 * total + 1) + nxt
            rank = np.unique(pair, return_inverse=True)[1]
            have += step
        full = at + min_run <= end
        on = np.unique(rank[full] * len(streams) + page[full]) // len(streams)
        many = np.bincount(on, minlength=int(rank.max()) + 1) >= min_pages
        run = full & many[rank]
        if known is not None:
            run |= full & np.concatenate(known)
        start = np.flatnonzero(run)
        edge = np.zeros(total + 1, dtype=np.int64)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + min_run, -1)
        covered = np.cumsum(edge[:-1]) > 0
    return np.split(covered, np.cumsum(size)[:-1])


def extract(pages: list[str | None], min_run: int = MIN_RUN, min_pages: int = MIN_PAGES,
            runs: set[bytes] | frozenset[bytes] = frozenset()) -> list[str]:
    """The main text of each page of one host, or of a part of it with the
    windows ``runs`` that the host repeats."""
    parsed = [blocks(p) for p in pages]
    ids: dict[str, int] = {"": END}
    streams, spans, known = [], [], []
    windows = Windows(min_run)
    for bs in parsed:
        words, span = tokens(bs)
        streams.append([ids.setdefault(w, len(ids)) for w in words])
        spans.append(span)
        if runs:
            hit = np.zeros(len(words), bool)
            need = np.flatnonzero(undecided(bs, span, len(words) - min_run + 1, min_run))
            if len(need):
                hit[need] = [x in runs for x in windows.of(words)[need].tolist()]
            known.append(hit)
    out = []
    for bs, span, hit in zip(parsed, spans, repeated(streams, min_run, min_pages, known or None)):
        kept = []
        for b, (a, z) in zip(bs, span):
            if b.place > 0:
                kept.append(b.text)
            elif b.place == 0:
                words = [w for w, c in zip(b.text.split(), hit[a:z]) if not c]
                if words:
                    kept.append(" ".join(words))
        out.append("\n".join(kept))
    return out


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              min_run: int = MIN_RUN, min_pages: int = MIN_PAGES, part_bytes: int = PART_BYTES) -> DataFrame:
    """(id, url, text, n_chars) of every page.

    Null html counts as empty and gives an empty text; a page of null url, or
    one without a host, belongs to the host of the empty name. Repeated rows
    are each returned, and as copies of one page they are one page to the
    host's suffix array. A host is dealt to parts of about ``part_bytes`` of
    html by a hash of its pages, so a host with a third of all pages is
    spread: the table of hosts with several parts is broadcast where its
    measured bytes allow it, and rows are dealt anew by (host, part) in either
    case. What repeats is counted over all parts of a host. Other columns are
    not looked at. An empty table gives an empty result.
    """
    host = F.lower(F.coalesce(F.regexp_extract(url_col, r"://([^/?#]*)", 1), F.lit("")))
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"),
                       F.col(html_col).alias("html"))

    # how many parts a host needs, from its size alone
    parts = small_side(src.groupBy("host").agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0))).alias("b")).select(
        "host", F.ceil(F.col("b") / part_bytes).cast("int").alias("parts")).where("parts > 1"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = zstd.ZstdCompressor(level=3).compress
        for b in batches:
            raw = b.column("html").cast(pa.large_binary()).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("id", "url", "host")),
                 pa.array([enc(x or b"") for x in raw], pa.binary())], names=["id", "url", "host", "html"])

    id_type = src.schema["id"].dataType.simpleString()
    packed = src.mapInArrow(pack, f"id {id_type}, url string, host string, html binary")

    def dealt(rows: DataFrame, how: str) -> DataFrame:
        return rows.join(parts, "host", how).withColumn(
            "part", F.pmod(F.xxhash64("id", "url"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")

    def run(rows: pd.DataFrame, runs: set[bytes]) -> pd.DataFrame:
        dec = zstd.ZstdDecompressor().decompress
        distinct = {x: i for i, x in enumerate(dict.fromkeys(rows["html"]))}
        texts = extract([dec(x).decode() for x in distinct], min_run, min_pages, runs)
        text = [texts[distinct[x]] for x in rows["html"]]
        return pd.DataFrame({"id": rows["id"], "url": rows["url"], "text": text,
                             "n_chars": [len(t) for t in text]})

    # else a join by host would do as the grouping by (host, part) too
    packed = dealt(packed, "left").repartition("host", "part")
    out = f"id {id_type}, url string, text string, n_chars long"
    common = repeated_runs(dealt(src, "inner"), min_run, min_pages)
    if common is None:
        # no host of several parts has undecided blocks
        done = packed.groupBy("host", "part").applyInPandas(lambda rows: run(rows, set()), out)
    else:
        done = packed.groupBy("host", "part").cogroup(common.repartition("host", "part").groupBy("host", "part")).applyInPandas(
            lambda rows, found: run(rows, set(map(bytes, found["run"]))), out)
    return done.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")


def repeated_runs(pages: DataFrame, min_run: int, min_pages: int) -> DataFrame | None:
    """(host, part, run) of every window of an undecided block of the part
    that stands on ``min_pages`` distinct pages of the host, over all parts;
    None where no page has an undecided block.

    Only windows that an undecided block needs are counted, on all pages of
    the hosts that have them."""
    def hashed(only_undecided: bool):
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = Windows(min_run)
            for b in batches:
                for i, x in enumerate(b.column("html")):
                    raw = x.as_py() or ""
                    bs = blocks(raw)
                    if only_undecided and all(k.place for k in bs):
                        continue
                    words, span = tokens(bs)
                    n = len(words) - min_run + 1
                    if n <= 0:
                        continue
                    found = windows.of(words)
                    if only_undecided:
                        found = found[undecided(bs, span, n, min_run)]
                    found = list(set(found.tolist()))
                    page = hashlib.blake2b(raw.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    host, part = b.column("host")[i].as_py(), b.column("part")[i].as_py()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([host] * len(found), pa.string()), pa.array([part] * len(found), pa.int32()),
                         pa.array([page] * len(found), pa.binary()), pa.array(found, pa.binary())],
                        names=["host", "part", "page", "run"])
        return go

    rows = pages.select("host", "part", "html")
    schema = "host string, part int, page binary, run binary"
    needed = written(rows.mapInArrow(hashed(True), schema).select("host", "part", "run").distinct(), "html-runs")
    if needed.isEmpty():
        return None
    wanted = needed.select("host", "run").distinct()
    every = rows.join(needed.select("host").distinct(), "host", "left_semi").mapInArrow(hashed(False), schema)
    common = (every.join(wanted, ["host", "run"], "left_semi").groupBy("host", "run")
              .agg(F.count_distinct("page").alias("n")).where(F.col("n") >= min_pages).select("host", "run"))
    return needed.join(common, ["host", "run"], "left_semi").select("host", "part", "run")
