"""Main text of web pages: markup decides where it is clear, a suffix array over each host's pages where it is not.

Text in menus, headers, footers, sidebars, notices, adverts, forms and comments goes, and prose (paragraphs, headings,
quotations) of an article or main element is kept. What markup leaves open is judged by the host's repeats: the token
streams of the host's pages are concatenated, their suffixes are sorted, and long substrings that distinct pages repeat
are boilerplate. They are removed from pages without such an element; in an article a loose block (one that stands in
a plain container) goes if they cover all of it. A large host is sorted in slices whose repeats are counted together, so that neither
a host nor a repeat is bound to one task.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.text import mixed, pieces, run_hashes, small_batches
from riskloom.operators.ranking import broadcast_if_small
from riskloom.session import run_folder

REPEAT = 8  # tokens of a substring that counts as long; a power of two
SLICE_TOKENS = 2_000_000  # tokens of a host that one task sorts, about

# Elements and the words of class, id and role that mark what is not the article.
RAW = "script style noscript template textarea title iframe svg math object canvas audio video select".split()
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
SPACES = frozenset("br td th wbr option".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEVER = frozenset("nav footer aside form button dialog menu search fieldset".split())
APART = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead topbar footer colophon sidebar aside widget widgets notice cookie cookies consent gdpr alert popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social related recommended recommendations pagination pager toolbar skip search form "
    "comment comments commentlist disqus reply replies respond discussion contentinfo complementary dialog".split()
)
PROSE = frozenset("article main p h1 h2 h3 h4 h5 h6 blockquote pre figcaption caption dd dt".split())
TALK = frozenset("comment comments commentlist disqus reply replies respond discussion related recommended recommendations".split())
CONTENT = frozenset("article post entry content main story".split())

_TAG = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<({"|".join(RAW)})\b[^>]*+>.*?(?:</\1\s*+>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


@dataclass
class Zone:
    tag: str
    kind: str  # main, open, apart, head (an article's own header: headings count) or talk (nothing inside counts)
    depth: int = 1


def _kind(tag: str, attributes: str, around: str) -> str | None:
    """The kind of zone that a start tag opens, if it opens one."""
    if around == "talk" or tag in ("html", "body"):
        return None
    words: set[str] = set()
    if attributes:
        for name, *value in _ATTRIBUTE.findall(attributes):
            text, name = "".join(value).lower(), name.lower()
            if name == "hidden" or name == "aria-hidden" and text == "true" or name == "style" and re.search(r"display\s*:\s*none", text):
                return "talk"
            if name in ("class", "id", "role"):
                words.update(re.split(r"[^a-z]+", text))
    if words & TALK:
        return "talk"
    if tag in ("article", "main"):
        return "main"
    if tag in NEVER:
        return "talk"
    if tag == "header":
        return "head" if around == "main" else "apart"
    if tag in HEADINGS:
        return None
    if words & APART:
        return "head" if around == "main" and "header" in words else "apart"
    if words & CONTENT and around == "open":
        return "main"
    return None


def blocks_of(page: str) -> tuple[list[str], list[tuple[str, bool]], bool, list[bool]]:
    """Main blocks, the other blocks with whether they may count (outside menus and the like), whether there is a main
    element, and which main blocks are loose."""
    main: list[str] = []
    loose: list[bool] = []
    container = ""  # the plain container that was opened last, until prose begins or it ends
    other: list[tuple[str, bool]] = []
    zones: list[Zone] = []
    held: list[str] = []
    kind, heading, any_main, at = "open", False, False, 0

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                if kind == "main" or kind == "head" and heading:
                    main.append(text)
                    loose.append(bool(container))
                elif kind != "head":
                    other.append((text, kind == "open"))

    for m in _TAG.finditer(page):
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        tag = m[3] or m[6]
        if tag is None:
            if m[1]:
                held.append(" ")
            continue
        tag = tag.lower()
        if tag in SPACES:
            held.append(" ")
        elif tag in BLOCKS:
            flush()
        if tag in VOID:
            continue
        closing = bool(m[2] or m[5])
        if closing:
            if zones and any(z.tag == tag for z in zones):
                # An end tag also ends what was left open inside.
                inner = next(i for i in range(len(zones) - 1, -1, -1) if zones[i].tag == tag)
                zones[inner].depth -= 1
                if not zones[inner].depth:
                    flush()
                    del zones[inner:]
            if tag in HEADINGS:
                heading = False
            if tag == container:
                container = ""
        else:
            while zones and zones[-1].tag in ("p", "li", "dt", "dd") and (tag == zones[-1].tag or zones[-1].tag == "p" and tag in BLOCKS):
                zones.pop()
            kind = zones[-1].kind if zones else "open"
            new = _kind(tag, m[4] or m[7] or "", kind)
            if new and new != kind:
                if tag not in BLOCKS:
                    flush()
                zones.append(Zone(tag, new))
                any_main |= new == "main"
            elif zones:
                for z in reversed(zones):
                    if z.tag == tag:
                        z.depth += 1
                        break
            if tag in HEADINGS:
                heading = True
            if tag in PROSE:
                container = ""
            elif tag in BLOCKS:
                container = tag
        kind = zones[-1].kind if zones else "open"
    held.append(page[at:])
    flush()
    return main, other, any_main, loose


def token_hashes(texts: list[str]) -> list[np.ndarray]:
    """64-bit hashes of the blank-separated tokens of each text (in which every blank is one space)."""
    raw = " ".join(texts).encode()
    data = np.frombuffer(raw, np.uint8)
    gaps = np.flatnonzero(data == 0x20)
    begin, end = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]])
    counts = [t.count(" ") + 1 for t in texts]
    return np.split(run_hashes(data, begin, end), np.cumsum(counts)[:-1]) if texts else []


def windows(tokens: np.ndarray) -> np.ndarray:
    """Hashes of all REPEAT tokens in a row."""
    ranks, width = tokens, 1
    while width < REPEAT and len(ranks) > width:
        ranks = mixed(ranks[:-width] * np.uint64(0x9FB21C651E98DF25) + ranks[width:], 80)
        width *= 2
    return ranks if width == REPEAT else np.zeros(0, np.uint64)


def sorted_suffixes(tokens: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of concatenated streams, sorted to depth REPEAT, and where a new prefix of that length begins.

    Only suffixes with REPEAT tokens left in their own page are in it. Ranks double their depth in each round.
    """
    _, rank = np.unique(tokens, return_inverse=True)
    width, n = 1, len(tokens)
    while width < REPEAT and n > width:
        low = np.zeros(n, np.int64)
        low[: n - width] = np.where(page[width:] == page[:-width], rank[width:] + 1, 0)
        _, rank = np.unique(rank * np.int64(n + 1) + low, return_inverse=True)
        width *= 2
    whole = np.zeros(n, bool)
    if n >= REPEAT:
        whole[: n - REPEAT + 1] = page[: n - REPEAT + 1] == page[REPEAT - 1 :]
    suffixes = np.flatnonzero(whole)
    suffixes = suffixes[np.argsort(rank[suffixes], kind="stable")]
    heads = np.flatnonzero(np.diff(rank[suffixes], prepend=-1))
    return suffixes, heads


def content_key(streams: list[np.ndarray]) -> int:
    """A signed 64-bit hash of token streams read one after the other; copies of a page have the same."""
    tokens = np.concatenate(streams) if streams else np.zeros(0, np.uint64)
    places = np.arange(1, len(tokens) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    total = np.uint64(len(tokens)) + np.sum(mixed(tokens ^ mixed(places, 82), 83), dtype=np.uint64)
    return int(mixed(np.array([total]), 84).view(np.int64)[0])


def _page_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page parsed once: the tokens outside its main element, a key of what may be its article, and its blocks.

    Where markup settles everything the page has its text at once; else `texts` are the blocks in question, by `role`,
    and the stream begins with the tokens of those that are not prose.
    """
    for whole in batches:
        for batch in pieces(whole, "html", 1 << 20):
            streams, counts, keys, done, texts, roles = [], [], [], [], [], []
            for page in batch.column("html").to_pylist():
                main, other, any_main, loose = blocks_of(page or "")
                outside, inside = token_hashes([t for t, _ in other]), token_hashes(main) if any_main else []
                parts = [h for h, own in zip(inside, loose) if own] + outside
                stream = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
                streams.append(stream.tobytes())
                counts.append(len(stream))
                keys.append(content_key(inside if any_main else [h for h, (_, c) in zip(outside, other) if c]))
                done.append("\n".join(main) if any_main and not any(loose) else None)
                texts.append([] if done[-1] is not None else main if any_main else [t for t, _ in other])
                roles.append([] if done[-1] is not None else [LOOSE if own else KEPT for own in loose] if any_main else [OPEN if c else APART_TEXT for _, c in other])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("page_id", "url", "host")), pa.array(keys, pa.int64()), pa.array(streams, pa.binary()), pa.array(counts, pa.int64()), pa.array(done, pa.string()), pa.array(texts, pa.list_(pa.string())), pa.array(roles, pa.list_(pa.int8()))],
                ["page_id", "url", "host", "page", "stream", "n_tokens", "text", "texts", "roles"],
            )


STREAMS = "page_id long, url string, host string, page long, stream binary, n_tokens long, text string, texts array<string>, roles array<byte>"
KEPT, LOOSE, OPEN, APART_TEXT = range(4)  # prose of an article, its loose blocks; where there is no article, text that may count and text that may not


def _repeat_rows(group: pa.Table) -> pa.Table:
    """For one slice of a host each prefix of its sorted suffixes, with the least and greatest page that has it."""
    parts = [np.frombuffer(s, np.uint64) for s in group.column("stream").to_pylist()]
    ids = np.asarray(group.column("page"), np.int64)
    tokens = np.concatenate(parts)
    page = np.repeat(ids, [len(p) for p in parts])
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    suffixes, heads = sorted_suffixes(tokens, row)
    if not len(suffixes):
        grams, low, high = np.zeros(0, np.uint64), ids[:0], ids[:0]
    else:
        grams = windows(tokens)[suffixes[heads]]
        low, high = np.minimum.reduceat(page[suffixes], heads), np.maximum.reduceat(page[suffixes], heads)
    n = len(grams)
    return pa.table({"host": pa.array([group.column("host")[0].as_py()] * n, pa.string()), "slice": pa.array(np.full(n, group.column("slice")[0].as_py(), np.int64)), "gram": grams.view(np.int64), "low": low, "high": high})


def _kept_rows(pages: pa.Table, repeats: pa.Table) -> pa.Table:
    """The text of pages that markup does not settle, less what lies in repeated windows."""
    known = np.unique(np.asarray(repeats.column("gram"), np.int64)).view(np.uint64)
    out = []
    for stream, texts, roles in zip(*(pages.column(c).to_pylist() for c in ("stream", "texts", "roles"))):
        tokens = np.frombuffer(stream, np.uint64)
        found = np.flatnonzero(np.isin(windows(tokens), known))
        covered = np.zeros(len(tokens) + 1, np.int64)
        np.add.at(covered, found, 1)
        np.add.at(covered, found + REPEAT, -1)
        free = np.cumsum(covered[:-1]) == 0
        kept, at = [], 0
        for text, role in zip(texts, roles):
            if role == KEPT:
                kept.append(text)
                continue
            words = text.split(" ")
            own = free[at : at + len(words)]
            at += len(words)
            if own.any() and role != APART_TEXT:
                kept.append(text if role == LOOSE else " ".join(w for w, f in zip(words, own.tolist()) if f))
        out.append("\n".join(kept))
    return pa.table({"page_id": pages.column("page_id"), "url": pages.column("url"), "text": pa.array(out, pa.string())})


def main_text(pages: DataFrame, slice_tokens: int = SLICE_TOKENS) -> DataFrame:
    """One row per row of `pages` (page_id, url, html): page_id, url, text, n_chars.

    Null html is empty, with empty text; an empty table has no rows. A page without a host (null or odd url) belongs to
    the host "". Pages of a host whose article (main text, or what may be it where markup is silent) is the same are one
    page when repeats are counted, so that a copied page keeps its text. A line break is white space inside its block.
    Prose of an article or main element is never taken for boilerplate, since articles of a host share paragraphs.
    """
    spark = pages.sparkSession
    small_batches(spark)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    folder = run_folder(spark, "page-streams")
    pages.select("page_id", "url", host.alias("host"), "html").mapInArrow(_page_rows, STREAMS).write.parquet(folder)
    streams = spark.read.schema(STREAMS).parquet(folder)

    large = streams.groupBy("host").agg(F.sum("n_tokens").alias("n")).where(F.col("n") > slice_tokens).select("host", F.ceil(F.col("n") / slice_tokens).alias("slices"))
    sliced = streams.join(broadcast_if_small(large), "host", "left").withColumn("slice", F.when(F.col("slices").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("page", "page_id", "url"), F.col("slices"))).cast("long"))

    grams = sliced.where("n_tokens > 0").select("host", "slice", "page", "stream").groupBy("host", "slice").applyInArrow(_repeat_rows, "host string, slice long, gram long, low long, high long")
    repeated = grams.groupBy("host", "gram").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("host", "gram")
    local = grams.select("host", "slice", "gram").join(repeated, ["host", "gram"], "left_semi")
    cleaned = sliced.where("text is null").groupBy("host", "slice").cogroup(local.groupBy("host", "slice")).applyInArrow(_kept_rows, "page_id long, url string, text string")
    settled = streams.where("text is not null").select("page_id", "url", "text")
    return settled.unionAll(cleaned).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
