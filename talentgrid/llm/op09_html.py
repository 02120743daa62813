"""HTML extraction with a suffix array per host.

One pass reads each page into blocks, in page order, and marks a block as *main* (inside an
article or main element and outside menus, headers, footers, side bars, notices, adverts,
forms and comments), *dropped* (inside one of those), or *rest*; scripts and styles are no blocks.

All blocks, menus and footers too, are then judged per host: the token streams of the host's
pages are concatenated, a suffix array over them gives the long substrings that occur on
distinct pages, blocks that those cover are boilerplate, and the unique runs stay.  Of these the
page's structure breaks the rest: where a page has an article or main element its main blocks
are kept, else its rest blocks.  For a page without such an element a substring on ``LEAST_SHARE``
of the host's pages (``LEAST_PAGES`` at least) is boilerplate.  Articles are copied and quoted
across the pages of a host too, so inside an article the substring must be on nearly all of the
host's pages (``HOST_SHARE``, and ``HOST_PAGES`` at least), as a fixed closing line is.

A host's distinct page contents are dealt into chunks of bounded text and rows by a hash, so a
host of any size is never one task.  A substring on a share of a host's pages is on that share
of some chunk's pages, so each chunk names only such candidates; their pages are then counted
in every chunk and summed before a block is judged, so chunks do not change results.  Pages
with the same blocks count once and get the same text.  Pages are read again in each of the
three passes, since their blocks, written or shuffled twice, would take more disk than the input.

Defined results: null or empty html gives an empty text; a page cut off in a tag ends there;
repeated rows give a row each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import words as W
from .common import ship, table, written

#: Tokens that a repeated substring must have, and pages it must be on.
LEAST_TOKENS = 8
LEAST_PAGES, LEAST_SHARE = 3, 0.02
#: Share of a block's tokens under repeated substrings from which it is boilerplate.
COVERED = 0.8
#: Share and number of a host's distinct pages that a substring inside an article must be on.
HOST_SHARE, HOST_PAGES = 0.8, 10
#: Characters of markup, and pages, in one chunk of a host.
CHUNK_CHARS, CHUNK_PAGES = 4_000_000, 2_000

#: Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math object select".split())
DROPPED = frozenset("nav header footer aside form button dialog menu head script style textarea title noscript iframe template svg math object select".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
MAIN = frozenset(("article", "main"))
CODEC = pa.Codec("zstd", 3)
#: Words of class, id and role that mark an element as not the article.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|banner|side-?bar|cookies?|consent|notices?|newsletter|subscribe|promo\w*|popup|modal|share|sharing|social|comments?|disqus|replies|related|recommend\w*|breadcrumbs?|menu|navbar|nav|navigation|footer|masthead|toolbar|widget|pagination|login|signup|complementary|contentinfo|search)(?:$|[\s_-])",
    re.I,
)
TAG = re.compile(r"""<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*(?:>|$)|<(?=/?[a-zA-Z])[^>]*(?:>|$)""", re.S)
ATTR = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)


def blocks_of(page: str) -> tuple[list[tuple[str, str]], bool]:
    """(kind, text) of the blocks of a page, and whether it has an article or main element; kinds: m(ain), r(est), d(ropped)."""
    blocks: list[tuple[str, str]] = []
    text: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # element, dropped by itself, main
    dropped = inside = 0
    has_main = False

    def flush() -> None:
        if text:
            block = " ".join(html_lib.unescape("".join(text)).split())
            if block:
                blocks.append(("d" if dropped else "m" if inside else "r", block))
            text.clear()

    at, size = 0, len(page)
    while at < size:
        m = TAG.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:  # end tag
            if name in BLOCKS:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if not (name in BLOCKS or name in RAW):
                        if any(s[0] in BLOCKS for s in stack[i + 1 :]):
                            break  # an inline end tag does not close blocks
                    for s in stack[i:]:
                        dropped -= s[1]
                        inside -= s[2]
                    del stack[i:]
                    break
            continue
        attrs = m[3] or ""
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|$)", re.I).search(page, at)
            if not attrs.endswith("/") or name not in ("svg", "math"):
                at = end.end() if end else size
            continue
        if name in BLOCKS:
            flush()
            if name in MAIN and dropped:  # an element left open before the article ends here
                while stack and dropped:
                    s = stack.pop()
                    dropped -= s[1]
                    inside -= s[2]
        if name in VOID or attrs.endswith("/"):
            continue
        off = name in DROPPED and not (name == "header" and inside)
        if not off and attrs and name not in MAIN and name not in ("body", "html"):
            off = any(MARKS.search(a.strip("\"'")) for a in ATTR.findall(attrs))
        is_main = name in MAIN or bool(attrs and re.search(r"""role\s*=\s*["']?main\b""", attrs, re.I))
        has_main = has_main or (is_main and not dropped)
        if name in ("p", "li") and stack and stack[-1][0] == name:
            s = stack.pop()
            dropped -= s[1]
            inside -= s[2]
        if name == "body":
            continue
        stack.append((name, off, is_main and not off))
        dropped += off
        inside += is_main and not off
    flush()
    return blocks, has_main


def suffix_ranks(tokens: np.ndarray, length: int) -> np.ndarray:
    """Rank of each suffix by its first ``length`` tokens (prefix doubling, then one shift)."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    have = 1
    while have < length:
        step = min(have, length - have)
        after = np.full(len(rank), -1, np.int64)
        after[: len(rank) - step] = rank[step:]
        rank = np.unique(rank * (len(rank) + 1) + after + 1, return_inverse=True)[1].astype(np.int64)
        have += step
    return rank


class Stream:
    """The token stream of some pages, cut where a substring may not go on."""

    def __init__(self, pages: list[list[str]], least: int = LEAST_TOKENS):
        words: list[str] = []
        blocks, owners, lengths = [], [], []  # one entry per block and page end
        flat = 0
        for p, own in enumerate(pages):
            for b in own:
                w = b.split()
                words += w
                words.append("\n")  # a block's end is a token, so short blocks count with their neighbours
                blocks.append(flat)
                owners.append(p)
                lengths.append(len(w) + 1)
                flat += 1
            words.append("\n\n")  # no substring goes over a page's end
            blocks.append(-1)
            owners.append(p)
            lengths.append(1)
        self.pages, self.flat, self.least = pages, flat, least
        self.tokens, self.values = pd.factorize(np.array(words, object))
        self.tokens = self.tokens.astype(np.int64)
        self.page, self.block = np.repeat(owners, lengths), np.repeat(blocks, lengths)
        ends = np.concatenate(([0], np.cumsum(self.block < 0)))
        n = max(0, len(words) - least + 1)
        self.inside = ends[least : least + n] == ends[:n]  # whether the substring that starts here is in one page

    def keys(self) -> np.ndarray:
        """A hash of the substring at each place, the same in every chunk."""
        each = pd.util.hash_array(np.asarray(self.values, object), categorize=False)
        return W.hash_windows(each[self.tokens], self.least).view(np.int64)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Key and number of distinct pages of each substring, from the suffix array cut at the least length."""
        if not self.inside.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rank = suffix_ranks(self.tokens, self.least)
        order = np.lexsort((self.page, rank))
        order = order[order < len(self.inside)]
        order = order[self.inside[order]]
        r, p = rank[order], self.page[order]
        start = np.concatenate(([True], r[1:] != r[:-1]))
        new = start | np.concatenate(([True], p[1:] != p[:-1]))
        return self.keys()[order[start]], np.bincount(np.cumsum(start) - 1, new).astype(np.int64)

    def cover(self, hit: np.ndarray) -> list[np.ndarray]:
        """Share of each block's tokens under the substrings that start where ``hit`` says."""
        at = np.flatnonzero(hit & self.inside)
        edge = np.zeros(len(self.tokens) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + self.least, -1)
        on = np.cumsum(edge[:-1]) > 0
        real = self.block >= 0
        total = np.bincount(self.block[real], minlength=self.flat)
        share = np.bincount(self.block[real], on[real].astype(float), minlength=self.flat) / np.maximum(total, 1)
        return np.split(share, np.cumsum([len(own) for own in self.pages])[:-1])


def packed(page: str) -> bytes:
    """Blocks of a page as compressed lines: each its kind (in capitals, if structure keeps it) and its text."""
    blocks, marked = blocks_of(page)
    kept = "m" if marked else "r"
    lines = [("M" if marked else "-"), *((k.upper() if k == kept else k) + t for k, t in blocks)]
    raw = "\n".join(lines).encode()
    return len(raw).to_bytes(8, "little") + CODEC.compress(raw, asbytes=True)


def unpacked(z: bytes) -> tuple[bool, list[str], list[bool]]:
    """Whether the page is marked, its blocks, and which of them structure keeps."""
    lines = CODEC.decompress(z[8:], int.from_bytes(z[:8], "little"), asbytes=True).decode().split("\n")
    return lines[0] == "M", [x[1:] for x in lines[1:]], [x[0] in "MR" for x in lines[1:]]


def _parse(batches: Iterator[pa.RecordBatch], once: bool) -> Iterator[pa.RecordBatch]:
    """Packed blocks behind the other columns; ``once``: each content of a host once per batch."""
    for b in batches:
        seen: set[tuple] = set()
        take, out, keys = [], [], []
        for i, (host, h) in enumerate(zip(b.column("_host").to_pylist(), b.column("_html"), strict=True)):
            z = packed(h.as_py() or "")
            key = xxh64_intdigest(z) - (1 << 63)
            if once and (host, key) in seen:
                continue
            seen.add((host, key))
            take.append(i)
            out.append(z)
            keys.append(key)
        at = pa.array(take, pa.int64())
        kept = [n for n in b.schema.names if n != "_html"]
        yield pa.RecordBatch.from_arrays([*(b.column(n).take(at) for n in kept), pa.array(keys, pa.int64()), pa.array(out, pa.binary())], names=[*kept, "_key", "_z"])


def _contents(rows: pd.DataFrame) -> list[list[str]]:
    """Blocks of the distinct contents of one chunk."""
    return [unpacked(z)[1] for z in rows.drop_duplicates("_key")["_z"]]


def _candidates(rows: pd.DataFrame) -> pd.DataFrame:
    """Substrings that may reach the least share of their host, with their pages in this chunk; first, the number of pages."""
    pages = _contents(rows)
    key, n = Stream(pages).counts()
    share = max(LEAST_SHARE, LEAST_PAGES / int(rows["_rows"].iloc[0]))
    hit = n >= share * len(pages) * (1 - 1e-9)
    return pd.DataFrame({"_host": rows["_host"].iloc[0], "_chunks": rows["_chunks"].iloc[0], "_all": [True] + [False] * int(hit.sum()), "_sub": np.concatenate(([0], key[hit])), "_n": np.concatenate(([len(pages)], n[hit]))})


def _recount(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """Pages of one chunk that hold each candidate of its host."""
    if not len(rows) or not len(asked):
        return pd.DataFrame({"_host": [], "_sub": [], "_n": []}, dtype=object)
    key, n = Stream(_contents(rows)).counts()
    hit = np.isin(key, asked["_sub"].to_numpy(np.int64))
    return pd.DataFrame({"_host": np.full(int(hit.sum()), rows["_host"].iloc[0], object), "_sub": key[hit], "_n": n[hit]})


def _decide(rows: pd.DataFrame, repeated: pd.DataFrame) -> pd.DataFrame:
    """The text of each page of one lane; ``repeated`` has the counts of the host's substrings and its number of pages."""
    if not len(rows):
        return pd.DataFrame({"_page": [], "_url": [], "_text": []}, dtype=object)
    by_key = rows.drop_duplicates("_key")
    found = [unpacked(z) for z in by_key["_z"]]
    covered = {True: None, False: None}
    if len(repeated):
        stream = Stream([own for _, own, _ in found])
        repeated = repeated.sort_values("_sub")
        sub, n = repeated["_sub"].to_numpy(np.int64), repeated["_n"].to_numpy(np.int64)
        keys = stream.keys()
        place = np.minimum(np.searchsorted(sub, keys), len(sub) - 1)
        count = np.where(sub[place] == keys, n[place], 0)
        whole = max(HOST_PAGES, int(np.ceil(HOST_SHARE * repeated["_pages"].iloc[0])))
        covered = {True: stream.cover(count >= whole), False: stream.cover(count > 0)}
    text = {}
    for i, (key, (marked, own, kept)) in enumerate(zip(by_key["_key"], found, strict=True)):
        share = np.zeros(len(own)) if covered[marked] is None else covered[marked][i]
        text[key] = "\n".join(b for b, k, s in zip(own, kept, share, strict=True) if k and s < COVERED)
    return pd.DataFrame({"_page": list(rows["_page"]), "_url": list(rows["_url"]), "_text": [text[k] for k in rows["_key"]]}, dtype=object)


def extract(pages: DataFrame, page: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """(page, url, text) of every row."""
    spark = ship(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    # ids travel as text: pandas would turn a long with nulls into a double
    own = pages.select(F.col(page).cast("string").alias("_page"), F.col(url).cast("string").alias("_url"), host.alias("_host"), F.col(markup).cast("string").alias("_html"))
    size = F.coalesce(F.sum(F.length("_html")), F.lit(0))
    chunks = F.greatest(F.ceil(size / CHUNK_CHARS), F.ceil(F.count("*") / CHUNK_PAGES), F.lit(1))
    hosts = written(spark, own.groupBy("_host").agg(chunks.alias("_chunks"), F.count("*").alias("_rows")), "hosts")  # its size on disk tells Spark whether to broadcast it

    def dealt(rows: DataFrame, once: bool) -> DataFrame:
        """Rows with packed blocks, in chunks by content, or in lanes by row."""
        cols = ["_host", "_chunks", "_rows", "_html"] if once else ["_host", "_page", "_url", "_lane", "_html"]
        kind = ", ".join(f"{c} {'string' if c in ('_host', '_page', '_url') else 'long'}" for c in cols[:-1])
        rows = rows.select(*cols).mapInArrow(lambda it: _parse(it, once), kind + ", _key long, _z binary")
        return rows.withColumn("_chunk", F.pmod("_key", "_chunks")) if once else rows

    joined = own.join(hosts, "_host")
    named = dealt(joined, True).groupBy("_host", "_chunk").applyInPandas(_candidates, "_host string, _chunks long, _all boolean, _sub long, _n long")
    named = written(spark, named, "candidates")
    total = named.filter("_all").groupBy("_host").agg(F.sum("_n").alias("_pages"))
    single = named.filter("not _all and _chunks = 1").select("_host", "_sub", "_n")
    asked = named.filter("not _all and _chunks > 1").select("_host", "_chunks", "_sub").distinct()
    asked = asked.select("_host", "_sub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1)).alias("_chunk"))
    many = dealt(joined.filter("_chunks > 1"), True).groupBy("_host", "_chunk").cogroup(asked.groupBy("_host", "_chunk")).applyInPandas(_recount, "_host string, _sub long, _n long")
    many = many.groupBy("_host", "_sub").agg(F.sum("_n").alias("_n"))
    least = F.greatest(F.lit(LEAST_PAGES), F.ceil(LEAST_SHARE * F.col("_pages")))
    repeated = written(spark, single.unionByName(many).join(total, "_host").filter(F.col("_n") >= least), "repeated")
    lanes = repeated.join(hosts, "_host").select("_host", "_sub", "_n", "_pages", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1)).alias("_lane"))
    rows = dealt(joined.withColumn("_lane", F.pmod(F.monotonically_increasing_id(), "_chunks")), False)
    out = rows.groupBy("_host", "_lane").cogroup(lanes.groupBy("_host", "_lane")).applyInPandas(_decide, "_page string, _url string, _text string")
    return out.select(F.col("_page").cast(pages.schema[page].dataType).alias(page), F.col("_url").cast(pages.schema[url].dataType).alias(url), F.col("_text").alias("text"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    out = extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
