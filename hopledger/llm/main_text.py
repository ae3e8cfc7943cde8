"""Main text of pages: markup drops what it names and keeps articles, a suffix array over the pages of a host decides every other block.

A block inside a menu, notice, form or the like is dropped, what else stands inside an article is kept. All other blocks are decided by
repetition: the texts of a host's pages are concatenated, their suffix array puts equal passages beside each other, and a passage of
``LEAST_TOKENS`` tokens on ``LEAST_PAGES`` different pages is boilerplate. A block that such passages cover is removed, what is unique stays.
Copies of a page count once, so they stay.

A class name that only hints at a menu or notice (``has-sidebar``) drops nothing of an article; around one it drops, and on a page without
an article repetition decides. Only pages with undecided blocks are shuffled. Hosts are cut into shards of at most about ``SHARD_PAGES``
of them, so no task holds a whole large host, but passages are counted over the host: shards send 64-bit hashes and the number of different
pages of each class of their suffix array, Spark adds them up and sends back those that are repeated.
"""

from __future__ import annotations

import html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from hopledger.llm.common import kept, map_slices, texts_of

SHARD_PAGES, LEAST_TOKENS, LEAST_PAGES, COVERED = 128, 6, 3, 0.8
# What markup says of a block.
NOTHING, HINTED, NAMED = range(3)
# Text elements, which hold no markup and run to the end of the page when unclosed.
_RAW = "script|style|textarea|title"
_TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]{0,8192}\"|'[^']{0,8192}')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>",
    re.S | re.I,
)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_OPEN = re.compile(r"""(?:^|\s)open(?:\s|=|/|$)""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_SPACE = re.compile(r"\s+")
# Elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head"
    " header hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
# Without text of the page between their tags; one that is never closed drops nothing.
EMBEDDED = frozenset("noscript template iframe svg object select canvas audio video".split())
DROPPED = frozenset("head nav footer aside form menu button dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
MARKS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs masthead footer sidebar cookie cookies consent gdpr notice notices banner"
    " popup modal overlay ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion comment comments disqus"
    " respond reply replies share sharing social related recommended newsletter subscribe signup login pagination pager toolbar widget".split()
)
HEADINGS = frozenset(("header", "topbar"))
_CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
              "option": ("option",)}
_SCOPE = frozenset("ul ol dl table tbody thead tfoot tr div section article main body aside nav footer header form blockquote".split())


def _mark(tag: str, attributes: str, in_article: bool) -> int:
    if tag == "dialog":
        return HINTED if _OPEN.search(attributes) else NAMED
    if tag in DROPPED or tag == "header" and not in_article:
        return NAMED
    if not attributes or tag in ("html", "body", "h1"):
        return NOTHING
    if _HIDDEN.search(attributes):
        return NAMED
    found = NOTHING
    for name, a, b, c in _NAMED.findall(attributes):
        value = a or b or c
        if name.lower() == "role":
            if value.lower() in ROLES:
                return NAMED
        elif tag not in ("article", "main"):
            wanted = MARKS if in_article else MARKS | HEADINGS
            if wanted.intersection(value.lower().split()):
                return NAMED
            if wanted.intersection(w.lower() for w in _PART.findall(value)):
                found = HINTED
    return found


def _embedded(tags: list[re.Match[str]]) -> dict[int, int]:
    """Start of each embedded element -> end of its own end tag; elements that lack one, or whose parent ends first, are not in it."""
    found: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    for m in tags:
        tag = (m.group(3) or m.group(6) or "").lower()
        if tag not in EMBEDDED and tag not in BLOCK:
            continue
        if m.group(2) or m.group(5):
            place = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if place is not None:
                if tag in EMBEDDED:
                    found[stack[place][1]] = m.end()
                del stack[place:]
        elif tag not in VOID and not (tag == "svg" and m.group(0).endswith("/>")):
            stack.append((tag, m.start()))
    return found


def blocks(page: str) -> list[tuple[str, bool, bool]]:
    """(text, in article, dropped by markup) of every block with text, in page order."""
    out: list[tuple[str, bool, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, int, int]] = []  # tag, in article, mark with all around it, its own mark
    in_article, mark, at = False, NOTHING, 0

    def close_block() -> None:
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                out.append((text, in_article, mark))

    def leave(place: int) -> None:
        nonlocal in_article, mark
        del stack[place:]
        in_article, mark = stack[-1][1:3] if stack else (False, NOTHING)

    tags = list(_TAG.finditer(page))
    embedded = _embedded(tags) if any((m.group(3) or m.group(6) or "").lower() in EMBEDDED for m in tags) else {}
    for m in tags:
        if m.start() < at:
            continue
        if m.start() > at:
            parts.append(page[at:m.start()])
        at = embedded.get(m.start(), m.end())
        tag = (m.group(3) or m.group(6) or "").lower()
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if m.group(2) or m.group(5):
            place = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if tag in BLOCK or place is not None and stack[place][2] != mark:
                close_block()
            if place is not None:
                leave(place)
            continue
        attributes = m.group(4) or m.group(7) or ""
        if tag in BLOCK:
            close_block()
            closes = _CLOSED_BY.get(tag, ())
            for k in range(len(stack) - 1, -1, -1):
                name = stack[k][0]
                if name == "p" or name in closes:
                    leave(k)
                elif name in _SCOPE:
                    break
        if tag in VOID or tag in EMBEDDED:
            continue
        # An article counts unless something around it is named; a form may hold the whole page.
        begins = tag in ("article", "main") and all(own < NAMED or t == "form" for t, _, _, own in stack)
        own = _mark(tag, attributes, in_article)
        if in_article and own == HINTED:
            own = NOTHING
        level = own if begins else max(mark, own)
        inner = (in_article or begins) and level < NAMED
        if (inner, level) != (in_article, mark):
            close_block()
        stack.append((tag, inner, level, own))
        in_article, mark = inner, level
    parts.append(page[at:])
    close_block()
    has_article = any(inside for _, inside, _ in out)
    return [(text, inside, found == NAMED or found == HINTED and has_article and not inside) for text, inside, found in out]


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order, by doubling the length that ranks compare."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    step, n = 1, rank.size
    while step < n:
        second = np.full(n, -1, np.int64)
        second[:n - step] = rank[step:]
        key = rank * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank, step = new, 2 * step
        if n and rank.max() == n - 1:
            break
    return order


def passages(tokens: np.ndarray, page: np.ndarray, least: int = LEAST_TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all passages of ``least`` tokens within a page, and their classes: equal passages are neighbours in the suffix array."""
    n = tokens.size
    if n < least:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = suffix_array(tokens)
    whole = order + least <= n
    whole[whole] &= page[order[whole]] == page[order[whole] + least - 1]
    order = order[whole]
    same = np.ones(max(order.size - 1, 0), bool)
    for k in range(least):
        same &= tokens[order[1:] + k] == tokens[order[:-1] + k]
    return order, np.concatenate([[0], np.cumsum(~same)])[:order.size]


def owners(starts: np.ndarray, group: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Number of distinct owners of each class of passages; negative ones do not count."""
    if not starts.size:
        return np.empty(0, np.int64)
    counts = owner[starts] >= 0
    return np.bincount(np.unique(np.stack([group[counts], owner[starts][counts]]), axis=1)[0], minlength=group[-1] + 1)


def spread(starts: np.ndarray, n: int, least: int = LEAST_TOKENS) -> np.ndarray:
    """Which of ``n`` tokens lie in a passage with one of the starts."""
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + least, -1)
    return np.cumsum(cover[:n]) > 0


def covered(tokens: np.ndarray, page: np.ndarray, least: int = LEAST_TOKENS, pages: int = LEAST_PAGES, owner: np.ndarray | None = None) -> np.ndarray:
    """Which tokens lie in a passage of ``least`` tokens that occurs with ``pages`` distinct owners, which are the pages if not given."""
    starts, group = passages(tokens, page, least)
    wide = owners(starts, group, page if owner is None else owner) >= pages
    return spread(starts[wide[group]], tokens.size, least)


def undecided(found: list[tuple[str, bool, bool]]) -> bool:
    """Whether a page has blocks that markup neither drops nor keeps."""
    return any(not inside and not gone for _, inside, gone in found)


def text_key(found: list[tuple[str, bool, bool]]) -> int:
    """64-bit hash of the text of a page without what markup drops."""
    return xxh3_64_intdigest("\n".join(t for t, _, gone in found if not gone).encode())


class Streams:
    """Tokens of the undecided blocks of the pages of one shard, a stream for each page.

    Pages in ``elsewhere`` are copies of a page that is counted elsewhere.
    """

    def __init__(self, pages: list[list[tuple[str, bool, bool]]], elsewhere: set[int] = frozenset()) -> None:
        self.pages = pages
        self.words: dict[str, int] = {}
        keys: dict[int, int] = {}
        tokens, stream, owner, block = [], [], [], []
        blocks_before = np.cumsum([0, *map(len, pages)]).tolist()
        for p, found in enumerate(pages):
            own = -1 if p in elsewhere else keys.setdefault(text_key(found), len(keys))
            for b, (text, inside, gone) in enumerate(found, blocks_before[p]):
                if not inside and not gone:
                    ids = [self.words.setdefault(w, len(self.words)) for w in text.split()]
                    tokens += ids
                    stream += [p] * len(ids)
                    owner += [own] * len(ids)
                    block += [b] * len(ids)
        self.tokens, self.stream, self.owner, self.block = (np.array(x, np.int64) for x in (tokens, stream, owner, block))
        self.n_blocks = blocks_before[-1]

    def hashes(self, starts: np.ndarray) -> np.ndarray:
        """64-bit hash of the passage at each start."""
        word = np.fromiter(map(xxh3_64_intdigest, self.words), np.uint64, len(self.words))
        of_token = word[self.tokens]
        total = np.zeros(starts.size, np.uint64)
        for k in range(LEAST_TOKENS):
            total = (total ^ of_token[starts + k]) * np.uint64(0x9E3779B97F4A7C15)
            total = (total ^ (total >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            total ^= total >> np.uint64(29)
        return total.view(np.int64)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the passages and the number of distinct owners of each, up to the number that makes it boilerplate."""
        starts, group = passages(self.tokens, self.stream)
        first = np.diff(group, prepend=-1) != 0
        return self.hashes(starts[first]), np.minimum(owners(starts, group, self.owner), LEAST_PAGES)

    def covered_by(self, repeated: np.ndarray) -> np.ndarray:
        """Which tokens lie in a passage with one of the hashes."""
        n = self.tokens.size
        starts = np.arange(max(n - LEAST_TOKENS + 1, 0))
        starts = starts[self.stream[starts] == self.stream[starts + LEAST_TOKENS - 1]] if starts.size else starts
        return spread(starts[np.isin(self.hashes(starts), repeated)], n)

    def texts(self, over: np.ndarray) -> list[str]:
        """Text of each page from the blocks that neither markup nor repetition drops."""
        size = np.bincount(self.block, minlength=self.n_blocks)
        full = ((np.bincount(self.block[over], minlength=self.n_blocks) >= COVERED * size) & (size > 0)).tolist()
        out, at = [], 0
        for found in self.pages:
            out.append(page_text(found, full[at:at + len(found)]))
            at += len(found)
        return out


def page_text(found: list[tuple[str, bool, bool]], repeated: list[bool] | None = None) -> str:
    return "\n".join(t for (t, _, gone), r in zip(found, repeated or [False] * len(found), strict=True) if not gone and not r)


def settle_pages(pages: list[list[tuple[str, bool, bool]]]) -> list[str]:
    """Text of each page of one shard."""
    streams = Streams(pages)
    return streams.texts(covered(streams.tokens, streams.stream, owner=streams.owner))


def _packed(found: list[tuple[str, bool, bool]]) -> bytes:
    # No block has a line feed.
    return zlib.compress("\n".join(f"{inside + 2 * gone}{text}" for text, inside, gone in found).encode(), 1)


def _unpacked(packed: bytes) -> list[tuple[str, bool, bool]]:
    lines = zlib.decompress(packed).decode()
    return [(line[1:], line[0] in "13", line[0] in "23") for line in lines.split("\n")] if lines else []


def main_text(pages: DataFrame, shard_pages: int = SHARD_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) per page.

    Blocks are joined by one line feed, white space inside a block is one space, character references are decoded. A null or
    empty html gives an empty text; repeated pages each get a row; a null url is a host of its own. Extra columns do not matter; an
    empty table gives no rows. Pages are parsed once: texts that markup settles and the blocks of the others are written to the shared folder.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    kind = pages.schema["page_id"].dataType.simpleString()
    row = F.xxhash64("page_id", "url", F.length("html"))
    pages = pages.select("page_id", "url", host.alias("host"), row.alias("row"), F.coalesce("html", F.lit("")).alias("html"))

    def parse(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [blocks(t) for t in texts_of(batch, "html")]
        open_ = [undecided(f) for f in found]
        texts = [None if o else page_text(f) for f, o in zip(found, open_, strict=True)]
        packed = [_packed(f) if o else None for f, o in zip(found, open_, strict=True)]
        keys = np.array([text_key(f) if o else 0 for f, o in zip(found, open_, strict=True)], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [*map(batch.column, names), pa.array(texts, pa.string()), pa.array(packed, pa.binary()), pa.array(keys)], [*names, "text", "blocks", "key"])

    names = ["page_id", "url", "host", "row"]
    schema = f"page_id {kind}, url string, host string, row long, text string, blocks binary, key long"
    parsed = kept(map_slices(pages, "html", schema, lambda: parse))
    settled = parsed.filter("blocks IS NULL").select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
    left = parsed.filter("blocks IS NOT NULL").drop("text")
    large = left.groupBy("host").agg(F.count("*").alias("n")).filter(F.col("n") > shard_pages).select(
        "host", F.ceil(F.col("n") / shard_pages).alias("shards"))
    placed = left.join(large, "host", "left").withColumn("at", F.pmod("row", F.coalesce("shards", F.lit(1))))
    on_large = placed.filter("shards IS NOT NULL")
    # A page that comes several times on a large host is counted with the first of its copies only.
    first = on_large.groupBy("host", "key").agg(F.min("row").alias("first"), F.max("row").alias("last")).filter("first < last").drop("last")
    counting = on_large.join(first, ["host", "key"], "left").withColumn("copy", F.coalesce(F.col("row") != F.col("first"), F.lit(False)))

    def count(group: pa.Table) -> pa.Table:
        copies = {p for p, c in enumerate(group.column("copy").to_pylist()) if c}
        hashes, n = Streams([_unpacked(b) for b in group.column("blocks").to_pylist()], copies).counts()
        host_, at = group.column("host")[0].as_py(), group.column("at")[0].as_py()
        return pa.table({"host": pa.array([host_] * n.size, pa.string()), "at": pa.array([at] * n.size, pa.int64()), "hash": hashes, "n": n.astype(np.int64)})

    counted = kept(counting.select("host", "at", "blocks", "copy").groupBy("host", "at").applyInArrow(count, "host string, at long, hash long, n long"))
    repeated = counted.groupBy("host", "hash").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_PAGES).select("host", "hash")
    sent = counted.select("host", "at", "hash").join(repeated, ["host", "hash"], "left_semi")

    def shard(group: pa.Table, other: pa.Table) -> pa.Table:
        pages = [_unpacked(b) for b in group.column("blocks").to_pylist()]
        if not pages or group.column("shards")[0].as_py() is None:
            texts = settle_pages(pages)
        else:
            streams = Streams(pages)
            texts = streams.texts(streams.covered_by(other.column("hash").to_numpy()))
        return pa.table({"page_id": group.column("page_id"), "url": group.column("url"), "text": pa.array(texts, pa.string()),
                         "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    decided = placed.drop("key", "row").groupBy("host", "at").cogroup(sent.groupBy("host", "at")).applyInArrow(
        shard, f"page_id {kind}, url string, text string, n_chars long")
    return settled.unionByName(decided)
