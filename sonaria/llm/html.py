"""Main text of web pages.

A page's markup is cut into blocks of text. The pages of a host are decided by a suffix array over their
token streams, cut at a depth of ``depth`` tokens: suffixes are grouped by their first tokens, and those that
begin alike on two or more distinct pages start a repeated substring. The union of such beginnings is exactly
what all repeated substrings of ``depth`` tokens or more cover. Covered tokens are boilerplate and go, within
a block as well; the unique runs of a block stay together. All pages take part with all their blocks, those
that markup rules out as a stream of their own, so that no suffix runs from a menu into the text.

Markup that names its role checks what the suffixes say. What stands in an article (or else in main) is kept,
also where it repeats, and so is the same passage on a page without one; menus, headers, footers, side bars,
notices, adverts, forms and comments go, also where they stand only once.

Suffixes meet in buckets of their hashes, each of a bounded number of characters of pages, so a host or a
phrase that fills a third of all pages never meets in one task. They meet twice: first a short hash of each
suffix's anchor, which it shares with its neighbours and with all equal suffixes, then in whole those whose
anchor may stand on another page.

Rows: a null page counts as empty and has an empty text; every row, repeated or with null keys,
gives one row; pages of a host with the same blocks count once as evidence, whatever their ids; a
null url is a host of its own; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonaria.llm.common import spread_join, table, written

DEPTH = 8
#: Characters of pages whose suffixes make one bucket, and the least number of buckets.
BUCKET_CHARS = 16_000_000
LEAST_BUCKETS = 16
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Attributes as browsers cut them: an unquoted value ends at white space or ">" and may hold quotes.
_ATTRIBUTES = r"(?>[\s/]+|[^\s/>][^\s/>=]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*))?)*+"
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(script|style|textarea|iframe|title)(?=[\s/>]){_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})>"
    r"|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
#: Elements left out with all they hold where they are closed; an unclosed one is left out alone.
_HIDDEN = {name: re.compile(rf"</{name}\s*>", re.I) for name in "noscript template svg select object math".split()}
_NAME = re.compile(r"<([a-zA-Z]+)\b")
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav footer aside form button menu dialog head label input search".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
#: Elements that carry text of their own; their class and id say nothing of their role.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre td th dt dd caption figcaption html body main".split())
#: Names of the parts of a page that are not its main text: a whole class or id, or its first part
#: where the others are such names too or name a part of the layout.
PARTS = frozenset(
    "ad ads adv advert adverts advertisement sponsor sponsored promo banner sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "comment comments commentlist disqus respond replies cookie cookies consent gdpr notice notices notification alert popup modal "
    "newsletter subscribe signup login share sharing social related recommended footer masthead toolbar pagination pager widget search".split()
)
LAYOUT = frozenset("area bar box block button buttons container content form icons inner item items left line links list panel right section slot thread top bottom unit wrap wrapper".split())
_ATTR = re.compile(r"([^\s/>=][^\s/>=]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*))?")


def _names_part(name: str) -> bool:
    """Whether a class or an id is the name of a part that is not main text."""
    first, *others = name.replace("_", "-").strip("-").split("-")
    return first in PARTS and all(o in PARTS or o in LAYOUT or o.isdigit() for o in others)


def _is_noise(name: str, attributes: str, inside: bool) -> bool:
    if name in DROPPED:
        return True
    if name == "header":
        return not inside
    if not attributes:
        return False
    found = {k.lower(): (v or "").strip("\"'").lower() for k, v in _ATTR.findall(attributes)}
    if name not in ("html", "body") and ("hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", ""))):
        return True
    if found.get("role") in ROLES:
        return True
    if name in TEXT:
        return False
    names = [n for k in ("class", "id") for n in found.get(k, "").split()]
    return any(map(_names_part, names)) or (not inside and "header" in names)


def blocks(html: str) -> tuple[list[str], bool]:
    """The blocks of text that markup does not rule out, and whether an article decides them."""
    return parts_of(html)[:2]


def parts_of(html: str) -> tuple[list[str], bool, list[str]]:
    """The blocks of text that markup does not rule out, whether an article decides them, and all other blocks."""
    found: list[tuple[str, str]] = []  # a block, and what markup says of it
    text: list[str] = []
    deep = {"article": 0, "main": 0}
    skip, depth = "", 0  # the element that is left out, and how deep its own name is nested
    at = 0
    unclosed: set[str] = set()  # hidden elements that are not closed from here on

    def close() -> None:
        block = " ".join(unescape("".join(text)).split())
        text.clear()
        if block:
            found.append((block, "out" if skip else "article" if deep["article"] else "main" if deep["main"] else ""))

    while tag := _TAG.search(html, at):
        if tag.start() > at:
            text.append(html[at : tag.start()])
        at = tag.end()
        opened = _NAME.match(html, tag.start())
        if opened and (hidden := opened.group(1).lower()) in _HIDDEN:
            if hidden in ("svg", "math") and tag.group().endswith("/>"):
                continue
            if hidden not in unclosed and (end := _HIDDEN[hidden].search(html, at)):
                at = end.end()
            else:
                unclosed.add(hidden)
            continue
        name = (tag.group(3) or "").lower()
        if not name:
            continue
        ends = tag.group(2) == "/"
        if skip:
            implied = skip in ("p", "li") and not ends and name in BLOCKS and (skip == "p" or name == "li") or skip in ("p", "li") and ends and name in ("ul", "ol", "div", "article", "section", "body")
            if name == skip:
                depth += -1 if ends else 1
                if skip in ("p", "li") and not ends:
                    depth = 0
            if depth > 0 and not implied:
                if name in BLOCKS:
                    close()
                continue
            close()
            skip = ""
            if ends:
                continue
        if name in BLOCKS:
            close()
        elif name == "br":
            text.append(" ")
        if name in deep:
            deep[name] = max(0, deep[name] - 1) if ends else deep[name] + 1
            if not ends and _is_noise(name, tag.group(4), True):
                deep[name] -= 1
                skip, depth = name, 1
        elif not ends and name not in VOID and _is_noise(name, tag.group(4), bool(deep["article"] or deep["main"])):
            close()
            skip, depth = name, 1
    if at < len(html):
        text.append(html[at:])
    close()
    said = {x for _, x in found}
    chosen = {"article"} if "article" in said else {"main"} if "main" in said else {""}
    return [b for b, x in found if x in chosen], chosen != {""}, [b for b, x in found if x not in chosen]


class _Hashes(dict):
    """Hashes of tokens, of the last 500,000 at most."""

    def __missing__(self, token: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        self[token] = h = xxhash.xxh64_intdigest(token)
        return h


_HASHES = _Hashes()


def _tokens(parts: list[str]) -> np.ndarray:
    """Hashes of the tokens of a stream."""
    tokens = "\n".join(parts).encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(_HASHES.__getitem__, tokens), np.uint64, len(tokens))


def _rolled(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Hashes of all runs of ``depth`` tokens."""
    n = max(0, len(tokens) - depth + 1)
    out = np.zeros(n, np.uint64)
    for i in range(depth if n else 0):
        out = out * _FACTOR + tokens[i : i + n]
    return out


def windows(parts: list[str], depth: int = DEPTH) -> np.ndarray:
    """Hashes of the first ``depth`` tokens of each suffix of a token stream that has as many."""
    return _rolled(_tokens(parts), depth)


def anchors(tokens: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Of each window the smallest hash of the runs in it that are two tokens shorter: equal windows have equal ones,
    and neighbouring windows mostly the same."""
    runs = _rolled(tokens, max(1, depth - 2))
    n, shorter = max(0, len(tokens) - depth + 1), min(2, depth - 1)
    out = runs[:n]
    for i in range(1, shorter + 1):
        out = np.minimum(out, runs[i : i + n])
    return out


def covered(found: np.ndarray, repeated: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Which tokens of a stream of the windows ``found`` repeated ones cover."""
    steps = np.zeros(len(found) + depth, np.int64)
    starts = np.flatnonzero(np.isin(found, repeated))
    steps[starts] += 1
    steps[starts + depth] -= 1
    return np.cumsum(steps)[:-1] > 0


def unique_runs(parts: list[str], gone: np.ndarray) -> list[str]:
    """The blocks without the tokens that are ``gone``; beyond its end none is."""
    at, kept = 0, []
    for block in parts:
        tokens = block.split()
        here = gone[at : at + len(tokens)]
        at += len(tokens)
        if left := [t for i, t in enumerate(tokens) if i >= len(here) or not here[i]]:
            kept.append(" ".join(left))
    return kept


PARSED = "page_id long, url string, host long, page long, key long, decided boolean, blocks array<string>, others array<string>"


def _number(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def parse(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """The pages' blocks, whether markup has decided them, a number of equal pages of a host, and one of those
    with equal other blocks."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = rows.select("page_id", "url", host.alias("host"), "html")
    names = [c.split()[0] for c in PARSED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts = batch.column("host").to_pylist()
            found = [parts_of(h) for h in batch.column("html").to_pylist()]
            # copies of a page under other ids on a host are one page as evidence
            page = [_number("\n".join([host, *b])) for host, (b, _, _) in zip(hosts, found)]
            key = [_number("\n".join([f"{p} {d}", *o])) for p, (_, d, o) in zip(page, found)]
            longs = [pa.array(x, pa.int64()) for x in ([_number(h) for h in hosts], page, key)]
            blocks, decided, others = zip(*found) if found else ((), (), ())
            columns = [batch.column("page_id"), batch.column("url"), *longs, pa.array(decided, pa.bool_()), pa.array(blocks, pa.list_(pa.string())), pa.array(others, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, PARSED)


def _salted(host: int, hashes: np.ndarray) -> np.ndarray:
    return hashes ^ np.uint64(host + (1 << 63))


#: What markup says of the blocks that a window comes from.
_RULED_OUT, _PROVEN, _OPEN = range(3)
_KINDS = 3
#: Pages whose hashes go in one row to each bucket; a place, a page's with its kind, has two bytes.
GROUP_PAGES = 20_000
#: A row lists a group's keys, or holds its hashes in a bucket with their places and the numbers of the pages there.
_DEALT = "bucket long, grp long, keys binary, pages binary, places binary, hashes binary"
_ANSWERS = "grp long, keys binary, places binary, counts binary, free binary, hashes binary"
#: Pages, and bytes of hashes, up to which an answer is broadcast to the pages.
SMALL_ROWS, SMALL_BYTES = 500_000, 64_000_000


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The pages of a batch, each key once."""
    for batch in batches:
        for start in range(0, batch.num_rows, GROUP_PAGES):
            columns = batch.slice(start, GROUP_PAGES).to_pydict()
            yield list({row[0]: row for row in zip(*columns.values())}.values())


def _dealt(pages: list[tuple], places: list[np.ndarray], hashes: list[np.ndarray], of: np.ndarray, buckets: int, named: bool) -> pa.RecordBatch:
    """One row of a group for each bucket it has hashes in, and one that lists its keys."""
    keys = np.array([p[0] for p in pages], np.int64)
    group = xxhash.xxh64_intdigest(keys.tobytes()) - (1 << 63)
    rows = [(group % buckets, group, keys.tobytes(), b"", b"", b"")]
    order = np.argsort(of, kind="stable")
    at, h, of = np.concatenate(places)[order], np.concatenate(hashes)[order], of[order]
    numbers = np.array([p[1] for p in pages], np.int64)
    for b, i, n in zip(*(x.tolist() for x in np.unique(of, return_index=True, return_counts=True))):
        here = at[i : i + n]
        rows.append((b, group, b"", numbers[np.unique(here // _KINDS)].tobytes() if named else b"", here.tobytes(), h[i : i + n].tobytes()))
    types = (pa.int64(), pa.int64(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [c.split()[0] for c in _DEALT.split(", ")])


def _bucket(rows: pa.Table, kind: type) -> tuple[list[tuple], list[tuple], np.ndarray, np.ndarray]:
    """The lists of keys in a bucket, as answers; of each group its number, page numbers and places; all hashes, and
    where each group's end. Groups of the same keys have the same hashes and count once."""
    listed, held = {}, {}
    for group, keys, pages, places, hashes in zip(*(rows.column(c).to_pylist() for c in ("grp", "keys", "pages", "places", "hashes"))):
        if keys:
            listed[group] = (group, keys, b"", b"", b"", b"")
        else:
            held[group] = (group, np.frombuffer(pages, np.int64), np.frombuffer(places, np.uint16), np.frombuffer(hashes, kind))
    h = np.concatenate([np.zeros(0, kind), *[x[3] for x in held.values()]])
    return list(listed.values()), list(held.values()), h, np.cumsum([0, *[len(x[3]) for x in held.values()]])


def _answers(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * 6
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), *[pa.binary()] * 5))], [c.split()[0] for c in _ANSWERS.split(", ")])


def _met(rows: pa.Table) -> pa.Table:
    """Of each group's anchors in a bucket those that stand there twice."""
    out, held, h, ends = _bucket(rows, np.uint32)
    ordered = np.sort(h)
    twice = np.isin(h, ordered[1:][ordered[1:] == ordered[:-1]])
    for (group, _, places, own), start, end in zip(held, ends, ends[1:]):
        if (here := twice[start:end]).any():
            out.append((group, b"", b"", b"", places[here].tobytes(), own[here].tobytes()))
    return _answers(out)


def _shared(rows: pa.Table) -> pa.Table:
    """Of each group's windows in a bucket: how many of a page another page has too, and for pages that markup leaves
    open those of them that no article holds."""
    out, held, h, ends = _bucket(rows, np.uint64)
    if not len(h):
        return _answers(out)
    page = np.concatenate([numbers[np.unique(places // _KINDS, return_inverse=True)[1]] for _, numbers, places, _ in held])
    kind = np.concatenate([places % _KINDS for _, _, places, _ in held])
    order = np.argsort(h, kind="stable")
    new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
    starts, equal = np.flatnonzero(new), np.empty(len(h), np.int64)
    equal[order] = np.cumsum(new) - 1
    repeated = np.minimum.reduceat(page[order], starts) != np.maximum.reduceat(page[order], starts)
    proven = np.logical_or.reduceat(kind[order] == _PROVEN, starts)
    twice, free = repeated[equal], (repeated & ~proven)[equal] & (kind == _OPEN)
    for (group, _, places, own), start, end in zip(held, ends, ends[1:]):
        at, counts = np.unique(places[twice[start:end]] // _KINDS, return_counts=True)
        here = free[start:end]
        if len(at):
            out.append((group, b"", at.tobytes(), counts.astype(np.uint32).tobytes(), places[here].tobytes(), own[here].tobytes()))
    return _answers(out)


def _by_key(rows: pa.Table, kind: type) -> pa.Table:
    """key, n, hashes of the pages of a group, from its list of keys and the answers of all buckets."""
    lists = [np.frombuffer(x, t) for c, t in (("keys", np.int64), ("places", np.uint16), ("counts", np.uint32), ("free", np.uint16), ("hashes", kind)) for x in [b"".join(rows.column(c).to_pylist() if c != "keys" else [max(rows.column(c).to_pylist(), key=len)])]]
    keys, places, counts, free, hashes = lists
    n = np.bincount(places, counts, len(keys)).astype(np.int64)
    order = np.argsort(free // _KINDS, kind="stable")
    hashes, cuts = hashes[order], np.searchsorted((free // _KINDS)[order], np.arange(len(keys) + 1))
    return pa.table({"key": keys, "n": n, "hashes": pa.array([hashes[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary())})


def _told(dealt: DataFrame, bucket, kind: type) -> DataFrame:
    """key, n, hashes: what the buckets say of each page; copies of a page are told the same."""
    answers = dealt.groupBy("bucket").applyInArrow(bucket, _ANSWERS)
    return answers.groupBy("grp").applyInArrow(lambda rows: _by_key(rows, kind), "key long, n long, hashes binary")


def _joined(parsed: DataFrame, told: DataFrame) -> tuple[DataFrame, int]:
    """The pages with what is told of each, and how many bytes of hashes that is."""
    rows, held = told.agg(F.count("*"), F.sum(F.length("hashes"))).first()
    told = told.groupBy("key").agg(F.first("n").alias("n"), F.first("hashes").alias("hashes"))
    if rows <= SMALL_ROWS and (held or 0) <= SMALL_BYTES:
        return parsed.join(F.broadcast(told), "key"), held or 0
    return spread_join(parsed, told, ["key"], F.xxhash64("page_id", "url")), held or 0


def repeated_anchors(parsed: DataFrame, buckets: int, depth: int = DEPTH) -> DataFrame:
    """key, n, hashes: the low halves of the anchors of each page that may stand on another page of its host too.

    A window on two pages has its anchor on both, so none is missed; what meets by chance, or only as an anchor, is
    told apart by the whole windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pages in _groups(batches):
            places, hashes = [], []
            for i, (_, _, host, _, kept, others) in enumerate(pages):
                h = np.unique(_salted(host, np.concatenate([anchors(_tokens(x), depth) for x in (kept, others)])))
                hashes.append(h)
                places.append(np.full(len(h), i * _KINDS, np.uint16))
            of = (np.concatenate(hashes) >> np.uint64(32)) % np.uint64(buckets)
            yield _dealt(pages, places, [h.astype(np.uint32) for h in hashes], of, buckets, False)

    return _told(parsed.select("key", "page", "host", "decided", "blocks", "others").mapInArrow(run, _DEALT), _met, np.uint32)


def repeated_windows(parsed: DataFrame, buckets: int, depth: int = DEPTH) -> DataFrame:
    """key, n, hashes: how many windows of each page two or more pages of its host have, and those that make boilerplate
    of what markup leaves open; of pages with the anchors that may stand on another page (hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pages in _groups(batches):
            places, hashes = [], []
            for i, (_, _, host, decided, kept, others, met) in enumerate(pages):
                streams = []
                for parts in (kept, others):
                    tokens = _tokens(parts)
                    may = np.isin(_salted(host, anchors(tokens, depth)).astype(np.uint32), np.frombuffer(met, np.uint32))
                    streams.append(_salted(host, _rolled(tokens, depth)[may]))
                for kind, h in zip((_PROVEN, _RULED_OUT), streams) if decided else ((_OPEN, np.concatenate(streams)),):
                    h = np.unique(h)
                    hashes.append(h)
                    places.append(np.full(len(h), i * _KINDS + kind, np.uint16))
            of = (np.concatenate(hashes) >> np.uint64(24)) % np.uint64(buckets)
            yield _dealt(pages, places, hashes, of, buckets, True)

    return _told(parsed.select("key", "page", "host", "decided", "blocks", "others", "hashes").mapInArrow(run, _DEALT), _shared, np.uint64)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", depth: int = DEPTH) -> DataFrame:
    """page_id, url, text, n_chars for every page, and n_repeated: its windows that other pages of its host have."""
    size = pages.agg(F.sum(F.char_length(F.col(html_col)))).first()[0] or 0
    parsed = parse(pages, id_col, url_col, html_col)  # three times, as that is cheaper than to keep it
    met = written(repeated_anchors(parsed, max(LEAST_BUCKETS, -(-size // BUCKET_CHARS)), depth), "repeated-anchors")
    asked, held = _joined(parsed, met)
    # an anchor has four bytes and stands for about two windows
    found = written(repeated_windows(asked, max(LEAST_BUCKETS, -(-held // (BUCKET_CHARS // 4))), depth), "repeated-windows")
    joined, _ = _joined(parsed, found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for host, decided, kept, hashes in zip(*(batch.column(n).to_pylist() for n in ("host", "decided", "blocks", "hashes"))):
                if not decided and hashes:
                    own = _salted(host, windows(kept, depth))
                    kept = unique_runs(kept, covered(own, np.frombuffer(hashes, np.uint64), depth))
                texts.append("\n".join(kept))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), batch.column("n")], ["page_id", "url", "text", "n_repeated"])

    made = joined.select("page_id", "url", "host", "decided", "blocks", "hashes", "n").mapInArrow(run, "page_id long, url string, text string, n_repeated long")
    return made.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_repeated")


def op2_query(spark, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
