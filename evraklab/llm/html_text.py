"""Main text of web pages: a suffix array over each host, with structure as evidence.

A page is cut into blocks of text, and each block gets a mark from the elements around
it. Blocks of the article (``article``, ``main``, a main role, or a container named as
content) are main; menus, headers, footers, sidebars, notices, adverts, forms, comments,
scripts and styles are dropped, inside an article too; other blocks are open. A page is
read from its main blocks, or from its open ones where it has none.

On every host the blocks of all pages are token streams, and a suffix array finds the long
substrings (``RUN`` tokens and more) that repeat across pages of distinct contents. Exact
copies, and near copies by MinHash over five-word shingles, are one content: what only
copies share is their text. What repeats is removed as boilerplate, unique runs stay:

* open blocks lose every run that ``REPEATS`` contents of the host hold;
* an article loses whole blocks, none of its paragraphs in part, and only where
  ``REPEATS`` contents and the share ``SHARE`` of all contents of the host hold all of the
  block's runs: a line that some articles share is their text. An article that would lose
  all of it stays whole.

How it is spread. Texts stay where they were parsed. Each page sends the hashes of the
windows at which a repeat can begin (block starts of articles, every token of open blocks);
Spark counts the contents of the host that hold each. Only the stretches of tokens behind
windows that are held often enough are brought together, equal ones as one with the number
of contents that have it; they are what the suffix array sorts, as deep as a window: the
union of windows that repeat is the union of longer substrings that do. A host with more
than ``CHUNK_STRETCHES`` distinct stretches is dealt to several tasks by windows: a
stretch is cut into pieces so that equal windows, wherever they stand, meet in one task. So a
host or a group of copies with a third of all pages is spread, with the same results.
Windows are compared by 64-bit hashes that hold the host.

Null html is an empty page, with empty text. A null url is a host of its own. Rows of
equal ids are distinct pages. A very long page is one row of one task. Other columns are
not read, whatever their names; an empty table gives an empty result. Ties do not arise:
counts alone decide. Unclosed and misnested elements close as their parents do.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evraklab.llm.core import components, map_batches, ragged, splitmix, staged

RUN = 8  # tokens of a long substring
REPEATS = 3  # contents of a host that make a substring repeated
SHARE = 0.5  # of the host's contents, for blocks of an article
CHUNK_STRETCHES = 20_000
CHUNK_TOKENS = 1 << 20
# Near copies: shingles, hashes of a signature, its bands, and the share that agrees.
SHINGLE = 5
HASHES = 64
BANDS = 16
SIMILAR = 0.75
MULTIPLIERS = np.random.default_rng(7).integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)

# HTML's elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
DROP_TAGS = frozenset(
    "nav header footer aside form script style noscript iframe svg canvas button select option "
    "textarea input label fieldset template head dialog menu object embed audio video map math".split()
)
MAIN_TAGS = frozenset(("article", "main"))
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr picture source nobr".split()
)
DROP_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split()
)
DROP_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget widgets ad ads adv "
    "advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice "
    "popup modal overlay newsletter subscribe subscription signup share sharing social related recommended "
    "comment comments reply replies respond disqus pagination pager toolbar tags login search skip copyright".split()
)
MAIN_NAMES = frozenset("article content main post entry story".split())
TAG = re.compile(r"<(?:!--(.*?)(?:-->|$)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[!?][^>]*>)", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
SPACES = re.compile(r"\s+")
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr main menu nav ol p pre section table ul".split()
)
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
MAIN, OPEN, DROP = 0, 1, 2


def _mark(tag: str, attributes: str) -> int | None:
    """What an element makes of its inside; None where it changes nothing."""
    if tag in DROP_TAGS:
        return DROP
    if attributes:
        names: list[str] = []
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return DROP
            if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return DROP
            if name == "role":
                if value in DROP_ROLES:
                    return DROP
                if value in ("main", "article"):
                    return MAIN
            if name in ("class", "id"):
                names += value.split()
        if tag not in ("html", "body") and names:
            parts = {p for n in names for p in re.split(r"[-_]+", n)}
            if tag not in MAIN_TAGS and parts & DROP_NAMES:
                return DROP
            if tag not in INLINE and parts & MAIN_NAMES:
                return MAIN
    return MAIN if tag in MAIN_TAGS else None


def blocks(page: str) -> list[tuple[int, str]]:
    """(mark, text) of the page's blocks in order, white space folded, without empty ones."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    mark = OPEN
    run: list[str] = []

    def flush() -> None:
        text = SPACES.sub(" ", entities.unescape("".join(run))).strip()
        run.clear()
        if text:
            out.append((mark, text))

    def close(tag: str) -> None:
        nonlocal mark
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == tag:
                flush()
                mark = stack[i][1]
                del stack[i:]
                return

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if m is None:
            run.append(page[at:])
            break
        run.append(page[at : m.start()])
        at = m.end()
        tag = m.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(2):
            if tag in INLINE:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        if stack[i][1] != mark:
                            flush()
                            mark = stack[i][1]
                        del stack[i]
                        break
                    if stack[i][0] not in INLINE:
                        break
            elif tag == "p" and not any(t == "p" for t, _ in stack):
                flush()
            else:
                close(tag)
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            if tag not in INLINE:
                flush()
            continue
        if tag not in INLINE:
            flush()
            if tag in CLOSES_P:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        mark = stack[i][1]
                        del stack[i:]
                        break
                    if stack[i][0] not in INLINE:
                        break
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in SAME.get(tag, ()):
                    mark = stack[i][1]
                    del stack[i:]
                    break
                if stack[i][0] in ("ul", "ol", "dl", "table", "select"):
                    break
        if tag in VOID or m.group(4).endswith("/"):
            continue
        found = _mark(tag, m.group(4))
        stack.append((tag, mark))
        new = mark if found is None or mark == DROP else found
        if new != mark:
            if tag in INLINE:
                flush()
            mark = new
    flush()
    return out


def host_of(url: str | None) -> str:
    found = re.match(r"[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return found.group(1).lower() if found else ""


def window_ranks(tokens: np.ndarray) -> np.ndarray:
    """Rank of every suffix of ``tokens`` by its first ``RUN`` tokens.

    A suffix array by prefix doubling, stopped at that depth: equal ranks mean that the
    substrings of that length are equal. ``RUN`` is a power of two.
    """
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    depth = 1
    while depth < RUN:
        after = np.zeros(len(rank), np.int64)
        after[:-depth or None] = rank[depth:] + 1 if depth < len(rank) else 0
        rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)[1].astype(np.int64)
        depth *= 2
    return rank


def _hashes(text: str) -> list[int]:
    return [xxhash.xxh64_intdigest(w.encode()) | 1 << 63 for w in text.lower().split()]


def _stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated tokens of the blocks of a page, and where each block ends."""
    tokens = [_hashes(t) for t in texts]
    ends = np.cumsum([len(t) for t in tokens], dtype=np.int64)
    return np.array([h for t in tokens for h in t], np.uint64), ends


def _window_hash(tokens: np.ndarray, starts: np.ndarray, width: int = RUN, seed: int = 0) -> np.ndarray:
    value = np.full(len(starts), seed & (1 << 64) - 1, np.uint64)
    for k in range(width):
        value = value * np.uint64(0x9E3779B97F4A7C15) + tokens[starts + k]
    return splitmix(value).view(np.int64)


def signature(tokens: np.ndarray) -> np.ndarray:
    """MinHash values of the five-word shingles; a shorter text is one shingle."""
    width = min(SHINGLE, len(tokens))
    shingles = _window_hash(tokens, np.arange(len(tokens) - width + 1), width).view(np.uint64)
    if len(shingles) > 10_000:
        least = np.array([(shingles * a).min() for a in MULTIPLIERS])
    else:
        least = (shingles[:, None] * MULTIPLIERS).min(axis=0)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def window_places(n_tokens: int, ends: np.ndarray, article: bool) -> np.ndarray:
    """Tokens at which a repeat can begin: block starts of an article, all of other pages."""
    last = n_tokens - RUN
    if last < 0:
        return np.zeros(0, np.int64)
    if not article:
        return np.arange(last + 1)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    return starts[starts <= last]


def stretches(places: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal stretches behind ``places``: a window each, and on to the end of its block."""
    out: list[tuple[int, int]] = []
    for start in np.sort(places).tolist():
        end = max(start + RUN, int(ends[np.searchsorted(ends, start, side="right")]))
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def pieces(tokens: np.ndarray, chunks: int) -> list[tuple[int, int, int]]:
    """A stretch cut for sorting in ``chunks`` parts: (part, start, end) of each piece.

    Equal windows have the same least hash of two neighbouring tokens, which names their part,
    so every part has all windows that it has to compare, of whatever stretches.
    """
    last = len(tokens) - RUN
    if chunks <= 1 or last < 0:
        return [(0, 0, len(tokens))]
    pairs = _window_hash(tokens, np.arange(len(tokens) - 1), 2).view(np.uint64)
    anchors = np.lib.stride_tricks.sliding_window_view(pairs, RUN - 1).min(axis=1)
    parts = (splitmix(anchors) % np.uint64(chunks)).astype(np.int64)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(parts)) + 1, [last + 1]])
    return [(int(parts[s]), int(s), int(e) - 1 + RUN) for s, e in zip(edges[:-1], edges[1:])]


def repeated_runs(
    streams: list[np.ndarray], held: np.ndarray, least: np.ndarray, names: np.ndarray | None = None
) -> list[list[int]]:
    """Runs of each stream, as start, end, start, ..., whose windows enough contents hold.

    ``held[i]`` contents have stream i, and its windows repeat if the streams that have them
    are held ``least[i]`` times together. Streams of equal ``names`` are pieces of one, whose
    windows count once. Each stream ends in a token of its own.
    """
    tokens = np.concatenate([np.append(t, np.uint64(i)) for i, t in enumerate(streams)])
    sizes = np.array([len(t) + 1 for t in streams])
    owner = np.repeat(np.arange(len(streams)), sizes)
    offset = np.cumsum(sizes) - sizes
    ranks = window_ranks(tokens)
    starts = np.arange(len(tokens))
    starts = starts[starts - offset[owner] + RUN < sizes[owner]]
    whole = np.arange(len(streams)) if names is None else np.unique(names, return_inverse=True)[1]
    first = np.unique(np.stack([ranks[starts], whole[owner[starts]]], axis=1), axis=0, return_index=True)[1]
    times = np.bincount(ranks[starts[first]], held[owner[starts[first]]], minlength=len(tokens))
    starts = starts[times[ranks[starts]] >= least[owner[starts]]]
    edge = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + RUN, -1)
    covered = np.cumsum(edge)[:-1] > 0
    out = []
    for at, size in zip(offset, sizes):
        inside = covered[at : at + size - 1].astype(np.int8)
        out.append(np.flatnonzero(np.diff(np.concatenate([[0], inside, [0]]))).tolist())
    return out


def unique_runs(text: str, repeated: np.ndarray) -> str:
    """A block without its repeated runs of a whole window, or without all if all is repeated.

    A shorter run at an edge, where a window reaches over from the next block, stays.
    """
    if not repeated.any():
        return text
    if repeated.all():
        return ""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], repeated, [False]]).astype(np.int8)))
    keep = np.ones(len(repeated), bool)
    for start, end in zip(edge[::2], edge[1::2]):
        if end - start >= RUN:
            keep[start:end] = False
    return " ".join(w for w, k in zip(text.split(), keep) if k)


def near_copies(contents: DataFrame) -> DataFrame:
    """Contents (content, root) of a host that are near copies of others; root names the group.

    ``contents`` has one row of (site, content, signature) per content. Contents that agree in
    a band of their signatures meet; in each bucket all are compared with its least and its
    greatest, so a large group makes no pairs.
    """
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda i: F.xxhash64("site", i, F.slice("signature", i * (HASHES // BANDS) + 1, HASHES // BANDS)),
    )
    placed = contents.select("content", F.explode(bands).alias("bucket"))
    ends = placed.groupBy("bucket").agg(F.min("content").alias("low"), F.max("content").alias("high")).filter("low < high")
    met = placed.join(ends, "bucket").select(F.col("content").alias("a"), F.explode(F.array("low", "high")).alias("b"))
    met = met.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    of = lambda name: contents.select(F.col("content").alias(name), F.col("signature").alias(f"s{name}"))
    agree = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda same: same))
    close = met.join(of("a"), "a").join(of("b"), "b").filter(agree >= SIMILAR * HASHES)
    return components(close.select("a", "b")).select(F.col("node").alias("content"), "root")


def parsed(pages: DataFrame) -> DataFrame:
    """Pages with the blocks they are read from, and the windows at which a repeat can begin."""
    id_type = pages.schema["page_id"].dataType.simpleString()
    slim = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def parse(batch: pa.RecordBatch) -> pa.RecordBatch:
        sites, articles, texts, contents, signatures, windows, places = [], [], [], [], [], [], []
        for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            found = blocks(page or "")
            site = xxhash.xxh64_intdigest(host_of(url).encode())
            least = min((k for k, _ in found), default=DROP)
            texts.append([t for k, t in found if k == least != DROP])
            tokens, ends = _stream(texts[-1])
            at = window_places(len(tokens), ends, least == MAIN)
            sites.append(site)
            articles.append(least == MAIN)
            contents.append(xxhash.xxh64_intdigest(tokens.tobytes(), site))
            signatures.append(signature(tokens))
            windows.append(_window_hash(tokens, at, RUN, site))
            places.append(at)
        signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        counts = [len(p) for p in places]
        columns = [batch.column(0), batch.column(1), signed(sites), pa.array(articles), signed(contents)]
        columns += [pa.array(texts, pa.list_(pa.string()))]
        columns += [ragged(np.concatenate(signatures), [HASHES] * len(signatures), pa.int32())]
        columns += [ragged(np.concatenate(windows), counts, pa.int64()), ragged(np.concatenate(places), counts, pa.int32())]
        names = ["page_id", "url", "site", "article", "content", "texts", "signature", "windows", "places"]
        return pa.RecordBatch.from_arrays(columns, names)

    return map_batches(
        slim, parse,
        f"page_id {id_type}, url string, site bigint, article boolean, content bigint, texts array<string>, "
        "signature array<int>, windows array<bigint>, places array<int>",
    )


def boilerplate(read: DataFrame, chunk: int = CHUNK_STRETCHES) -> DataFrame:
    """Runs of tokens that the host repeats: (content, runs), runs as start, end, start, ..."""
    columns = ("site", "article", "signature", "windows", "places")
    contents = staged(read.groupBy("content").agg(F.min_by(F.struct(*columns), "article").alias("c")).select("content", "c.*"))
    grouped = contents.join(near_copies(contents), "content", "left").withColumn("group", F.coalesce("root", "content"))
    spots = F.explode(F.arrays_zip(F.col("windows").alias("window"), F.col("places").alias("place"))).alias("spot")
    hosts = grouped.groupBy("site").agg(F.countDistinct("group").alias("all"))
    spread = staged(grouped.select("site", "article", "group", "content", spots).select("*", "spot.*").drop("spot"))

    # How many contents of a host hold a window; copies count once.
    held = spread.select("site", "window", "group").distinct().groupBy("site", "window").agg(F.count("*").alias("n"))
    of_article = F.greatest(F.lit(REPEATS), F.ceil(SHARE * F.col("all"))).cast("bigint")
    often = held.filter(F.col("n") >= REPEATS).join(hosts, "site").select("window", "n", of_article.alias("most"))
    least = F.when(F.col("article"), F.col("most")).otherwise(REPEATS)
    begun = spread.join(often, "window").withColumn("least", least).filter("n >= least")
    begun = begun.groupBy("content").agg(
        F.first("site").alias("site"), F.first("group").alias("group"), F.first("least").alias("least"),
        F.collect_list("place").alias("places"),
    )
    # Of the pages of one content any will do, as their tokens are equal. Written first, so
    # that by its size it is broadcast, or beyond Spark's threshold the texts move to it.
    chosen = read.select("content", "texts").join(staged(begun), "content").dropDuplicates(["content"])

    def pick(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {k: [] for k in ("content", "site", "group", "least", "at", "key", "tokens")}
        for row in batch.to_pylist():
            tokens, ends = _stream(row["texts"])
            for start, end in stretches(np.array(row["places"]), ends):
                run = tokens[start:end].view(np.int64)
                out["key"].append(xxhash.xxh3_64_intdigest(run.tobytes(), row["least"]) - (1 << 63))
                out["tokens"].append(run)
                out["at"].append(start)
                for k in ("content", "site", "group", "least"):
                    out[k].append(row[k])
        return pa.RecordBatch.from_pydict(out)

    picked = staged(
        map_batches(
            chosen.select("content", "texts", "site", "group", "least", "places"), pick,
            "content bigint, site bigint, group bigint, least bigint, at bigint, key bigint, tokens array<bigint>",
        )
    )
    each = picked.groupBy("site", "key", "least").agg(
        F.countDistinct("group").alias("held"), F.first("tokens").alias("tokens")
    )
    each = staged(each)
    chunks = F.ceil(F.greatest(F.count("*") / chunk, F.sum(F.size("tokens")) / CHUNK_TOKENS)).alias("chunks")
    dealt = each.join(each.groupBy("site").agg(chunks), "site")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {k: [] for k in ("part", "site", "key", "least", "held", "begin", "tokens")}
        for row in batch.to_pylist():
            run = np.array(row["tokens"], np.int64)
            for part, start, end in pieces(run.view(np.uint64), row["chunks"]):
                out["part"].append(part)
                out["begin"].append(start)
                out["tokens"].append(run[start:end])
                for k in ("site", "key", "least", "held"):
                    out[k].append(row[k])
        return pa.RecordBatch.from_pydict(out)

    def search(group: pa.Table) -> pa.Table:
        streams = [np.array(t, np.int64).view(np.uint64) for t in group.column("tokens").to_pylist()]
        of = {k: group.column(k).to_numpy() for k in ("held", "least", "key", "begin")}
        runs = repeated_runs(streams, of["held"], of["least"], of["key"])
        moved = [[at + r for r in found] for at, found in zip(of["begin"].tolist(), runs)]
        return pa.table({"site": group.column("site"), "key": group.column("key"), "runs": pa.array(moved, pa.list_(pa.int64()))})

    slim = map_batches(
        dealt.select("site", "key", "least", "held", "tokens", "chunks"), cut,
        "part bigint, site bigint, key bigint, least bigint, held bigint, begin bigint, tokens array<bigint>",
    ).withColumn("part", F.xxhash64("site", "part"))
    found = slim.groupBy("part").applyInArrow(search, "site bigint, key bigint, runs array<bigint>").filter("size(runs) > 0")
    placed = picked.select("content", "site", "at", "key").join(found, ["site", "key"])
    moved = F.transform("runs", lambda r: r + F.col("at"))
    return placed.groupBy("content").agg(F.flatten(F.collect_list(moved)).alias("runs"))


def extract(pages: DataFrame, chunk: int = CHUNK_STRETCHES) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points)."""
    id_type = pages.schema["page_id"].dataType.simpleString()
    read = staged(parsed(pages), "zstd")
    cuts = staged(boilerplate(read, chunk))

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for row in batch.select(["article", "texts", "runs"]).to_pylist():
            texts, left = row["texts"], row["texts"]
            if row["runs"]:
                ends = np.cumsum([len(t.split()) for t in texts])
                repeated = np.zeros(ends[-1], bool)
                for start, end in zip(row["runs"][::2], row["runs"][1::2]):
                    repeated[start:end] = True
                by_block = np.split(repeated, ends[:-1])
                if row["article"]:
                    left = [t for t, r in zip(texts, by_block) if not r.all()] or texts
                else:
                    left = [u for t, r in zip(texts, by_block) if (u := unique_runs(t, r))]
            out.append("\n".join(left))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    told = read.select("page_id", "url", "article", "texts", "content").join(cuts, "content", "left")
    told = told.select("page_id", "url", "article", "texts", "runs")
    done = map_batches(told, finish, f"page_id {id_type}, url string, text string")
    return done.withColumn("n_chars", F.length("text").cast("bigint"))
