"""Main text of web pages by equivalence classes of template tokens.

A token is a container's path of tags (with its class), or such a path with the text of a block in it; its occurrence
vector over the pages of a host says how often each page has it. Tokens of one host with equal vectors form a class, found by
grouping on the host and an order-free digest of the vector, so no host's pages ever meet in one task. Large and frequent
classes are valid; they nest as their paths do, and make the host's template. Its blocks go. Of its slots (containers that each page
has once, and that hold text which isn't the template's) the main one is the deepest that holds most of the varying
plain text of the host and leaves no varying heading beside it. That is decided by counts alone. Tag and class names serve pages
without a template, and drop what is named as an advert, a comment and so on inside the slot.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

MIN_PAGES = 2
MIN_SHARE = 0.5
#: Share of a host's varying plain text that its main slot holds at least.
SLOT_SHARE = 0.6
#: Containers that hold no article text: by tag, by a whole name among their class, id or role, and (only on pages without a template) by a part of such a name.
DROPPED_TAGS = frozenset("head nav header footer aside form script style noscript template iframe button select option textarea svg canvas object menu dialog title".split())
DROPPED_NAMES = frozenset("ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent notice notices sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments replies share sharing newsletter subscribe popup modal pagination footer".split())
DROPPED_PARTS = DROPPED_NAMES | frozenset("adv advertising gdpr alert side aside reply respond discussion disqus social related recommended header masthead subscription widget pager toolbar login search".split())
#: Containers that can be a slot.
GROUPS = frozenset("html body main article section div td center details".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = BLOCKS | DROPPED_TAGS
#: Containers whose tag says nothing of what they hold.
UNTOLD = frozenset("div section td center".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe".split())
MAIN_TAGS = ("article", "main")
#: Tags that an opening tag of the same kind closes first.
CLOSES = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
NAMED = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
ENDS = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in RAW}


class Box:
    """An open container: its path, the depth of the outermost container that a tag or whole name drops (0: none), and whether a tag or a part of a name drops it."""

    def __init__(self, tag: str, path: str, strict: int, loose: bool, bare: bool):
        self.tag, self.path, self.strict, self.loose, self.bare = tag, path, strict, loose, bare


def parse(page: str) -> tuple[list[tuple[str, str, int, int, bool]], dict[str, int]]:
    """(blocks in page order, how often each container's path occurs).

    A block is (path of its container, text with white space collapsed, characters of it in links, and strict and loose of the container).
    A path has each container's tag with its class; one without a class has the tag of its first child instead, if it starts with one.
    Each text node is decoded on its own.
    """
    out: list[tuple[str, str, int, int, bool]] = []
    opened: dict[str, int] = {}
    stack: list[tuple[str, bool]] = []
    boxes: list[Box] = []
    held: list[tuple[str, bool]] = []

    def starts(child: str) -> None:
        if boxes and boxes[-1].bare:
            box = boxes[-1]
            box.bare, box.path = False, f"{box.path}>{child}" if child else box.path
            opened[box.path] = opened.get(box.path, 0) + 1

    def flush() -> None:
        if held:
            text = " ".join("".join(t for t, _ in held).split())
            linked = sum(len("".join(t.split())) for t, link in held if link)
            held.clear()
            if text:
                starts("")
                out.append((boxes[-1].path, text, linked, boxes[-1].strict, boxes[-1].loose) if boxes else ("", text, linked, 0, False))

    def pop(count: int) -> None:
        for _ in range(count):
            if stack[-1][0] in CONTAINERS:
                flush()
                starts("")
                boxes.pop()
            stack.pop()

    def say(text: str) -> None:
        held.append((html.unescape(text) if "&" in text else text, bool(stack) and stack[-1][1]))

    at = 0
    for m in iter(lambda: MARKUP.search(page, at), None):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if depth is not None:
                pop(len(stack) - depth)
            elif tag in BLOCKS:
                flush()
            continue
        if tag in VOID:
            say(" ")
            if tag == "hr":
                flush()
            continue
        # an open p ends at a block, an li at an li, and so on, though inline tags stand between
        for k in range(len(stack) - 1, -1, -1):
            if tag in CLOSES.get(stack[k][0], ()):
                pop(len(stack) - k)
                break
            if stack[k][0] in BLOCKS:
                break
        if tag in CONTAINERS:
            flush()
        if tag in RAW:
            end = ENDS[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        link = bool(stack) and stack[-1][1]
        if tag not in CONTAINERS:
            stack.append((tag, link or tag == "a"))
            continue
        starts(tag)
        up = boxes[-1] if boxes else Box("", "", 0, False, False)
        named = {n.lower(): a or b or c for n, a, b, c in NAMED.findall(m[3] or m[6] or "")}
        names = " ".join(named.values()).lower().split()
        own = named.get("class", "").split()
        path = f"{up.path}/{tag}" + (f".{own[0]}" if own else "")
        text_holder = tag in ("html", "body", "article", "main")
        strict = tag in DROPPED_TAGS or (not text_holder and not DROPPED_NAMES.isdisjoint(names))
        loose = strict or (not text_holder and any(not DROPPED_PARTS.isdisjoint(re.split(r"[^a-z0-9]+", n)) for n in names))
        bare = tag in UNTOLD and not own
        if not bare:
            opened[path] = opened.get(path, 0) + 1
        boxes.append(Box(tag, path, up.strict or (path.count("/") if strict else 0), up.loose or loose, bare))
        stack.append((tag, link))
    if at < len(page):
        say(page[at:])
    flush()
    pop(len(stack))
    return out, opened


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def _above(path: str) -> list[str]:
    """The path's own containers, from the whole page ("") on."""
    parts = path.split("/")
    return ["/".join(parts[:k]) for k in range(1, len(parts) + 1)]


def block_key(path: str, text: str) -> int:
    """Of a block token: its path and text; never 0, which marks a token that is a path only."""
    return (xxhash.xxh3_64_intdigest(f"{path}\n{text}".encode("utf-8", "surrogatepass")) >> 1) or 1


def _tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(host, path, block, n, mark, chars): a page's tokens, how often it has each, and the plain text in them."""
    for pdf in batches:
        rows = []
        for where, page_hash, page in zip(pdf["host"], pdf["h"].tolist(), pdf["html"]):
            found, opened = parse(page or "")
            chars: dict[str, int] = {}
            said: dict[int, list] = {}
            for path, text, linked, _, loose in found:
                plain = 0 if loose else max(0, len(text) - linked)
                mine = said.setdefault(block_key(path, text), [path, 0, 0])
                mine[1] += 1
                mine[2] += plain
                for p in _above(path):
                    chars[p] = chars.get(p, 0) + plain
            opened[""] = 1
            rows += [(where, p, 0, n, page_hash * n % (1 << 40), chars.get(p, 0)) for p, n in opened.items()]
            rows += [(where, p, k, n, page_hash * n % (1 << 40), c) for k, (p, n, c) in said.items()]
        yield pd.DataFrame(rows, columns=["host", "path", "block", "n", "mark", "chars"])


def classes(pages: DataFrame) -> DataFrame:
    """(host, path, block, pages, total, vector, chars): the tokens of valid classes, which have one vector each.

    A class is valid with two tokens or more, on MIN_SHARE of the host's pages and MIN_PAGES at least. A page has few of their tokens that others
    lack, so a host's are of the order of one page's, however many pages it has.
    """
    keyed = pages.select(host(F.col("url")).alias("host"), F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 40)).alias("h"), "html")
    tokens = keyed.mapInPandas(_tokens, "host string, path string, block long, n long, mark long, chars long")
    vectors = tokens.groupBy("host", "path", "block").agg(F.count("*").alias("pages"), F.sum("n").alias("total"), F.sum("mark").alias("vector"), F.sum("chars").alias("chars"))
    vectors = settle(vectors.where((F.col("block") == 0) | (F.col("pages") >= MIN_PAGES)))
    most = settle(vectors.where("path = '' AND block = 0").select("host", F.col("pages").alias("most")))
    members = settle(vectors.groupBy("host", "pages", "total", "vector").agg(F.count("*").alias("members")).where("members > 1"))
    valid = vectors.join(members, ["host", "pages", "total", "vector"]).join(most, "host")
    return settle(valid.where((F.col("pages") >= MIN_PAGES) & (F.col("pages") >= MIN_SHARE * F.col("most"))).drop("members", "most"))


def nested(valid: DataFrame) -> DataFrame:
    """classes() as the template: with the vector of the class around each token, that of the nearest container above it in the template (null: the page)."""
    holder = valid.where("block = 0").select("host", F.col("path").alias("up"), F.col("vector").alias("v"))
    tokens = valid.withColumn("place", F.struct("path", "block"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    ups = tokens.select("host", "place", "vector", F.explode(above).alias("up"), "path", "block").where("up <> path OR block <> 0")
    around = ups.join(holder, ["host", "up"]).where(F.col("v") != F.col("vector")).groupBy("host", "place").agg(F.max_by("v", F.length("up")).alias("parent"))
    return tokens.join(around, ["host", "place"], "left").drop("place")


def templates(pages: DataFrame) -> DataFrame:
    """(host, main, known): of each host with a template the path of its main slot, if any, and the keys of its own blocks.

    Null html is an empty page; pages without a url are those of host ""; repeated rows count as pages; an empty table gives no rows.
    """
    valid = classes(pages)
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    own = settle(valid.where("block <> 0").select("host", F.explode(above).alias("path"), "chars").groupBy("host", "path").agg(F.sum("chars").alias("own")))
    # what varies under each container: its plain text without the template's own blocks
    held = valid.where("block = 0").join(own, ["host", "path"], "left").withColumn("varying", F.col("chars") - F.coalesce("own", F.lit(0)))
    last = F.regexp_extract("path", "/([a-z0-9]+)[^/]*$", 1)
    whole = F.max(F.when(F.col("path") == "", F.col("varying")))
    heading = F.when(last.isin("h1", "h2") & (F.col("varying") > 0), F.regexp_replace("path", "/[^/]*$", ""))
    slot = F.when((F.col("path") == "") | (last.isin(*GROUPS) & (F.col("total") == F.col("pages"))), F.struct("path", "varying"))
    g = held.groupBy("host").agg(whole.alias("whole"), F.collect_set(heading).alias("heads"), F.collect_list(slot).alias("slots"))
    fits = lambda s: (s["varying"] >= SLOT_SHARE * F.col("whole")) & ~F.exists("heads", lambda q: s["path"].startswith(F.concat(q, F.lit("/"))))
    deepest = F.sort_array(F.transform(F.filter("slots", fits), lambda s: F.struct(F.length(s["path"]).alias("n"), s["path"].alias("path"))), asc=False)
    main = g.select("host", F.when(F.col("whole") > 0, F.get(deepest, 0)["path"]).alias("main"))
    known = valid.groupBy("host").agg(F.collect_set(F.when(F.col("block") != 0, F.col("block"))).alias("known"))
    return known.join(main, "host", "left")


def main_text(page: str, main: str | None, known: frozenset[int] = frozenset()) -> str:
    """Blocks in the main slot that aren't the template's own, without containers dropped inside it; by names where the page has no such slot.

    If the template's own blocks make up most of a slot, its page is a copy of others, and they stay.
    """
    every, _ = parse(page)
    inside = [b for b in every if not main or b[0] == main or b[0].startswith(main + "/")]
    size = lambda found: sum(len(b[1]) for b in found)
    rest = [b for b in inside if block_key(b[0], b[1]) not in known]
    if main is not None and 2 * size(rest) >= size(inside) > 0:
        top = main.count("/")
        return "\n".join(b[1] for b in rest if b[3] <= top) or "\n".join(b[1] for b in rest)
    if main and inside and any(b[3] <= main.count("/") for b in inside):
        return "\n".join(b[1] for b in inside if b[3] <= main.count("/"))
    held = [b for b in every if block_key(b[0], b[1]) not in known]
    held = held if 2 * size(held) >= size(every) else every
    for tag in MAIN_TAGS:
        own = [(b, next((k for k, x in enumerate(b[0].split("/")) if x == tag or x.startswith(tag + ".")), 0)) for b in held]
        mine = [b[1] for b, k in own if k and (b[3] == 0 or b[3] < k)]
        if mine:
            return "\n".join(mine)
    return "\n".join(b[1] for b in held if not b[4])


def extract(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> (page_id, url, text, n_chars), a row for each.

    Null html: empty text. Pages without a url share one host, "". Repeated rows are repeated in the result.
    """
    found = settle(templates(pages))

    @F.pandas_udf("string")
    def text(page: pd.Series, main: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([main_text(p or "", m, frozenset(() if k is None else k)) for p, m, k in zip(page, main, known)], dtype=object)

    rows = pages.withColumn("__host", host(F.col("url"))).join(found.select(F.col("host").alias("__host"), F.col("main").alias("__main"), F.col("known").alias("__known")), "__host", "left")
    return rows.select("page_id", "url", text("html", "__main", "__known").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
