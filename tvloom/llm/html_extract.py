"""Main text of web pages by template deduction over each host's pages.

A page is read into blocks: runs of text between block-level tags, each under
the path of its open elements. A page's tokens are its element paths. Over the
different pages of a host, paths with the same occurrence vector (as often as each
other on every page) form an equivalence class. A class is valid if it has several
paths, occurs on most pages, and the parents of its paths do too, so that classes
nest into one template: its once-a-page paths are the skeleton, and what stands under
each is its slot.

The article's slot is told by what varies in it. A path's weight is the text under it that
isn't link text, by the share of the host's pages on which that text is another one, so menus and
notices weigh little. From the root, the way leads to the skeleton path that holds MAIN of the
weight of its siblings, down to an article or main element, or to where none does.

The main text of a page are the blocks in that slot, and the page's heading if that stands before it,
without constant text (an element that stands once on a page and reads the same on most), and without
elements inside the slot that by tag, role, class or id hold menus, headers, footers, sidebars,
notices, adverts, forms or reader comments. A class or id counts by whole names, all of whose words
must say so. Neither that nor being a form drops an article or main element, or one that holds main or the
page's first article. A page without the slot is read by its article, else its main element, else its body.
Character references are decoded, white space inside a block becomes one space,
and blocks are joined in page order by an empty line.

An occurrence vector is summed up as the exclusive or of a hash for each (page, count), so the pages of
a host never meet in one task and a host may hold any share of the rows; equal pages count once.

Null html, and a page without such blocks, give an empty text. Pages are keyed by
nothing but their host, so null, repeated and clashing ids are passed through.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bounded_batches, table, written

#: A template class is on this share of a host's different pages, and has this many paths.
SHARE = 0.6
LEAST_TOKENS = 2
#: A text is constant if it is on that share and on this many pages: fewer may agree by chance.
REPEATS = 4
#: Share of the weight beside it that leads to a path.
MAIN = 0.8

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q ruby rp rt s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noembed noframes xmp textarea title svg math object canvas".split())
DROPPED = RAW | frozenset("head nav footer aside select button dialog menu audio video map".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar widget widgets footer masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations comment comments disqus respond replies pagination pager toolbar".split()
)
#: Words that may stand beside them in a name.
BESIDE_WORDS = frozenset("area bar block box container left list right section top bottom wrapper".split())
#: Elements that close an open one of the same kind.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: and how far that looks up.
SCOPES = frozenset("ul ol dl table body html article main section div td th blockquote nav aside footer header form".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*)>")
_ATTRIBUTE = re.compile(r"""(?i)(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORD = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")


class Block:
    """A run of text, its path, how much of it is in links, what may drop it, and where it stands."""

    __slots__ = ("path", "text", "linked", "cells", "article", "main")

    def __init__(self, path: str, text: str, linked: int, cells: tuple, article: bool, main: bool):
        self.path, self.text, self.linked, self.cells, self.article, self.main = path, text, linked, cells, article, main

    def dropped(self, slot: str = "") -> bool:
        """Whether an element inside the slot drops it."""
        return any(cell[0] and len(cell[2]) > len(slot) for cell in self.cells)


def _named(value: str) -> bool:
    """Whether a name of a class or id says that its element isn't main text."""
    for name in value.split():
        words = _WORD.findall(name)
        told = [w for w in words if w not in BESIDE_WORDS and not w[0].isdigit()]
        if told and all(w in DROPPED_WORDS for w in told):
            return True
    return False


def _drops(tag: str, attributes: str, inside: bool) -> tuple[bool, bool, str]:
    """Whether an element isn't main text, whether that holds only if it doesn't hold main text, and its label in paths. inside: in an article or main element."""
    if tag in DROPPED or tag == "header" and not inside:
        return True, False, tag
    label, by_role, by_name = tag, False, tag == "form" and inside
    if attributes and "=" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "class":
                label = f"{tag}.{value}"
            if tag in ("html", "body", "main", "article"):
                continue
            if name == "role":
                by_role |= bool(set(_WORD.findall(value)) & DROPPED_ROLES)
            else:
                by_name |= _named(value)
    return by_role or by_name, not by_role, label


def blocks(page: str) -> tuple[list[Block], dict[str, int]]:
    """The blocks of a page, and how often each element path occurs."""
    out: list[Block] = []
    paths: dict[str, int] = defaultdict(int)
    # open elements: tag, path, what drops them, in an article, in main
    stack: list[tuple[str, str, tuple, bool, bool]] = [("", "", (), False, False)]
    # a dropping element: whether it does, and whether it stops to if it holds main text
    first_article = True
    held: list[str] = []
    linked, in_link = 0, False
    tag_at, at, size = _TAG, 0, len(page)
    last = page.rfind(">")  # no tag begins beyond it
    low = page.lower()
    if len(low) != size:  # a few letters change length; tags have none of them
        low = "".join(c.lower() if c.isascii() else c for c in page)

    def end_block() -> None:
        nonlocal linked
        if held:
            text = _SPACE.sub(" ", entities.unescape("".join(held))).strip()
            if text:
                _, path, dropped, article, main = stack[-1]
                out.append(Block(path, text, min(linked, len(text)), dropped, article, main))
            held.clear()
        linked = 0

    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            begin = size
        if begin > last:  # nor here
            begin = size
        if begin > at:
            held.append(page[at:begin])
            linked += (begin - at) * in_link
        if begin == size:
            break
        at = begin
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith("<![CDATA[", at):
            end = page.find("]]>", at)
            held.append(entities.escape(page[at + 9 : size if end < 0 else end]))
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            at = size if end < 0 else end + 1
            continue
        m = tag_at.match(page, at)
        if m is None and tag_at is _TAG and (m := _PLAIN_TAG.match(page, at)):
            tag_at = _PLAIN_TAG  # a quote stays open: from here on a tag ends at the next ">"
        if m is None:
            held.append("<")
            at += 1
            continue
        at = m.end()
        closing, tag, attributes = m[1], m[2].lower(), m[3]
        if tag in INLINE:
            if tag == "a":
                in_link = not closing
            if tag == "br":
                held.append(" ")
            # one that isn't main text is an element of its own, and so is what it holds
            if closing:
                if stack[-1][0] != tag:
                    continue
            elif tag in VOID or stack[-1][0] not in INLINE and not ("=" in attributes and _drops(tag, attributes, True)[0]):
                continue
        end_block()
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        for other in CLOSES.get(tag, ()):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == other:
                    del stack[k:]
                    break
                if stack[k][0] in SCOPES and stack[k][0] not in CLOSES[tag]:
                    break
        if stack[-1][0] == "p" and tag not in INLINE:
            stack.pop()
        _, path, dropped, article, main = stack[-1]
        drops, soft, label = _drops(tag, attributes, article or main)
        path = f"{path}/{label}"
        paths[path] += 1
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag in RAW:
            end = low.find(f"</{tag}", at)
            at = size if end < 0 else end
            if end >= 0:
                stop = page.find(">", end)
                at = size if stop < 0 else stop + 1
            continue
        is_main = tag == "main" or "main" in _WORD.findall(attributes.lower()) and "role" in attributes.lower()
        if is_main or tag == "article" and first_article:
            for cell in dropped:
                cell[0] &= not cell[1]
            if tag == "article":
                first_article = any(cell[0] for cell in dropped)
        if drops:
            dropped = (*dropped, [True, soft, path])
        is_article = tag == "article" and not any(cell[0] for cell in dropped)
        stack.append((tag, path, dropped, article or is_article, main or is_main))
    end_block()
    return out, paths


def token(path: str) -> int:
    return xxhash.xxh3_64_intdigest(path) - (1 << 63)


def _holders(path: str) -> list[str]:
    """The paths of the elements that a path stands in, itself first, without the root."""
    out = []
    while path:
        out.append(path)
        path = path[: path.rindex("/")]
    return out


def texts(found: list[Block]) -> dict[str, int]:
    """For each element path that holds blocks, the hash of all their texts."""
    held: dict[str, list[int]] = defaultdict(list)
    for block in found:
        own = token(block.text)
        for path in _holders(block.path):
            held[path].append(own)
    return {path: token(np.array(own, np.int64).tobytes()) for path, own in held.items()}


def main_text(page: str, slot: int, constant: frozenset[tuple[int, int]] | set = frozenset()) -> str:
    """The page's main text. slot: token of the path of the article's slot (that of "": the page); constant: path and text tokens."""
    found, paths = blocks(page)
    if constant:
        same = {path for path, own in texts(found).items() if paths[path] == 1 and (token(path), own) in constant}
        found = [b for b in found if same.isdisjoint(_holders(b.path))]
    at = "" if slot == token("") else next((path for path in paths if token(path) == slot), None)
    if at is not None:
        inside = [b for b in found if (b.path == at or b.path.startswith(at + "/")) and not b.dropped(at)]
        if inside and not any(_heading(b.path) for b in inside):
            before = found[: found.index(inside[0])]
            inside = [b for b in before if _heading(b.path) and not b.dropped()] + inside
        if inside and at:
            return "\n\n".join(b.text for b in inside)
    found = [b for b in found if not b.dropped()]
    for region in ("article", "main"):
        if any(getattr(b, region) for b in found):
            found = [b for b in found if getattr(b, region)]
            break
    return "\n\n".join(b.text for b in found)


def _heading(path: str) -> bool:
    return path.rpartition("/")[2].partition(".")[0] == "h1"


def host(url: Column) -> Column:
    """The host that a URL names, in lower case; else empty."""
    authority = F.regexp_extract(F.trim(F.coalesce(url, F.lit(""))), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.substring_index(authority, "@", -1), r":[0-9]*$", ""))


def tokens(pages: DataFrame, url: str, html: str) -> DataFrame:
    """host, page (hash of the html), and for each element path of the page: token, parent (its token), n (elements), text (hash), chars (that may be main text) and whole (whether it is an article or main element)."""
    schema = "host string, page long, token long, parent long, n long, text long, chars long, whole boolean"
    names = ("host", "page", "token", "parent", "n", "text", "chars", "whole")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {c: [] for c in names}
            for u, h in zip(batch.column(0), batch.column(1)):
                page = h.as_py() or ""
                found, paths = blocks(page)
                read, chars = texts(found), defaultdict(int)
                for block in found:
                    if not block.dropped():
                        for path in _holders(block.path):
                            chars[path] += len(block.text) - block.linked
                own = token(page)
                for path, n in paths.items():
                    above, _, label = path.rpartition("/")
                    row = (u.as_py(), own, token(path), token(above), n, read.get(path, 0), chars[path], label.partition(".")[0] in ("article", "main"))
                    for c, v in zip(names, row):
                        rows[c].append(v)
            kinds = {"host": pa.string(), "whole": pa.bool_()}
            yield pa.RecordBatch.from_arrays([pa.array(rows[c], kinds.get(c, pa.int64())) for c in names], names=list(names))

    return pages.select(host(pages[url]).alias("host"), pages[html].alias("html")).mapInArrow(run, schema)


def skeletons(pages: DataFrame, *, url: str = "url", html: str = "html") -> tuple[DataFrame, DataFrame]:
    """host, token, parent, weight and whole of the once-a-page paths of valid classes, with `beside`, the weight of all paths of that parent; and host, token and text of constant texts."""
    found = written(tokens(pages, url, html).groupBy("host", "page", "token", "parent", "whole").agg(F.max("n").alias("n"), F.max("text").alias("text"), F.max("chars").alias("chars")), "tokens")
    sizes = found.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    by_text = found.groupBy("host", "token", "parent", "whole", "text").agg(
        F.count(F.lit(1)).alias("pages"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("once"), F.bit_xor(F.xxhash64("page", "n")).alias("vector"), F.sum("chars").alias("chars")
    )
    by_text = written(by_text.join(sizes, "host"), "texts")
    often = F.col("pages") >= SHARE * F.col("host_pages")
    constant = by_text.where(often & (F.col("once") == F.col("pages")) & (F.col("pages") >= REPEATS) & (F.col("text") != 0)).select("host", "token", "text")
    paths = by_text.groupBy("host", "token", "parent", "whole").agg(
        F.sum("pages").alias("pages"), F.sum("once").alias("once"), F.bit_xor("vector").alias("vector"), F.sum("chars").alias("chars"), F.count(F.lit(1)).alias("texts"), F.first("host_pages").alias("host_pages")
    )
    paths = written(paths.withColumn("weight", F.col("chars") * F.col("texts") / F.col("pages")), "paths")
    # a class nests if the elements that its paths stand in are on most pages too; the root stands in nothing
    common = paths.where(often)
    parents = common.select("host", F.col("token").alias("parent"))
    root = F.col("parent") == token("")
    nested = common.where(root).unionByName(common.where(~root).join(parents, ["host", "parent"], "left_semi").select(common.columns))
    classes = nested.groupBy("host", "vector").agg(F.count(F.lit(1)).alias("paths")).where(F.col("paths") >= LEAST_TOKENS).select("host", "vector")
    beside = paths.groupBy("host", "parent").agg(F.sum("weight").alias("beside"))
    once = nested.join(classes, ["host", "vector"], "left_semi").where(F.col("once") >= SHARE * F.col("host_pages"))
    return once.join(beside, ["host", "parent"]).select("host", "token", "parent", "weight", "whole", "beside"), constant


def slot_of(paths: list) -> int:
    """The token of the article's slot among a host's skeleton paths: rows of token, parent, weight, whole and beside."""
    below: dict[int, list] = defaultdict(list)
    for path in paths:
        below[path["parent"]].append(path)
    at, whole = token(""), False
    while not whole and at in below:
        best = max(below.pop(at), key=lambda p: (p["weight"], p["token"]))
        if not best["weight"] or best["weight"] < MAIN * best["beside"]:
            break
        at, whole = best["token"], best["whole"]
    return at


def templates(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """host, slot (token of the article's slot) and constant (path and text tokens)."""
    skeleton, constant = skeletons(pages, url=url, html=html)
    by_host = skeleton.groupBy("host").agg(F.collect_list(F.struct("token", "parent", "weight", "whole", "beside")).alias("paths"))  # as many as a page has elements

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([slot_of(p) for p in batch.column(1).to_pylist()], pa.int64())], names=["host", "slot"])

    slots = by_host.mapInArrow(run, "host string, slot long")
    return slots.join(constant.groupBy("host").agg(F.collect_set(F.struct("token", "text")).alias("constant")), "host", "left")


def extract(pages: DataFrame, *, url: str = "url", html: str = "html", keep: list[str]) -> DataFrame:
    """The columns `keep` of pages and text, the main text of each."""
    if "text" in keep:
        raise ValueError("column in keep and in the result: text")
    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField("text", T.StringType())])
    bounded_batches(pages.sparkSession)
    known = written(templates(pages, url=url, html=html), "templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for h, slot, constant in zip(*batch.columns[1:]):
                same = frozenset((c["token"], c["text"]) for c in constant.as_py() or ())
                at = slot.as_py()
                found.append(main_text(h.as_py() or "", token("") if at is None else at, same))
            kept = [batch.column(0).field(i + 1) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.string())], names=schema.names)

    kept = F.struct(F.lit(0).alias("none"), *[pages[c].alias(f"k_{c}") for c in keep]).alias("kept")
    named = pages.select(kept, pages[html].alias("html"), host(pages[url]).alias("host"))
    # what is kept stays in its struct, where its names clash with none
    return named.join(known, "host", "left").select("kept", "html", "slot", "constant").mapInArrow(run, schema)


def pages_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: all pages; one row per page."""
    return extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"]).withColumn("n_chars", F.length("text").cast("long"))
