"""Authors and images from the HTML of article pages.

Python only walks the markup and lists candidates in document order; which candidate
wins is decided by Spark expressions.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from swaymeter import fixed_values as V
from swaymeter.functions.base import bind, missing, strip
from swaymeter.functions.text import absolute_url, is_image_url, is_meaningful_image

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SCAN_SCHEMA = ("{keys}, url string, metas array<struct<name:string,content:string>>, "
               "linked_data array<struct<author:string,image:string>>, bylines array<struct<rule:int,text:string>>, "
               "images array<struct<rule:int,url:string>>, logos array<struct<rule:int,url:string>>, head string, "
               "error string")
CONTENT = [("tag", "article"), ("tag", "main"), ("role", "main"), ("class", "article-body"),
           ("class", "post-content"), ("class", "entry-content"), ("id", "content"), ("class", "content")]
ALL_IMAGES = len(CONTENT)
#: Characters of text at the start of a page that "By Name" is looked for in (the matching rule); None: the whole text.
HEAD_CHARS = 500


class _Scan(HTMLParser):
    """Collects metas, linked data, bylines, images and logos of one page."""

    def __init__(self, head_chars: int | None = HEAD_CHARS):
        super().__init__(convert_charrefs=True)
        self.head_chars = head_chars
        self.open: list[tuple[str, dict]] = []
        self.metas, self.linked_data, self.images, self.logos, self.head = [], [], [], [], ""
        self.byline: dict[int, list] = {}     # rule -> [depth, text]
        self.content: dict[int, int] = {}     # rule -> depth of the first matching element
        self.closed: set[int] = set()
        self.script = None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        classes = a.get("class", "").split()
        depth = len(self.open)
        if tag == "meta" and a.get("content"):
            self.metas += [{"name": a[k], "content": a["content"]} for k in ("name", "property") if a.get(k)]
        for rule, hit in enumerate([c in classes for c in V.AUTHOR_CLASSES[:2]] + [a.get("rel") == "author"]
                                   + [c in classes for c in V.AUTHOR_CLASSES[2:]]
                                   + [a.get("itemprop") == "name" and any(t == "address" and "itemscope" in x
                                                                          for t, x in self.open)]):
            if hit and rule not in self.byline and tag not in VOID:
                self.byline[rule] = [depth, "", True]
        for rule, (kind, want) in enumerate(CONTENT):
            here = tag == want if kind == "tag" else want in classes if kind == "class" else a.get(kind) == want
            if here and rule not in self.content and tag not in VOID:
                self.content[rule] = depth
        if tag == "img" and a.get("src", "").strip():
            src = a["src"].strip()
            inside = [r for r in self.content if r not in self.closed]
            self.images += [{"rule": r, "url": src} for r in [*inside, ALL_IMAGES]]
        self._logo(tag, a, classes)
        if tag == "script":
            self.script = [] if a.get("type") == "application/ld+json" else None
        if tag not in VOID:
            self.open.append((tag, a))

    def _logo(self, tag, a, classes):
        if tag == "link" and a.get("href"):
            for rule, rel in enumerate(["apple-touch-icon", "icon", "shortcut icon"]):
                if a.get("rel", "").strip() == rel:
                    self.logos.append({"rule": rule, "url": a["href"]})
        if tag == "img" and a.get("src"):
            above = [(t, x.get("class", ""), x.get("id", "")) for t, x in self.open]
            hits = ["logo" in a["src"], "logo" in a.get("alt", "").lower(), "logo" in a.get("title", "").lower(),
                    any("logo" in c.split() for _, c, _ in above), any(i == "logo" for _, _, i in above),
                    any("logo" in c for _, c, _ in above), any("logo" in i for _, _, i in above),
                    any(t == "header" for t, _, _ in above), any("site-logo" in c.split() for _, c, _ in above)]
            self.logos += [{"rule": 3 + r, "url": a["src"]} for r, hit in enumerate(hits) if hit]

    def handle_endtag(self, tag):
        if tag == "script" and self.script is not None:
            self.linked_data += _linked_data("".join(self.script))
        if tag == "script":
            self.script = None
        names = [t for t, _ in self.open]
        if tag in names:
            depth = len(names) - 1 - names[::-1].index(tag)
            del self.open[depth:]
            for b in self.byline.values():
                b[2] = b[2] and b[0] < depth
            self.closed |= {r for r, d in self.content.items() if d >= depth}

    def handle_data(self, data):
        if self.script is not None:
            self.script.append(data)
        elif not self.open or self.open[-1][0] not in ("script", "style"):
            for b in self.byline.values():
                if b[2]:
                    b[1] += data
            if self.head_chars is None or len(self.head) < self.head_chars:
                self.head += data


def _linked_data(text: str) -> list[dict]:
    """Author and image of a linked-data script; a broken script counts as none."""
    try:
        data = json.loads(text)
    except ValueError:
        return []
    items = [x for x in data if isinstance(x, dict)] if isinstance(data, list) else [data]
    out = []
    for n, item in enumerate(x for x in items if isinstance(x, dict)):
        author, image = item.get("author"), item.get("image")
        if isinstance(author, list):
            author = author[0] if author and isinstance(author[0], dict) else None
        name = author.get("name") if isinstance(author, dict) and n == 0 else None
        image = image.get("url") if isinstance(image, dict) else image
        out.append({"author": name if isinstance(name, str) else None,
                    "image": image if isinstance(image, str) else None})
    return out


def _scan(html: str | None, head_chars: int | None = HEAD_CHARS) -> dict:
    """Candidates of one page; a page that the parser gives up on keeps what was found before, and says why."""
    page, error = _Scan(head_chars), None
    try:
        page.feed(html or "")
        page.close()
    except (AssertionError, ValueError, RecursionError) as e:
        error = f"{type(e).__name__}: {e}"
    return {"error": error, "metas": page.metas, "linked_data": page.linked_data,
            "bylines": [{"rule": r, "text": b[1]} for r, b in sorted(page.byline.items())],
            "images": page.images, "logos": page.logos, "head": page.head[:head_chars]}


#: Pages whose candidates are handed on together.
PAGES_AT_ONCE = 200


def scan_pages(pages: DataFrame, key: str = "page_id", head_chars: int | None = HEAD_CHARS) -> DataFrame:
    """Candidates of every page; the HTML itself is not passed on.

    A task decodes one page at a time and keeps the candidates of PAGES_AT_ONCE of them.
    """
    schema = SCAN_SCHEMA.format(keys=f"{key} {pages.schema[key].dataType.simpleString()}")
    columns = ["metas", "linked_data", "bylines", "images", "logos", "head", "error"]
    types = to_arrow_schema(pages.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES_AT_ONCE):
                some = batch.slice(at, PAGES_AT_ONCE)
                found = [_scan(h.as_py(), head_chars) for h in some.column("html")]
                scanned = [pa.array([f[c] for f in found], types.field(c).type) for c in columns]
                same = [some.column(c).cast(types.field(c).type) for c in (key, "url")]
                yield pa.RecordBatch.from_arrays([*same, *scanned], schema=types)

    return pages.select(key, "url", "html").mapInArrow(run, schema)


def _first(items: Column, keep) -> Column:
    return F.try_element_at(F.filter(items, keep), F.lit(1))


def author_of(stop_words: Iterable[str] = V.AUTHOR_STOP_WORDS) -> Column:
    """Author of a scanned page: metas, linked data, bylines, then "By Name" in the first text."""
    stop = list(stop_words)

    def usable(name: Column) -> Column:
        return ~missing(name) & ~F.lower(name).isin(stop)

    metas = F.transform(F.filter("metas", lambda m: m["name"].isin("author", "article:author")),
                        lambda m: strip(m["content"]))
    linked = F.transform("linked_data", lambda x: strip(x["author"]))
    # byline rules are in order and hold one element each
    lines = F.transform("bylines", lambda b: F.regexp_replace(strip(b["text"]), r"(?i)^By\s+", ""))
    named = strip(F.regexp_extract("head", V.BY_NAME, 1))
    return F.coalesce(_first(metas, usable), _first(linked, usable),
                      _first(lines, lambda n: usable(n) & (F.length(n) > 2)),
                      F.when(F.length(named) > 2, named))


def image_of(base: str = "url") -> Column:
    """Lead image of a scanned page: sharing metas, article images, page images, linked data."""
    def full(url: Column) -> Column:
        return absolute_url(strip(url), F.col(base))

    def metas(name: str) -> Column:
        return F.transform(F.filter("metas", lambda m: m["name"] == name), lambda m: full(m["content"]))

    def images(rule: int) -> Column:
        good = F.filter("images", lambda i: (i["rule"] == rule) & is_meaningful_image(i["url"]))
        return F.transform(good, lambda i: full(i["url"]))

    linked = F.transform(F.filter("linked_data", lambda x: ~missing(x["image"])), lambda x: full(x["image"]))
    first_only = [F.slice(metas(n), 1, 1) for n in ("og:image", "twitter:image")]
    groups = [*first_only, *[images(r) for r in range(len(CONTENT))], images(ALL_IMAGES), linked]
    return F.coalesce(*[_first(g, is_image_url) for g in groups])


def logo_of(base: str = "url") -> Column:
    """Logo of a scanned home page: the first rule whose first hit is an image url, else the icon."""
    def first_of(rule: int) -> Column:
        hit = _first(F.col("logos"), lambda x: x["rule"] == rule)
        return absolute_url(hit["url"], F.col(base))

    valid = [bind(first_of(r), lambda u: F.when(is_image_url(u), u)) for r in range(12)]
    return F.coalesce(*valid, first_of(1), first_of(2))


def page_authors(pages: DataFrame, stop_words: Iterable[str] = V.AUTHOR_STOP_WORDS) -> DataFrame:
    return scan_pages(pages).select("page_id", "url", author_of(stop_words).alias("author"))


def page_images(pages: DataFrame, logos: DataFrame | None = None) -> DataFrame:
    """(page_id, url, image); `logos` (page_id, logo) fill in for pages without an image."""
    found = scan_pages(pages).select("page_id", "url", image_of().alias("image"))
    if logos is None:
        return found
    return (found.join(logos.select("page_id", "logo"), "page_id", "left")
            .select("page_id", "url", F.coalesce("image", "logo").alias("image")))


def page_logos(home_pages: DataFrame) -> DataFrame:
    return scan_pages(home_pages).select("page_id", "url", logo_of().alias("logo"))
