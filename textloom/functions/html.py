"""HTML zones: the text of a page and of its title, links and emphasised parts."""

from __future__ import annotations

from collections.abc import Callable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

ZONES = ("title", "a", "strong", "em")
#: What a tag adds to the text.
BREAKS = {"p": "\n\n", "br": "\n"}


class Zones(HTMLParser):
    """Gathers data by open tags. Script and style data is text like any other; entities and comments are dropped."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.open = dict.fromkeys(ZONES, 0)
        self.found: dict[str, list[str]] = {z: [] for z in (*ZONES, "text")}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.open:
            self.open[tag] += 1
        if tag in BREAKS:
            self.found["text"].append(BREAKS[tag])

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.found["text"].append("\n\n")

    def handle_endtag(self, tag: str) -> None:
        if self.open.get(tag):
            self.open[tag] -= 1

    def handle_data(self, data: str) -> None:
        inside = [z for z in ZONES if self.open[z]]
        for z in inside or ["text"]:
            self.found[z].append(data)


def zones_of(html: str | None) -> dict[str, str] | None:
    if html is None:
        return None
    p = Zones()
    p.feed(html)
    p.close()
    return {z: " ".join(" ".join(parts).split()) if z != "text" else "".join(parts).strip() for z, parts in p.found.items()}


#: Pages of which the text is held as Python strings at once: a batch has up to 10,000.
PAGES = 100


def by_page(html: pa.Array, f: Callable[[str | None], dict | str | None], kind: pa.DataType) -> pa.Array:
    """f of each page. Only the batch's own bytes and those of the result are held for all of its pages."""
    return pa.concat_arrays([pa.array([f(h) for h in html.slice(k, PAGES).to_pylist()], kind) for k in range(0, len(html), PAGES)] or [pa.array([], kind)])


def text_of(html: str | None) -> str | None:
    z = zones_of(html)
    return None if z is None else "\n".join(x for x in (z["title"], z["text"], z["a"], z["strong"], z["em"]) if x)


@F.arrow_udf(T.StructType([T.StructField(z, T.StringType()) for z in (*ZONES, "text")]))
def zones(html: pa.Array) -> pa.Array:
    """struct of the zones' text; all null for a null page."""
    empty = dict.fromkeys((*ZONES, "text"))
    return by_page(html, lambda h: zones_of(h) or empty, pa.struct([(z, pa.string()) for z in (*ZONES, "text")]))


@F.arrow_udf(T.StringType())
def page_text(html: pa.Array) -> pa.Array:
    """All text of a page, links included, images and comments not."""
    return by_page(html, text_of, pa.string())


def tag_text(html, tag: str):
    """array<string> of the data inside each <tag ...>...</tag>, by pattern, for pages whose tags aren't nested in themselves."""
    return F.regexp_extract_all(html, F.lit(f"(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))
