"""The elements of pages as a tree: one row a page, whose elements know their parents and where their text lies.

Tags are folded in order with a stack of open elements, which no built-in function can do in linear time; the rest
(what a page's cards are, and what they say) is worked out on the arrays and rows by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements that have no content, and those that end where the next of their kind begins.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS_LIKE = frozenset("p li option tr td th dt dd".split())

_NODE = pa.struct(
    [(c, pa.int32()) for c in ("element", "parent", "last", "begin", "end")] + [(c, pa.string()) for c in ("tag", "class", "href", "src", "data")] + [("path", pa.list_(pa.int32())), ("own", pa.list_(pa.int32()))]
)
_KIND = "array<struct<element:int,parent:int,last:int,begin:int,end:int,tag:string,class:string,href:string,src:string,data:string,path:array<int>,own:array<int>>>"


class _Fold(HTMLParser):
    """Elements in document order, and all of the page's text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes, self.open, self.text, self.at = [], [], [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS_LIKE and self.open and self.nodes[self.open[-1]]["tag"] == tag:
            self._close(1)
        said = dict(reversed(attrs))
        node = {"element": len(self.nodes), "parent": self.open[-1] if self.open else -1, "tag": tag, "class": said.get("class") or "", "href": said.get("href"), "src": said.get("src") or said.get("data-src"), "data": said.get("data-cy") or said.get("data-testid")}
        self.nodes.append(node | {"path": self.open[::-1], "begin": self.at, "end": self.at, "last": len(self.nodes), "own": []})
        if tag not in VOID:
            self.open.append(node["element"])

    def handle_endtag(self, tag: str) -> None:
        for k, i in enumerate(reversed(self.open), 1):
            if self.nodes[i]["tag"] == tag:
                self._close(k)
                return

    def handle_data(self, data: str) -> None:
        if self.open:
            self.nodes[self.open[-1]]["own"] += [self.at, self.at + len(data)]
        self.text.append(data)
        self.at += len(data)

    def _close(self, many: int) -> None:
        for _ in range(many):
            node = self.nodes[self.open.pop()]
            node["end"], node["last"] = self.at, len(self.nodes) - 1

    def done(self, html: str) -> tuple[str, list[dict]]:
        self.feed(html)
        self.close()
        self._close(len(self.open))
        return "".join(self.text), self.nodes


def trees(pages: DataFrame, text: str = "html") -> DataFrame:
    """(page_id, html, text, nodes) of each page: its text, and its elements in document order.

    A node has its number (element), parent (-1 at the top), the last of its descendants, where its text begins and
    ends in text, tag, class, href, src (else data-src), data (data-cy, else data-testid), path (its ancestors, the nearest first), and own (begin and
    end by turns of the pieces of text that are its own). A tag that closes nothing is left out; what is never closed
    ends with what it is in; a null page has no nodes.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, html in enumerate(batch.column("html")):
                said, nodes = _Fold().done(html.as_py() or "")
                yield pa.record_batch([*batch.slice(k, 1).columns, pa.array([said]), pa.array([nodes], pa.list_(_NODE))], [*batch.schema.names, "text", "nodes"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col(text).alias("html")).mapInArrow(fold, f"page_id {kind}, html string, text string, nodes {_KIND}")


def said(node: Column, text: str = "text") -> Column:
    """All text in an element."""
    return F.substring(text, node["begin"] + 1, node["end"] - node["begin"])


def own_pieces(node: Column, text: str = "text") -> Column:
    """The pieces of text that are an element's own, in order."""
    own = node["own"]
    return F.transform(F.filter(own, lambda _, k: k % 2 == 0), lambda begin, k: F.substring(text, begin + 1, F.get(own, 2 * k + 1) - begin))


def inside(node: Column, nodes: str = "nodes") -> Column:
    """The elements in an element, in order."""
    return F.slice(nodes, node["element"] + 2, node["last"] - node["element"])


def has_class(node: Column, *words: str) -> Column:
    """Whether an element's class holds one of these texts."""
    found = F.lit(False)
    for w in words:
        found = found | F.contains(node["class"], F.lit(w))
    return found
