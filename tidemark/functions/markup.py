"""Text out of markup: what a reader sees, the tables of a page, and chunks of long texts with overlaps."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements whose content nobody sees, and elements that begin a new line.
HIDDEN = frozenset(("script", "style", "noscript", "template"))
BLOCKS = frozenset("p div br tr li ul ol table section article header footer h1 h2 h3 h4 h5 h6 title hr td th pre blockquote".split())


class _Seen(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in HIDDEN:
            self.hidden += 1
        if tag in BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        if tag in BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


def seen_text(html: str) -> str:
    """What a reader sees of a page: no scripts and styles, one line a block, single spaces."""
    reader = _Seen()
    reader.feed(html)
    reader.close()
    lines = (" ".join(line.split()) for line in "".join(reader.parts).split("\n"))
    return "\n".join(line for line in lines if line)


@F.pandas_udf(T.StringType())
def visible_text(html):  # noqa: ANN001, ANN201
    """:func:`seen_text` of a column; null for null."""
    return html.map(lambda x: None if x is None else seen_text(x))


class _Tables(HTMLParser):
    """Rows of tables; tables inside a cell are rows of their own after it begins."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[int, int, bool, list[str], str | None]] = []
        self.open: list[dict] = []
        self.tables = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.open.append({"table": self.tables, "n": 0, "row": None})
            self.tables += 1
        elif self.open and tag == "tr":
            self._close()
            self.open[-1]["row"] = {"cells": [], "header": True, "href": None}
        elif self.open and tag in ("td", "th") and self.open[-1]["row"] is not None:
            row, span = self.open[-1]["row"], dict(attrs).get("colspan") or "1"
            row["at"] = len(row["cells"])
            row["cells"] += [[], *[None] * (int(span) - 1 if span.isdigit() and 0 < int(span) < 1000 else 0)]
            row["header"] = row["header"] and tag == "th"
        elif tag == "a" and self.open and self.open[-1]["row"] is not None and self.open[-1]["row"]["href"] is None:
            self.open[-1]["row"]["href"] = dict(attrs).get("href")
        elif tag == "br":
            self.handle_data(" ")

    def _close(self) -> None:
        table = self.open[-1]
        if table["row"] is not None and table["row"]["cells"]:
            row = table["row"]
            cells = [" ".join("".join(c).split()) if c is not None else "" for c in row["cells"]]
            self.rows.append((table["table"], table["n"], row["header"], cells, row["href"]))
            table["n"] += 1
        table["row"] = None

    def handle_endtag(self, tag: str) -> None:
        if self.open and tag in ("tr", "table"):
            self._close()
            if tag == "table":
                self.open.pop()

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1]["row"] is not None and self.open[-1]["row"]["cells"]:
            self.open[-1]["row"]["cells"][self.open[-1]["row"]["at"]].append(data)

    def close(self) -> None:
        super().close()
        while self.open:
            self._close()
            self.open.pop()


def rows_of(html: str) -> list[tuple[int, int, bool, list[str], str | None]]:
    """Table, row, whether all cells are headers, cells, first link; a cell over several columns is followed by empty ones."""
    reader = _Tables()
    reader.feed(html)
    reader.close()
    return sorted(reader.rows, key=lambda r: r[:2])


def table_rows(pages: DataFrame, page_id: str, html: str) -> DataFrame:
    """``page_id, table_index, row_index, header, cells, href`` of every table row of every page; pages without any, or null, give none."""
    kind = dict(pages.dtypes)[page_id]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, r) for i, text in enumerate(batch.column(1).to_pylist()) if text for r in rows_of(text)]
            cols = [batch.column(0).take(pa.array([i for i, _ in found], pa.int64()))]
            for at, t in enumerate((pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.string()), pa.string())):
                cols.append(pa.array([r[at] for _, r in found], t))
            yield pa.RecordBatch.from_arrays(cols, names=[page_id, "table_index", "row_index", "header", "cells", "href"])

    return pages.select(page_id, html).mapInArrow(run, f"`{page_id}` {kind}, table_index int, row_index int, header boolean, cells array<string>, href string")


def typed_rows(rows: DataFrame, page_id: str, names: dict[str, Iterable[str]]) -> DataFrame:
    """Rows with named cells: the columns are found by their headers, or by place where a table has none.

    ``names`` maps a column to words of which its header holds one.  A table whose
    first row holds such words in two or more cells has an explicit schema, a table
    without one inherits that of the table before on its page where the widths
    agree, else the columns come in the order of ``names`` (implicit).
    """
    wanted = list(names)

    def place(cells: Column, words: Iterable[str]) -> Column:
        pattern = "|".join(r"\b" + re.escape(w) for w in words)
        hit = F.transform(cells, lambda c, i: F.when(F.lower(c).rlike(pattern), i))
        return F.array_min(F.filter(hit, lambda x: x.isNotNull()))

    places = F.array(*[F.coalesce(place(F.col("cells"), names[n]), F.lit(-1)) for n in wanted])
    first = rows.where("row_index = 0").select(page_id, "table_index", F.size("cells").alias("width"), places.alias("p"))
    explicit = F.size(F.filter("p", lambda x: x >= 0)) >= 2
    before = Window.partitionBy(page_id).orderBy("table_index").rowsBetween(Window.unboundedPreceding, -1)
    schema = first.withColumn("own", F.when(explicit, F.struct("p", "width"))).withColumn("last", F.last("own", ignorenulls=True).over(before))
    inherits = F.col("own").isNull() & (F.col("last.width") == F.col("width"))
    schema = schema.select(
        page_id, "table_index", F.when(F.col("own").isNotNull(), "explicit").when(inherits, "inherited").otherwise("implicit").alias("schema_kind"),
        F.when(F.col("own").isNotNull(), F.col("p")).when(inherits, F.col("last.p")).otherwise(F.array(*[F.lit(i) for i in range(len(wanted))])).alias("p"),
    )
    joined = rows.join(schema, [page_id, "table_index"]).where("not (schema_kind = 'explicit' and row_index = 0)")
    cell = lambda i: F.when(F.get("p", F.lit(i)) >= 0, F.nullif(F.get("cells", F.get("p", F.lit(i))), F.lit("")))
    return joined.select(page_id, "table_index", "row_index", "schema_kind", *[cell(i).alias(n) for i, n in enumerate(wanted)])


def chunks_of(text: str, size: int, overlap: int, least_share: float = 0.55) -> list[tuple[int, str]]:
    """Start and text of pieces of at most ``size`` characters that overlap by about ``overlap``.

    A piece ends at the last paragraph, sentence or word that ends in it beyond
    ``least_share`` of its size, in this order, else at its full size.
    """
    if not 0 <= overlap < size * least_share:
        raise ValueError("the overlap must be smaller than the least piece")
    out, start = [], 0
    while start < len(text):
        end = min(len(text), start + size)
        if end < len(text):
            least = start + int(size * least_share)
            for mark in ("\n\n", "\n", ". ", " "):
                at = text.rfind(mark, least, end)
                if at >= 0:
                    end = at + len(mark)
                    break
        out.append((start, text[start:end]))
        if end >= len(text):
            break
        start = end - overlap
    return out


def chunked(docs: DataFrame, doc_id: str, text: str, size: int, overlap: int) -> DataFrame:
    """``doc_id, chunk, start, piece`` of every text; whole texts, null and empty ones give no piece."""
    kind = dict(docs.dtypes)[doc_id]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, n, s, piece) for i, t in enumerate(batch.column(1).to_pylist()) if t for n, (s, piece) in enumerate(chunks_of(t, size, overlap))]
            cols = [batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))]
            cols += [pa.array([f[at] for f in found], k) for at, k in ((1, pa.int32()), (2, pa.int64()), (3, pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=[doc_id, "chunk", "start", "piece"])

    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, chunk int, start long, piece string")


def reassembled(pieces: DataFrame, doc_id: str) -> DataFrame:
    """``doc_id, text, consistent``: pieces put together again by their starts; ``consistent`` says that overlaps agree and nothing is missing.

    A document's pieces are one text, so they fit wherever the text did.
    """
    ordered = F.array_sort(F.collect_list(F.struct("start", "piece")))
    per = pieces.groupBy(doc_id).agg(ordered.alias("_p"))
    none = F.struct(F.lit("").alias("text"), F.lit(True).alias("ok"))
    add = lambda acc, p: F.struct(
        F.concat(F.substring(acc["text"], F.lit(1), p["start"].cast("int")), p["piece"]).alias("text"),
        (acc["ok"] & (F.length(acc["text"]) >= p["start"]) & F.startswith(p["piece"], F.substring(acc["text"], p["start"].cast("int") + 1, F.length(p["piece"])))).alias("ok"),
    )
    made = F.aggregate("_p", none, add)
    return per.select(doc_id, made["text"].alias("text"), made["ok"].alias("consistent"))
