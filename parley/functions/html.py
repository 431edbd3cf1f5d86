"""Text of fetched HTML pages, with the standard-library parser inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions.arrow import slices
from parley.functions.text import squash_ws

# Fixed values
MIN_PAGE_CHARS = 300
NOISE_TAGS = {"nav", "header", "footer", "aside", "script", "style"}
VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HIDDEN_TAGS = {"script", "style", "template", "rt", "rp"}


class _PageText(HTMLParser):
    """Collects text once for each scope: whole page, first article, first main, body without noise.

    Text in scripts, styles, templates and ruby marks is not page text.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.texts: dict[str, list[str]] = {"page": []}
        self.open: dict[str, int] = {}  # scope -> depth of its element
        self.seen: set[str] = set()

    def handle_starttag(self, tag, attrs):
        if tag in ("article", "main", "body") and tag not in self.seen:
            self.seen.add(tag)
            self.texts[tag] = []
            self.open[tag] = len(self.stack)
        if tag not in VOID_TAGS:
            self.stack.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag not in self.stack:
            return
        while self.stack:
            top = self.stack.pop()
            for scope in [s for s, depth in self.open.items() if depth >= len(self.stack)]:
                del self.open[scope]
            if top == tag:
                return

    def handle_data(self, data):
        if HIDDEN_TAGS.intersection(self.stack):
            return
        self.texts["page"].append(data)
        for scope, depth in self.open.items():
            if scope != "body" or not NOISE_TAGS.intersection(self.stack[depth:]):
                self.texts[scope].append(data)


def page_texts(html: str | None) -> tuple[str, str]:
    """(text of the whole page, text of the main part) of one page."""
    parser = _PageText()
    parser.feed(html or "")
    parser.close()
    texts = {scope: "".join(parts) for scope, parts in parser.texts.items()}
    main = next((texts[s] for s in ("article", "main", "body") if s in texts), texts["page"])
    return texts["page"], main


def with_page_texts(df: DataFrame, html: str = "html") -> DataFrame:
    """Replace the HTML column by ``full_text`` and ``main_text`` in one parser pass."""
    keep = [f for f in df.schema if f.name != html]
    schema = T.StructType([*keep, T.StructField("full_text", T.StringType()), T.StructField("main_text", T.StringType())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            pairs = [page_texts(page) for page in batch.column(html).to_pylist()]
            out = batch.drop_columns([html])
            added = [pa.array([p[i] for p in pairs], pa.string()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*out.columns, *added], names=[*out.schema.names, "full_text", "main_text"])

    return df.mapInArrow(parse, schema)


def page_text(df: DataFrame, html: str = "html") -> DataFrame:
    """Add ``content``: the whole page when longer than 300 characters, else its main part (NULL if empty).

    The length counts before white space is collapsed.
    """
    parsed = with_page_texts(df, html)
    chosen = F.when(F.length("full_text") > MIN_PAGE_CHARS, F.col("full_text")).otherwise(
        F.nullif(F.col("main_text"), F.lit(""))
    )
    return parsed.withColumn("content", squash_ws(chosen)).drop("full_text", "main_text")
