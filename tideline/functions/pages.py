"""Text of web pages by fixed rules: visible lines, and paragraphs with their headings.

One pass of a tokeniser (Python, since markup needs a state) turns a page into rows: each start tag and each piece of text
with the path of the elements it lies in. All rules are expressions over these rows. An element ends with its end tag, with
that of an element around it, or with the page; stray end tags are ignored; void elements are none.
"""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Elements by their role, the least characters of a paragraph, and the format of its id (fixed values).
UNSEEN, LINES = ("script", "style", "noscript"), ("p", "li", "h1", "h2", "h3", "h4", "tr", "div")
DROPPED, PARTS = ("script", "style", "nav", "footer", "header", "form", "aside"), ("h1", "h2", "h3", "h4", "p", "li", "tr")
REGIONS = ("main", "article", "role", "body")
SHORTEST, NUMBERED = 12, "P%04d"
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Line ends and white space as Unicode has them.
_BREAK, _BLANK = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]", r"(?U)[\s\x1C-\x1F]+"
EVENTS = "n int, path array<struct<tag: string, node: int, main: boolean>>, text string"


class _Walk(HTMLParser):
    def __init__(self, page: str):
        super().__init__()
        self.path: list[dict] = []
        self.rows: list[tuple] = []
        self.feed(page)
        self.close()

    def note(self, text: str | None) -> None:
        self.rows.append((len(self.rows), list(self.path), text))

    def cut(self, tag: str, deepest: int = 0) -> None:
        """Ends the innermost element of that name, and all inside it, unless it lies ``deepest`` or less deep."""
        for k in range(len(self.path) - 1, deepest - 1, -1):
            if self.path[k]["tag"] == tag:
                del self.path[k:]
                return

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        if tag == "p":
            self.cut(tag)
        elif tag in ("li", "tr"):
            self.cut(tag, len(self.path) - 1 if self.path else 0)
        self.path.append({"tag": tag, "node": len(self.rows), "main": ("role", "main") in attrs})
        self.note(None)

    def handle_endtag(self, tag):
        self.cut(tag)

    def handle_data(self, data):
        self.note(data)


def events(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, n, path, text): the start tags (text null, path with the element itself) and texts of a page in order, after a
    first row with an empty path and text."""

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int32(), pa.list_(pa.struct([("tag", pa.string()), ("node", pa.int32()), ("main", pa.bool_())])), pa.string()]
        for batch in batches:
            for k in range(batch.num_rows):
                rows = [(-1, [], ""), *_Walk(batch.column(1)[k].as_py() or "").rows]
                own = [batch.column(0)[k].as_py()] * len(rows)
                yield pa.RecordBatch.from_arrays([pa.array(own, batch.column(0).type), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]], [key, "n", "path", "text"])

    return pages.select(key, html).mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, {EVENTS}")


def _within(names: tuple[str, ...], path="path") -> Column:
    return F.exists(path, lambda x: x["tag"].isin(*names))


def _collapsed(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, _BLANK, " "))


def page_lines(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, text): lines at block elements, without hidden elements, white space collapsed, empty lines left out; a null
    page has the empty text. A key names one page."""
    starts = F.col("text").isNull() & F.element_at("path", -1)["tag"].isin(*LINES)
    piece = F.when(starts, "\n").when(_within(UNSEEN), "").otherwise(F.coalesce("text", F.lit("")))
    rows = events(pages, key, html).select(key, F.struct("n", piece.alias("piece")).alias("e"))
    whole = rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda x: x["piece"]), "").alias("t"))
    lines = F.filter(F.transform(F.split("t", _BREAK), _collapsed), lambda x: x != "")
    return whole.select(key, F.array_join(lines, "\n").alias("text"))


def page_paragraphs(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, paragraph_id, heading, text): headings, paragraphs, items and rows of at least SHORTEST characters in the first
    main, article, role=main or body element of a page, each text once, with the last heading so far."""
    rows = events(pages, key, html)
    # the region: of the first kind there is, its first element
    kind = lambda x: F.when(x["tag"].isin("main", "article", "body"), x["tag"]).when(x["main"], "role")
    last = F.element_at("path", -1)
    found = rows.where(F.col("text").isNull()).select(key, F.explode(F.array_compact(F.array(kind(last), F.when(last["main"], "role")))).alias("kind"), last["node"].alias("node"))
    region = found.groupBy(key).agg(F.min(F.struct(F.array_position(F.lit(list(REGIONS)), F.col("kind")).alias("place"), "node"))["node"].alias("region"))
    # the elements that a text counts for: parts that don't lie in an item or a row
    place = lambda x: F.array_position(F.transform("path", lambda y: y["node"]), x["node"]).cast("int")
    part = lambda x: x["tag"].isin(*PARTS) & ~_within(("li", "tr"), F.slice("path", 1, place(x) - 1))
    inside = rows.join(region.withColumnRenamed(key, "page_of"), F.col(key) == F.col("page_of")).where(F.exists("path", lambda x: x["node"] == F.col("region")) & ~_within(DROPPED))
    inside = inside.select(key, "n", "region", _collapsed(F.col("text")).alias("text"), F.explode(F.filter("path", part)).alias("x")).where(F.col("x.node") >= F.col("region"))
    text = F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda e: e["text"] != ""), lambda e: e["text"]), " ")
    parts = inside.groupBy(key, F.col("x.node").alias("node"), F.col("x.tag").alias("tag")).agg(text.alias("text"))
    order = W.partitionBy(key).orderBy("node")
    heading = F.last(F.when(F.col("tag").startswith("h"), F.col("text")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    parts = parts.withColumn("heading", F.coalesce(heading, F.lit(""))).where(F.length("text") >= SHORTEST)
    once = parts.withColumn("nth", F.row_number().over(W.partitionBy(key, "text").orderBy("node"))).where("nth = 1")
    return once.select(key, F.format_string(NUMBERED, F.row_number().over(order)).alias("paragraph_id"), "heading", "text")


def overlap(a, b):
    """Words of at least four letters that two texts share."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{4,}"), F.lit(0)))
    return F.size(F.array_intersect(words(a), words(b)))
