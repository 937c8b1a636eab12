"""Files as relations: checks on ingest, folders, HTML pages as blocks."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from quillspark.functions.slices import lists, sliced


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """All files under a folder: path, modificationTime, length, content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)


def starts_with_marker(content: Column, marker: bytes = b"%PDF", within: int = 1024) -> Column:
    """Whether a marker lies in the first bytes of a file that is at least as long as the marker."""
    head = F.hex(F.substring(content, 1, within))
    return (F.octet_length(content) >= len(marker)) & head.rlike(f"^(?:..)*?{marker.hex().upper()}")


def accepted(df: DataFrame, content: str, limit: int) -> DataFrame:
    """Adds accepted and the reason of a refusal: empty, too large, or another kind of file."""
    n = F.coalesce(F.octet_length(content), F.lit(0))
    reason = F.when(n == 0, "empty").when(n > limit, "too large").when(~starts_with_marker(F.col(content)), "not a document")
    return df.withColumns({"reason": reason, "accepted": reason.isNull()})


def folder_size(df: DataFrame, path: str, depth: int) -> DataFrame:
    """Files and bytes under every folder of ``depth`` parts of a path relation (path, length)."""
    top = F.array_join(F.slice(F.split(F.col(path), "/"), 1, depth), "/")
    return df.groupBy(top.alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


class _Blocks(HTMLParser):
    """Blocks of a page in order: (kind, level, text).  Scripts, styles, navigation and footers are left out."""

    BLOCK = {"p": "paragraph", "li": "item", "td": "cell", "th": "cell", "pre": "paragraph", "div": "paragraph", "article": "paragraph", "body": "paragraph", "section": "paragraph"}
    SKIP = frozenset({"script", "style", "nav", "footer", "head", "template"})

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, int, str]] = []
        self.kind, self.level, self.text, self.skipped = "paragraph", 0, [], []

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.out.append((self.kind, self.level, text))
        self.text = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SKIP:
            self.flush()
            self.skipped.append(tag)
        elif tag == "br":
            self.text.append(" ")
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.flush()
            self.kind, self.level = "heading", int(tag[1])
        elif tag in self.BLOCK:
            self.flush()
            self.kind, self.level = self.BLOCK[tag], 0

    def handle_endtag(self, tag: str) -> None:
        if self.skipped and tag == self.skipped[-1]:
            self.skipped.pop()
        elif tag in self.BLOCK or (len(tag) == 2 and tag[0] == "h"):
            self.flush()
            self.kind, self.level = "paragraph", 0

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.text.append(data)


def _parsed(page: str | None) -> list[tuple[str, int, str]]:
    parser = _Blocks()
    parser.feed(page or "")
    parser.close()
    parser.flush()
    return parser.out


_BLOCK = [("kind", pa.string()), ("level", pa.int32()), ("text", pa.string())]


@F.arrow_udf(from_arrow_type(pa.list_(pa.struct(_BLOCK))))
@sliced
def _page_blocks(pages: pa.Array) -> pa.Array:
    """The blocks of pages; only those of a slice of pages are Python objects at once."""
    return lists([_parsed(p) for p in pages.to_pylist()], _BLOCK)


def html_blocks(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, block, kind, level, text) of all pages; a null page has no blocks."""
    return df.select(key, F.posexplode(_page_blocks(F.col(html))).alias("block", "b")).select(key, "block", "b.*")
