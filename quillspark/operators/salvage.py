"""Objects and pages of damaged PDF files.

A table function scans the bytes of a file for objects, whatever its cross-references say: one row for each definition,
also for those in object streams, of which a cut one gives the objects that arrived whole.  What follows are joins: of
several definitions the last sound one counts, since a broken one is blanked; nodes of the page tree that lead to no page
go; pages are numbered by their paths through what is left, and pages that no path reaches are attached behind them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.content import _TOKEN, _literal
from quillspark.operators.optimize import reachable

_OBJECT = re.compile(rb"(?<![0-9])(\d{1,10})\s+(\d{1,5})\s+obj\b")
_REFERENCE = rb"(\d+)\s+\d+\s+R\b"
_STREAM = re.compile(rb"\bstream\r?\n?")


def is_sound(body: bytes) -> bool:
    """Whether all strings, arrays and dictionaries of an object are closed in order."""
    stack, at = [], 0
    while found := _TOKEN.match(body, at):
        kind, at = found.lastgroup, found.end()
        if kind == "text":
            _, at = _literal(body, at)
            if body[at - 1 : at] != b")":
                return False
        elif kind == "hex" and not found[kind].endswith(b">"):
            return False
        elif kind == "open":
            stack.append(found[kind])
        elif kind == "close" and (not stack or stack.pop() != {b">>": b"<<", b"]": b"["}[found[kind]]):
            return False
        elif kind == "odd":
            return False
    return not stack


def _described(number: int, body: bytes) -> tuple:
    """(number, sound, kind, parent, kids, pages) of an object without its stream."""
    kind = re.search(rb"/Type\s*/(\w+)", body)
    kids = re.search(rb"/Kids\s*\[([^\]]*)\]", body)
    one = lambda name: (m := re.search(rb"/" + name + rb"\s+" + _REFERENCE, body)) and int(m[1])
    return number, is_sound(body), kind and kind[1].decode("latin-1"), one(b"Parent"), [int(k) for k in re.findall(_REFERENCE, kids[1])] if kids else [], one(b"Pages")


def _inner(head: bytes, data: bytes) -> Iterator[tuple[int, bytes]]:
    """(number, body) of the objects of an object stream that arrived whole; the last one counts as whole if the stream ended."""
    first, whole = re.search(rb"/First\s+(\d+)", head), True
    if not first or b"/DecodeParms" in head:
        return
    if b"/FlateDecode" in head:
        unpack = zlib.decompressobj()
        out = b""
        try:
            for k in range(0, len(data), 4096):
                out += unpack.decompress(data[k : k + 4096])
        except zlib.error:
            pass
        data, whole = out, unpack.eof
    first = int(first[1])
    numbers = [int(x) for x in re.findall(rb"\d+", data[:first])] if len(data) >= first else []
    pairs = list(zip(numbers[::2], numbers[1::2], strict=False))
    for k, (number, begin) in enumerate(pairs):
        end = pairs[k + 1][1] if k + 1 < len(pairs) else None
        if first + end <= len(data) if end is not None else whole and first + begin < len(data):
            yield number, data[first + begin : first + end if end is not None else len(data)]


def scan(data: bytes) -> Iterator[tuple]:
    """(place, start, number, sound, kind, parent, kids, pages) of all definitions in order; one that is never ended is not sound."""
    found, place = list(_OBJECT.finditer(data)), 0
    for k, m in enumerate(found):
        limit = found[k + 1].start() if k + 1 < len(found) else len(data)
        stop = data.find(b"endobj", m.end(), limit)
        body = data[m.end() : stop if stop >= 0 else limit]
        stream = _STREAM.search(body)
        head = body[: stream.start()] if stream else body
        number, sound, *rest = _described(int(m[1]), head)
        yield place, m.start(), number, sound and stop >= 0, *rest
        place += 1
        if stream and sound and re.search(rb"/Type\s*/ObjStm", head):
            inside = body[stream.end() :]
            end = inside.rfind(b"endstream")
            for own, text in _inner(head, inside[:end] if end >= 0 else inside):
                yield place, m.start(), *_described(own, text)
                place += 1


class ScannedObjects:
    """The table function: rows of ``scan``."""

    def eval(self, content: bytes):
        yield from scan(bytes(content or b""))


def scanned_objects(files: DataFrame, key: list[str], content: str) -> DataFrame:
    """(key, place, start, number, sound, kind, parent, kids, pages): one row for each definition of an object in damaged files."""
    function = F.udtf(ScannedObjects, returnType="place int, start long, number long, sound boolean, kind string, parent long, kids array<long>, pages long")
    return files.select(*key, content).lateralJoin(function(F.col(content).outer())).drop(content)


def last_definitions(objects: DataFrame, key: list[str]) -> DataFrame:
    """The last sound definition of every number."""
    w = Window.partitionBy(*key, "number").orderBy(F.desc("place"))
    return objects.where("sound").withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


def rebuilt_pages(objects: DataFrame, key: list[str]) -> DataFrame:
    """(key, page_index, number, attached) of the pages that are left, from 0.

    Pages follow the tree below the catalog's node, or below all nodes that are nobody's kid where no catalog tells one
    that leads to a page; those that it does not reach follow by their place, with attached set.  A node's kids are taken
    in order, one that is met again on its own path is left out, and of several paths to a page the first one counts.
    """
    own = last_definitions(objects, key).checkpoint()
    pages = own.where("kind = 'Page'").select(*key, "number", "place")
    kids = own.where("kind = 'Pages'").select(*key, F.col("number").alias("node"), F.posexplode("kids").alias("nth", "kid"))
    nodes = own.where("kind in ('Page', 'Pages')").select(*key, F.col("number").alias("id"))
    alive = reachable(nodes, kids.select(*key, F.col("kid").alias("a"), F.col("node").alias("b")), pages.select(*key, F.col("number").alias("id")), key)
    kids = kids.join(alive.select(*key, F.col("id").alias("kid")).distinct(), [*key, "kid"], "left_semi").checkpoint()
    inner = own.where("kind = 'Pages'").select(*key, F.col("number").alias("id")).join(alive, [*key, "id"], "left_semi")
    last = own.where("kind = 'Catalog' and pages is not null").groupBy(*key).agg(F.max_by("pages", "place").alias("id"))
    told = last.join(inner, [*key, "id"], "left_semi")
    free = inner.join(kids.select(*key, F.col("kid").alias("id")), [*key, "id"], "left_anti").join(told.select(*key), key, "left_anti")
    at = told.unionByName(free).select(*key, "id", F.array(F.col("id")).alias("seen"), F.array(F.col("id")).alias("path")).checkpoint()
    paths = None
    while not at.isEmpty():
        found = at.join(kids, (F.col("id") == F.col("node")) if not key else [at[k] == kids[k] for k in key] + [at["id"] == kids["node"]])
        found = found.where(~F.array_contains("seen", F.col("kid"))).select(*(at[k] for k in key), F.col("kid").alias("id"), F.array_append("seen", F.col("kid")).alias("seen"), F.array_append("path", F.col("nth").cast("long")).alias("path")).checkpoint()
        paths = found if paths is None else paths.unionByName(found)
        at = found
    first = (paths if paths is not None else at).groupBy(*key, F.col("id").alias("number")).agg(F.min("path").alias("path"))
    rows = pages.join(first, [*key, "number"], "left").withColumn("attached", F.col("path").isNull())
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("attached", "path", "place")) - 1
    return rows.select(*key, rank.alias("page_index"), "number", "attached")
