"""Content streams as rows of operations, and character maps as sorted intervals of codes.

``operations`` is a lateral join with a table function, which turns the bytes of a stream into one row for each operator.
Its lexer is a regular expression for tokens and a stack of open arrays and dictionaries; nothing is copied from the
stream but operands.

Character maps stay ranges: ``char_ranges`` reads them by SQL functions, ``intervals`` cuts them into disjoint intervals of
which each has the range that counts there, and ``mapped`` finds the interval of a code by an as-of search over the
distinct codes of a map.  Only cutting a byte string into codes, where one code's length decides where the next one
begins, needs a helper in Python.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# White space and delimiters of content streams, and what a backslash stands for.
SPACE = rb"\x00\t\n\x0c\r "
DELIMITERS = rb"()<>\[\]{}/%"
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}
#: Operands kept before an operator; of more, which only damaged streams have, the last ones count.
MOST_OPERANDS = 64
#: How far after the stated length of an inline image its end is looked for.
NEAR_END = 16

_TOKEN = re.compile(rb"(?:[%s]|%%[^\r\n]*+)*+(?:(?P<name>/[^%s%s]*)|(?P<plain>[^%s%s]+)|(?P<open><<|\[)|(?P<close>>>|\])|(?P<text>\()|(?P<hex><[^>]*>?)|(?P<odd>.))" % (SPACE, SPACE, DELIMITERS, SPACE, DELIMITERS), re.S)
_PART = re.compile(rb"[^()\\]+|\\(?:[0-7]{1,3}|\r\n|.|$)|[()]", re.S)
_END = re.compile(rb"(?<=[%s])EI(?=[%s%s]|$)" % (SPACE, SPACE, DELIMITERS))
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+(?![.\d]))?")
_SIGNS = re.compile(rb"^([+-])[+-]+")
_HEX = re.compile(rb"#([0-9A-Fa-f]{2})")


def _number(token: bytes) -> float | int | None:
    """The number at the head of a token; several signs count as the first one, a lone sign or point as 0."""
    token = _SIGNS.sub(rb"\1", token)
    found = _NUMBER.match(token)
    if found:
        v = float(found[0])
        return int(v) if v == int(v) and abs(v) < 1e15 else v
    return 0 if token in (b"+", b"-", b".") else None


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    """The string whose parenthesis was opened before ``at``, and where it ends; one that stays open ends with the stream."""
    out, depth = [], 1
    while found := _PART.match(data, at):
        at, part = found.end(), found[0]
        if part[:1] == b"\\":
            rest = part[1:]
            part = bytes([int(rest, 8) & 255]) if rest[:1].isdigit() and rest[:1] < b"8" else ESCAPES.get(rest, rest)
        else:
            depth += (part == b"(") - (part == b")")
            if not depth:
                break
        out.append(part)
    return b"".join(out), at


class _Open:
    """An array or dictionary that is not closed yet."""

    def __init__(self, is_map: bool):
        self.is_map, self.items, self.pairs, self.key = is_map, [], {}, None

    def take(self, value) -> None:
        """An operand; ``None`` for a word that has no place here."""
        if not self.is_map:
            if value is not None:
                self.items.append(value)
        elif self.key is None:
            self.key = value if isinstance(value, str) and value.startswith("/") else None
        else:
            if value is not None:
                self.pairs[self.key] = value
            self.key = None

    def value(self):
        return self.pairs if self.is_map else self.items


_NULL = {"null": True}


def read_operations(data: bytes) -> Iterator[tuple[str, list[str], int, int]]:
    """(operator, operands as JSON, start, end) of a content stream.

    Names are strings with a slash, strings are {"s": hexadecimal}, null is {"null": true}.  Damaged streams: brackets
    without their counterpart and words inside of arrays and dictionaries are left out, a key without a value as well;
    what is open at the end has no operator and gives no row; an inline image without an end goes to the end.
    """
    args, begin, stack, at, image = [], None, [], 0, None
    while found := _TOKEN.match(data, at):
        kind, at = found.lastgroup, found.end()
        start, word, value = found.start(kind), None, None
        if kind == "name":
            value = "/" + _HEX.sub(lambda m: bytes([int(m[1], 16)]), found[kind][1:]).decode("latin-1")
        elif kind == "text":
            text, at = _literal(data, at)
            value = {"s": text.hex()}
        elif kind == "hex":
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", found[kind]).decode()
            value = {"s": (digits + "0" * (len(digits) % 2)).lower()}
        elif kind == "plain":
            token = found[kind]
            value = _number(token) if token[:1] in b"0123456789+-." else None
            if value is None:
                value = {b"true": True, b"false": False, b"null": _NULL}.get(token)
            if value is None:
                word = token.decode("latin-1")
        elif kind == "open":
            stack.append(_Open(found[kind] == b"<<"))
            begin = start if begin is None else begin
            continue
        elif kind == "close" and stack and stack[-1].is_map == (found[kind] == b">>"):
            value = stack.pop().value()
        if word is None and value is None:
            continue
        if stack:
            stack[-1].take(value)
            continue
        if image is not None:
            if word != "ID":
                image.take(value)
                continue
            at += data[at : at + 1] in [bytes([c]) for c in b"\x00\t\n\x0c\r "]
            length = image.pairs.get("/L", image.pairs.get("/Length"))
            length = int(length) if isinstance(length, int | float) and not isinstance(length, bool) and length > 0 else 0
            end = _END.search(data, at + length) if length else None
            end = end if end and end.end() - (at + length) < NEAR_END else _END.search(data, max(at, 1))
            at = end.end() if end else len(data)
            yield "BI", [json.dumps(image.pairs)], begin, at
            args, begin, image = [], None, None
        elif word is None:
            begin = start if begin is None else begin
            args = [*args, value][-MOST_OPERANDS:]
        elif word == "BI":
            image, begin = _Open(True), start if begin is None else begin
        else:
            yield word, [json.dumps(v) for v in args], start if begin is None else begin, at
            args, begin = [], None
    if image is not None:
        yield "BI", [json.dumps(image.pairs)], begin, len(data)


class ContentOperations:
    """The table function: rows of ``read_operations``, numbered from 0."""

    def eval(self, content: bytes):
        for n, (op, args, start, end) in enumerate(read_operations(bytes(content or b""))):
            yield n, op, args, start, end


def operations(streams: DataFrame, key: list[str], content: str) -> DataFrame:
    """(key, n, op, args, start, end): one row for each operation of every stream, by a lateral join with the table function."""
    function = F.udtf(ContentOperations, returnType="n int, op string, args array<string>, start long, end long")
    return streams.select(*key, content).lateralJoin(function(F.col(content).outer())).drop(content)


# -- character maps

_SECTION = r"(?s)\bbegin(codespacerange|bfchar|bfrange|cidchar|cidrange)\b(.*?)(?:\bend|$)"
_CODE = r"<\s*((?:[0-9A-Fa-f]\s*)*)>"
_ENTRY = {
    "codespacerange": rf"{_CODE}\s*{_CODE}()", "bfchar": rf"{_CODE}()\s*(<[^>]*>|/[^\s<>\[\]()%/]+)", "bfrange": rf"{_CODE}\s*{_CODE}\s*(<[^>]*>|\[[^\]]*\])", "cidchar": rf"{_CODE}()\s*(\d+)", "cidrange": rf"{_CODE}\s*{_CODE}\s*(\d+)",
}
#: Codes of a range of texts, at most.
LONGEST_RANGE = 65536


def _hex(text: Column) -> Column:
    """Hexadecimal digits in whole bytes."""
    digits = F.upper(F.regexp_replace(text, r"[^0-9A-Fa-f]", ""))
    return F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits)


def _code(digits: Column) -> Column:
    return F.conv(F.when(digits == "", "0").otherwise(digits), 16, 10).cast("long")


def char_ranges(maps: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, kind, width, lo, hi, target, place): the ranges of character maps; kind is space, text or cid.

    target is the text's bytes in UTF-16 as hexadecimal, a name with its slash, or a number, for the code lo.  Ranges whose
    targets are listed give one range for each code.  place orders the entries of a map.
    """
    plain = F.regexp_replace(text, r"%[^\r\n]*", "")
    sections = maps.select(*key, F.posexplode(F.regexp_extract_all(plain, F.lit(_SECTION), F.lit(0))).alias("section", "x"))
    sections = sections.withColumn("kind", F.regexp_extract("x", _SECTION, 1)).withColumn("x", F.regexp_extract("x", _SECTION, 2))
    entries = F.coalesce(*(F.when(F.col("kind") == k, F.regexp_extract_all("x", F.lit(p), F.lit(0))) for k, p in _ENTRY.items()))
    rows = sections.select(*key, "section", "kind", F.posexplode(entries).alias("entry", "e"))
    lo = _hex(F.regexp_extract("e", rf"^{_CODE}", 1))
    second = F.nullif(F.regexp_extract("e", rf"^{_CODE}\s*{_CODE}", 2), F.lit(""))
    ends = F.when(F.col("kind").isin("codespacerange", "bfrange", "cidrange"), _code(_hex(second))).otherwise(_code(lo))
    last = F.regexp_extract("e", r"(?s)(\[[^\]]*\]|<[^>]*>|/[^\s<>\[\]()%/]+|\d+)\s*$", 1)
    kind = F.when(F.col("kind") == "codespacerange", "space").when(F.col("kind").startswith("bf"), "text").otherwise("cid")
    rows = rows.select(*key, "section", "entry", "kind", kind.alias("of"), (F.length(lo) / 2).cast("int").alias("width"), _code(lo).alias("lo"), ends.alias("hi"), last.alias("last"))
    listed = F.col("last").startswith("[")
    many = rows.where(listed).select("*", F.posexplode(F.regexp_extract_all("last", F.lit("<[^>]*>"), F.lit(0))).alias("k", "one"))
    many = many.withColumns({"lo": F.col("lo") + F.col("k"), "last": F.col("one")}).where("lo <= hi").withColumn("hi", F.col("lo")).drop("one")
    every = rows.where(~listed).withColumn("k", F.lit(0)).unionByName(many).where("lo <= hi")
    target = F.when(F.col("of") == "space", None).when(F.col("last").startswith("<"), _hex(F.col("last"))).otherwise(F.col("last"))
    hi = F.when(F.col("of") == "text", F.least("hi", F.col("lo") + LONGEST_RANGE - 1)).otherwise(F.col("hi"))
    # Of texts the last one counts.  Numbers of single codes, the last one, come before those of ranges, the first one.
    at = F.struct(F.when(F.col("of") != "cid", 0).when(F.col("kind") == "cidchar", 1).otherwise(0).alias("single"), F.when(F.col("kind") == "cidrange", -F.col("section")).otherwise(F.col("section")).alias("section"), F.when(F.col("kind") == "cidrange", -F.col("entry")).otherwise(F.col("entry")).alias("entry"), "k")
    return every.select(*key, F.col("of").alias("kind"), "width", "lo", hi.alias("hi"), target.alias("target"), at.alias("place"))


def intervals(ranges: DataFrame, key: list[str]) -> DataFrame:
    """(key, kind, lo, hi, from, target): disjoint intervals of codes, each with the range that counts there, which begins at ``from``."""
    group = [*key, "kind"]
    edges = ranges.select(*group, F.explode(F.array(F.col("lo"), F.col("hi") + 1)).alias("at")).distinct()
    parts = edges.withColumn("to", F.lead("at").over(Window.partitionBy(*group).orderBy("at")) - 1).where("to is not null")
    met = parts.join(ranges, group).where("lo <= at and at <= hi")
    best = met.groupBy(*group, "at", "to").agg(F.max_by(F.struct("lo", "target"), "place").alias("r"))
    return best.select(*group, F.col("at").alias("lo"), F.col("to").alias("hi"), F.col("r.lo").alias("from"), "r.target")


def moved_on(target: Column, by: Column) -> Column:
    """The bytes of a text, in hexadecimal, ``by`` codes further: the last seven bytes are counted up."""
    tail = F.substring(target, -14, 14)
    size = F.length(tail)
    counted = F.lpad(F.hex(F.pmod(F.conv(tail, 16, 10).cast("long") + by, F.pow(F.lit(16.0), size).cast("long"))), size, "0")
    head = F.substring(target, F.lit(1), F.greatest(F.length(target) - 14, F.lit(0)))
    return F.concat(head, counted)


def mapped(codes: DataFrame, cut: DataFrame, key: list[str], kind: str) -> DataFrame:
    """(key, code, from, target) of the distinct codes (key, code) that an interval holds.

    Codes and the beginnings of intervals are one sorted list by map; the last beginning up to a code is its interval.
    """
    own = cut.where(F.col("kind") == kind).drop("kind")
    both = codes.select(*key, "code", F.lit(1).alias("asks"), F.lit(None).cast("struct<hi: bigint, from: bigint, target: string>").alias("r")).distinct()
    both = both.unionByName(own.select(*key, F.col("lo").alias("code"), F.lit(0).alias("asks"), F.struct("hi", "from", "target").alias("r")))
    w = Window.partitionBy(*key).orderBy("code", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("r", F.last("r", ignorenulls=True).over(w)).where("asks = 1 and code <= r.hi")
    return found.select(*key, "code", "r.from", "r.target")


def _codes_of(data: bytes, spaces: dict[int, list[tuple[int, int]]], width: int) -> Iterator[dict]:
    """Codes of a byte string: the shortest that lies in a code space of its length, else ``width`` bytes, or what is left."""
    at = 0
    while at < len(data):
        n = next((n for n in (1, 2, 3, 4) if at + n <= len(data) and any(lo <= int.from_bytes(data[at : at + n]) <= hi for lo, hi in spaces.get(n, ()))), min(width, len(data) - at))
        yield {"code": int.from_bytes(data[at : at + n]), "width": n}
        at += n


def split_codes(strings: DataFrame, ranges: DataFrame, key: list[str], content: str, fallback: int = 1) -> DataFrame:
    """``strings`` with pos, code and width: the codes of byte strings by the code spaces of their map; empty strings give no rows."""

    @F.arrow_udf("array<struct<code: bigint, width: int>>")
    def cut(texts: pa.Array, spaces: pa.Array) -> pa.Array:
        out = []
        for data, own in zip(texts.to_pylist(), spaces.to_pylist(), strict=True):
            by: dict[int, list[tuple[int, int]]] = {}
            for s in own or ():
                by.setdefault(s["width"], []).append((s["lo"], s["hi"]))
            out.append(list(_codes_of(bytes(data or b""), by, fallback)))
        return pa.array(out, pa.list_(pa.struct([("code", pa.int64()), ("width", pa.int32())])))

    spaces = ranges.where("kind = 'space'").groupBy(*key).agg(F.collect_list(F.struct("width", "lo", "hi")).alias("__spaces"))
    rows = strings.join(spaces, key, "left").withColumn("__codes", cut(F.col(content), F.col("__spaces"))).drop("__spaces")
    return rows.select(*strings.columns, F.posexplode("__codes").alias("pos", "c")).select(*strings.columns, "pos", "c.code", "c.width")


def decoded(strings: DataFrame, maps: DataFrame, key: list[str], string: str, content: str, text: str, fallback: int = 1) -> DataFrame:
    """(key, string, text, n_codes): byte strings as text; codes without a text give U+FFFD, names stand as they are."""
    ranges = char_ranges(maps, key, text)
    codes = split_codes(strings.select(*key, string, content), ranges, key, content, fallback)
    found = mapped(codes, intervals(ranges, key), key, "text").withColumn("moved", moved_on(F.col("target"), F.col("code") - F.col("from")))
    wide = F.when(F.length("moved") == 2, F.concat(F.lit("00"), F.col("moved"))).otherwise(F.col("moved"))
    shown = F.when(F.col("target").startswith("/"), F.substring("target", 2, 1 << 30)).otherwise(F.decode(F.unhex(wide), "UTF-16BE"))
    rows = codes.join(found.select(*key, "code", shown.alias("shown")), [*key, "code"], "left")
    piece = F.struct("pos", F.coalesce("shown", F.lit("�")).alias("t"))
    return rows.groupBy(*key, string).agg(F.array_join(F.sort_array(F.collect_list(piece))["t"], "").alias("text"), F.count(F.lit(1)).alias("n_codes"))
