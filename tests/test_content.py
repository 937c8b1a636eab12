"""The lexer of content streams against a state machine, byte by byte; character maps against their expansion."""

import json
import random

import pytest

from quillspark.operators import content as C

WHITE, BREAK = b"\x00\t\n\x0c\r ", b"()<>[]{}/%"


class Machine:
    """Reads whole operands recursively and knows nothing of regular expressions."""

    def __init__(self, data):
        self.d, self.i = data, 0

    def skip(self):
        while self.i < len(self.d) and (self.d[self.i] in WHITE or self.d[self.i] == 0x25):
            if self.d[self.i] == 0x25:
                while self.i < len(self.d) and self.d[self.i] not in b"\r\n":
                    self.i += 1
            else:
                self.i += 1

    def one(self):
        """("value", v), ("word", w) or None at the end."""
        self.skip()
        d = self.d
        if self.i >= len(d):
            return None
        c = d[self.i : self.i + 1]
        if c == b"/":
            self.i += 1
            out = ""
            while self.i < len(d) and d[self.i] not in WHITE + BREAK:
                pair = d[self.i + 1 : self.i + 3]
                if d[self.i] == 0x23 and len(pair) == 2 and all(x in b"0123456789abcdefABCDEF" for x in pair):
                    out, self.i = out + chr(int(pair, 16)), self.i + 3
                else:
                    out, self.i = out + chr(d[self.i]), self.i + 1
            return "value", "/" + out
        if c == b"(":
            self.i, depth, out = self.i + 1, 1, []
            while self.i < len(d):
                x = d[self.i]
                self.i += 1
                if x == 0x5C:
                    y = d[self.i : self.i + 1]
                    if y and y in b"01234567":
                        digits = ""
                        while len(digits) < 3 and self.i < len(d) and d[self.i] in b"01234567":
                            digits, self.i = digits + chr(d[self.i]), self.i + 1
                        out.append(int(digits, 8) & 255)
                        continue
                    self.i += 1
                    if y == b"\r" and d[self.i : self.i + 1] == b"\n":
                        self.i += 1
                    elif y not in (b"\r", b"\n", b""):
                        out.append({b"n": 10, b"r": 13, b"t": 9, b"b": 8, b"f": 12}.get(y, y[0]))
                    continue
                depth += (x == 0x28) - (x == 0x29)
                if not depth:
                    break
                out.append(x)
            return "value", {"s": bytes(out).hex()}
        if c == b"<" and d[self.i : self.i + 2] != b"<<":
            end = d.find(b">", self.i)
            digits = "".join(chr(x) for x in d[self.i : end if end >= 0 else len(d)] if x in b"0123456789abcdefABCDEF")
            self.i = end + 1 if end >= 0 else len(d)
            return "value", {"s": (digits + "0" * (len(digits) % 2)).lower()}
        if c == b"[":
            self.i, out = self.i + 1, []
            while True:
                self.skip()
                if self.i >= len(d):
                    return None
                if d[self.i : self.i + 1] == b"]":
                    self.i += 1
                    return "value", out
                x = self.one()
                if x is None:
                    return None
                if x[0] == "value":
                    out.append(x[1])
        if c == b"<":
            self.i, out, key = self.i + 2, {}, None
            while True:
                self.skip()
                if self.i >= len(d):
                    return None
                if d[self.i : self.i + 2] == b">>":
                    self.i += 2
                    return "value", out
                x = self.one()
                if x is None:
                    return None
                if key is None:
                    key = x[1] if x[0] == "value" and isinstance(x[1], str) and x[1][:1] == "/" else None
                elif x[1] != "" or x[0] == "value":
                    if x[0] == "value":
                        out[key] = x[1]
                    key = None
        if c in b"]>){}":
            self.i += 1
            return "word", ""
        at = self.i
        while self.i < len(d) and d[self.i] not in WHITE + BREAK:
            self.i += 1
        token = d[at : self.i].decode("latin-1")
        if token[0] in "0123456789+-.":
            try:
                v = float(token)
                return "value", int(v) if v == int(v) else v
            except ValueError:
                return "word", token
        return {"true": ("value", True), "false": ("value", False), "null": ("value", {"null": True})}.get(token, ("word", token))

    def all(self):
        args, begin = [], None
        while True:
            self.skip()
            at = self.i
            x = self.one()
            if x is None:
                return
            if x[0] == "value":
                begin = at if begin is None else begin
                args.append(x[1])
            elif x[1]:
                yield x[1], args, at if begin is None else begin, self.i
                args, begin = [], None


def lexed(data):
    return [(op, [json.loads(a) for a in args], start, end) for op, args, start, end in C.read_operations(data)]


def test_lexer_agrees_with_a_state_machine():
    r = random.Random(11)
    atoms = [b"12", b"-3.5", b".5", b"+4", b"/Na#20me", b"/A#zz", b"(a(b)c)", b"(\\101\\n\\)\\\n x\\\r\n\\q\\1234)", b"<48 65 6>", b"<>", b"true", b"null", b"Tj", b"re", b"T*", b"'", b"% note ( [\n", b"[1 (x) /N [2 <4a>] ]", b"<</K 1 /L [3] /M <</N (z)>> >>", b"]", b")", b"}", b"q", b"BX"]
    for _ in range(3000):
        data = b"".join(r.choice(atoms) + r.choice([b" ", b"\n", b"\x00", b"  \t", b"\r\n"]) for _ in range(r.randint(0, 14)))
        assert lexed(data) == list(Machine(data).all()), data


def test_damaged_streams_and_images():
    assert lexed(b"1 2 m [ 1 2") == [("m", [1, 2], 0, 5)] and lexed(b"(open") == [] and lexed(b"") == []
    assert lexed(b"q % Tj f") == [("q", [], 0, 1)] and lexed(b"q \n") == [("q", [], 0, 1)]
    assert lexed(b"--5 1.2.3 - 5abc 1e2 w") == [("w", [-5, 1.2, 0, 5, 100], 0, 22)]
    assert lexed(b"<</A 1 /B>> gs") == [("gs", [{"/A": 1}], 0, 14)] and lexed(b"[1 Tj 2] TJ") == [("TJ", [[1, 2]], 0, 11)]
    assert len(lexed(b"1 " * 100 + b"x")[0][1]) == C.MOST_OPERANDS
    image = b"q BI /W 2 /H 2 /CS /G ID \x01EI\x02 \xff EI Q"
    assert [(o, a) for o, a, *_ in lexed(image)] == [("q", []), ("BI", [{"/W": 2, "/H": 2, "/CS": "/G"}]), ("Q", [])] and lexed(image)[1][2:] == (2, image.index(b" Q"))
    known = b"BI /L 8 ID ab EI cd\nEI Q"
    assert [x[3] for x in lexed(known)] == [known.index(b" Q"), len(known)]
    assert lexed(b"BI /L 9 ID never ends") == [("BI", [{"/L": 9}], 0, 21)]


def test_operations_of_tables(spark):
    rows = [(1, bytearray(b"q 1 0 0 1 5 6 cm Q")), (2, None), (3, bytearray(b"")), (4, bytearray(b"(x) Tj"))]
    got = C.operations(spark.createDataFrame(rows, "id int, content binary"), ["id"], "content").orderBy("id", "n").collect()
    assert [(r.id, r.n, r.op, list(r.args), r.start, r.end) for r in got] == [(1, 0, "q", [], 0, 1), (1, 1, "cm", list("100156"), 2, 16), (1, 2, "Q", [], 17, 18), (4, 0, "Tj", ['{"s": "78"}'], 0, 6)]


MAP = """begincodespacerange <00> <7f> <8140> <9ffc> <e0000000><e0ffffff> endcodespacerange
5 beginbfrange
<41> <5A> <0061> % letters
<4D> <50> <0030>
<8140> <8142> [<0041> <D83DDE00> /none]
<8150> <8160> <FFFFFFFE>
<60> <50> <0000> endbfrange
1 beginbfchar <45> <00660066> endbfchar beginbfchar <46> /name <47> <58> endbfchar
begincidrange <00> <7f> 10 <41> <45> 500 <8140> <817e> 700 endcidrange begincidchar <43> 9 endcidchar"""


def expanded():
    out = {c: chr(0x61 + c - 0x41) for c in range(0x41, 0x5B)} | {c: chr(0x30 + c - 0x4D) for c in range(0x4D, 0x51)}
    return out | {0x8140: "A", 0x8141: "😀", 0x45: "ff", 0x46: "name", 0x47: "X"}


def test_character_maps(spark):
    maps = spark.createDataFrame([(1, MAP), (2, "no map"), (3, None)], "map int, text string")
    r = random.Random(9)
    strings = [(1, k, bytearray(r.choice([r.randbytes(r.randint(0, 9)), bytes(r.choices(b"ABCDEFGMNOPQ", k=5)) + b"\x81\x40\x81\x41\x81\x42\xe0\x00\x00\x01"]))) for k in range(120)] + [(2, 500, bytearray(b"ab")), (3, 501, None), (9, 502, bytearray(b"x"))]

    def split(data):
        at = 0
        while at < len(data):
            for n, lo, hi in ((1, 0, 0x7F), (2, 0x8140, 0x9FFC), (4, 0xE0000000, 0xE0FFFFFF)):
                if at + n <= len(data) and lo <= int.from_bytes(data[at : at + n]) <= hi:
                    break
            else:
                n = 1
            yield int.from_bytes(data[at : at + n])
            at += n

    df = spark.createDataFrame(strings, "map int, id int, content binary")
    known = expanded()
    got = {r.id: (r.text, r.n_codes) for r in C.decoded(df, maps, ["map"], "id", "content", "text").collect()}
    for m, k, data in strings:
        codes = list(split(data or b"")) if m == 1 else list(data or b"")
        if codes and not any(0x8150 <= c <= 0x8160 for c in codes):
            assert got[k] == ("".join(known.get(c, "�") if m == 1 else "�" for c in codes), len(codes))
        assert bool(codes) == (k in got)
    cut = C.intervals(C.char_ranges(maps, ["map"], "text"), ["map"])
    codes = spark.createDataFrame([(1, c) for c in (0, 0x40, 0x41, 0x43, 0x45, 0x46, 0x7F, 0x80, 0x8145, 0x9000)], "map int, code long")
    cid = {r.code: int(r.target) + r.code - r["from"] for r in C.mapped(codes, cut, ["map"], "cid").collect()}
    assert cid == {0: 10, 0x40: 74, 0x41: 75, 0x43: 9, 0x45: 79, 0x46: 80, 0x7F: 137, 0x8145: 705}


@pytest.mark.parametrize("code, by, expected", [("0061", 3, "0064"), ("D83DDE00", 5, "D83DDE05"), ("00FF", 1, "0100"), ("FFFF", 1, "0000"), ("0041004200430044004500460047", 1, "0041004200430044004500460048"), ("58", 2, "5A")])
def test_targets_are_counted_up(spark, code, by, expected):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(code, by)], "c string, k long").select(C.moved_on(F.col("c"), F.col("k"))).first()[0] == expected
