"""Damaged files: definitions, cut object streams, and page trees against a walk in Python."""

import random
import zlib

from quillspark.operators import salvage as S


def walk(data):
    """[(number, attached)] of the pages, by plain dictionaries."""
    own = {}
    for _, _, number, sound, kind, parent, kids, pages in S.scan(data):
        if sound:
            own.pop(number, None)
            own[number] = (kind, kids, pages)
    place = {n: k for k, n in enumerate(own)}
    is_ = lambda n, kind: n in own and own[n][0] == kind
    alive = {n for n in own if is_(n, "Page")}
    while more := {n for n in own if is_(n, "Pages") and n not in alive and any(k in alive for k in own[n][1])}:
        alive |= more
    told = [own[n][2] for n in own if is_(n, "Catalog") and own[n][2] is not None][-1:]
    roots = [r for r in told if is_(r, "Pages") and r in alive] or sorted(n for n in own if is_(n, "Pages") and n in alive and not any(n in own[m][1] for m in own if is_(m, "Pages") and m in alive))
    out = []

    def down(n, path):
        for k in own[n][1]:
            if k in alive and k not in path:
                if is_(k, "Page"):
                    out.append(k)
                else:
                    down(k, path + [k])

    for r in roots:
        down(r, [r])
    first = list(dict.fromkeys(out))
    return [(n, False) for n in first] + [(n, True) for n in sorted((n for n in own if is_(n, "Page") and n not in first), key=place.get)]


def test_definitions_and_cut_streams():
    inner = [(20 + k, b"<< /Type /Page /Parent 2 0 R /N %d >>" % k) for k in range(200)]
    offsets, body = [], b""
    for n, text in inner:
        offsets.append(b"%d %d" % (n, len(body)))
        body += text + b" "
    table = b" ".join(offsets) + b" "
    packed = zlib.compress(table + body)
    head = b"7 0 obj << /Type /ObjStm /N 200 /First %d /Filter /FlateDecode >> stream\r\n" % len(table)
    whole = head + packed + b"\nendstream endobj"
    assert [r[2] for r in S.scan(whole)] == [7, *range(20, 220)] and all(r[3] for r in S.scan(whole))
    cut = list(S.scan(head + packed[: len(packed) * 2 // 3]))
    assert not cut[0][3] and 5 < len(cut) < 200 and [r[2] for r in cut[1:]] == list(range(20, 19 + len(cut)))
    rows = list(S.scan(b"junk 1 0 obj (a\\) 2) endobj 1 0 obj << /K [1 >> ] endobj 2 0 obj << /A (open endobj 3 0 obj 5 4 0 obj 6 endobj"))
    assert [(r[2], r[3]) for r in rows] == [(1, True), (1, False), (2, False), (3, False), (4, True)]
    assert list(S.scan(b"")) == [] and list(S.scan(b"12 obj 1 0 objx")) == []


def damaged(r):
    parts = [b"%PDF-1.4\n"]
    numbers = range(2, 30)
    for _ in range(r.randint(3, 45)):
        n = r.choice(numbers)
        if r.random() < 0.45:
            body = b"<< /Type /Pages /Kids [%s] >>" % b" ".join(b"%d 0 R" % r.choice(numbers) for _ in range(r.randint(0, 5)))
        else:
            body = b"<< /Type /Page /Parent %d 0 R >>" % r.choice(numbers)
        parts.append(b"%d 0 obj %s endobj\n" % (n, body))
    if r.random() < 0.7:
        parts.insert(r.randrange(len(parts)), b"1 0 obj << /Type /Catalog /Pages %d 0 R >> endobj\n" % r.choice(numbers))
    data = bytearray(b"".join(parts))
    for _ in range(r.randint(0, 4)):
        at = r.randrange(len(data))
        data[at : at + r.randint(1, 12)] = r.choice([b"", b"]", b"(", b">>", b"\xff\x00"])
    return bytes(data[: r.choice([len(data), len(data), len(data) * 9 // 10])])


def test_page_trees(spark):
    r = random.Random(8)
    files = [(k, bytearray(damaged(r))) for k in range(120)] + [(900, None), (901, bytearray(b"no file"))]
    got = {}
    for x in S.rebuilt_pages(S.scanned_objects(spark.createDataFrame(files, "file int, content binary"), ["file"], "content"), ["file"]).collect():
        got.setdefault(x.file, []).append((x.page_index, x.number, x.attached))
    found = 0
    for k, data in files:
        expected = walk(bytes(data or b""))
        assert [(n, a) for _, n, a in sorted(got.get(k, []))] == expected
        found += sum(not a for _, a in expected)
    assert found > 50
