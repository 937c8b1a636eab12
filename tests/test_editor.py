"""The editor's chunks, lines and blocks against a version that holds the whole page, literally by the rules."""

import math
import random
import re
from collections import Counter

from quillspark.operators import editor as E

SCHEMA = "page int, n long, text string, x double, y double, dx double, dy double, size double, width double, mode int, font string, bold boolean"
NAMES = SCHEMA.replace(",", "").split()[::2]


def whole_page(glyphs):
    """[(angle, across, text, bold, block)] of the lines of a page, and how many chunks are printed over others."""
    chunks = []
    for g in glyphs:
        if g["mode"] in (3, 7) or not 0.5 < g["size"] < 2000:
            continue
        angle = math.floor(math.degrees(math.atan2(g["dy"], g["dx"])) + 0.5)
        c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
        a, p = g["x"] * c + g["y"] * s, g["y"] * c - g["x"] * s
        g = g | {"a": a}
        if chunks and chunks[-1]["angle"] == angle:
            o = chunks[-1]
            size = max(o["size"], g["size"])
            if abs(p - o["p"]) < size * 0.3 and -size * 0.6 < a - o["x1"] < size:
                o["glyphs"].append(g)
                o["x1"], o["x0"], o["size"] = max(o["x1"], a + g["width"]), min(o["x0"], a), size
                continue
        chunks.append({"angle": angle, "p": p, "x0": a, "x1": a + g["width"], "size": g["size"], "glyphs": [g], "dup": False})
    words = lambda c: "".join(g["text"] or "" for g in c["glyphs"])
    lines, repeated = [], 0
    for angle in dict.fromkeys(c["angle"] for c in chunks):
        bands = []
        for c in sorted((c for c in chunks if c["angle"] == angle), key=lambda c: c["p"]):
            if bands and abs(c["p"] - bands[-1][0]["p"]) < 0.35 * max(c["size"], bands[-1][0]["size"]):
                bands[-1].append(c)
            else:
                bands.append([c])
        for band in bands:
            line = None
            for c in sorted(band, key=lambda c: c["x0"]):
                if line:
                    size = max(line["size"], c["size"])
                    if min(line["x1"], c["x1"]) > max(c["x0"], line["x0"]) and any(not o["dup"] and abs(o["x0"] - c["x0"]) < 0.3 * size and words(o) == words(c) for o in line["chunks"]):
                        c["dup"] = True
                        repeated += 1
                        line["chunks"].append(c)
                        continue
                    if c["x0"] - line["x1"] < size:
                        line["chunks"].append(c)
                        line["x1"], line["size"] = max(line["x1"], c["x1"]), size
                        continue
                line = {"chunks": [c], "angle": angle, "x0": c["x0"], "x1": c["x1"], "p": c["p"], "size": c["size"]}
                lines.append(line)
    kept = []
    for line in lines:
        every = [g for c in line["chunks"] for g in c["glyphs"]]
        if not any((g["text"] or "x").strip() for g in every):
            continue
        fonts, best = Counter(), None
        for g in every:
            fonts[g["font"]] += 1
            if best is None or fonts[g["font"]] > best[0]:
                best = fonts[g["font"]], g["bold"]
        text, end, before = "", None, None
        for g in (g for c in line["chunks"] if not c["dup"] for g in c["glyphs"]):
            if end is not None and g["a"] - end > 0.17 * line["size"] and (g["text"] or "x").strip() and (before["text"] or "x").strip():
                text += " "
            text += "�" if g["text"] is None else g["text"]
            end, before = max(end or -1e9, g["a"] + g["width"]), g
        kept.append(line | {"text": re.sub(r"\s+", " ", text).strip(), "bold": best[1]})
    kept.sort(key=lambda r: (r["angle"], r["p"], r["x0"]))
    blocks = []
    for i, r in enumerate(kept):
        best, least = None, math.inf
        for b in reversed(blocks):
            k = b["lines"][-1]
            o = kept[k]
            if o["angle"] != r["angle"] or b["closed"]:
                continue
            s, down = max(o["size"], r["size"]), r["p"] - o["p"]
            if down > 2 * s:
                b["closed"] = True
                continue
            over = lambda u, x0, x1: min(u["x1"], x1) - max(u["x0"], x0) > 0
            edges = [abs(r["x0"] - b["x0"]) < s * (3 if len(b["lines"]) == 1 else 1.5), abs(r["x1"] - b["x1"]) < 1.5 * s, abs((r["x0"] + r["x1"]) / 2 - (b["x0"] + b["x1"]) / 2) < 1.5 * s, r["x0"] >= b["x0"] - s and r["x1"] <= b["x1"] + s]
            fits = 0.55 * s <= down <= 1.75 * s and 0.83 <= r["size"] / o["size"] <= 1.2 and r["bold"] == o["bold"] and over(r, b["x0"], b["x1"]) and any(edges)
            fits = fits and (b["gap"] is None or abs(down - b["gap"]) <= 0.25 * b["gap"])
            if fits and not any(o["p"] + 0.2 * s < u["p"] < r["p"] - 0.2 * s and over(u, r["x0"], r["x1"]) for u in kept[k + 1 : i]) and down < least:
                best, least = b, down
        if best:
            best["gap"] = r["p"] - kept[best["lines"][-1]]["p"] if best["gap"] is None else best["gap"]
            best["lines"].append(i)
            best["x0"], best["x1"] = min(best["x0"], r["x0"]), max(best["x1"], r["x1"])
        else:
            blocks.append({"lines": [i], "x0": r["x0"], "x1": r["x1"], "gap": None, "closed": False})
    return sorted(tuple(sorted(kept[i]["text"] for i in b["lines"])) for b in blocks), sorted((r["angle"], round(r["p"], 6), r["text"], r["bold"]) for r in kept), repeated


def pages():
    r = random.Random(21)
    glyphs = []
    for page in range(24):
        n = 0
        angle = [0, 0, 90, 30, -90, 0][page % 6]
        c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))

        def put(text, a, p, size, bold=False, mode=0, page=page, c=c, s=s):
            nonlocal n
            glyphs.append((page, n, text, a * c - p * s, a * s + p * c, c, s, size, 0.5 * size * max(1, len(text or " ")), mode, "B" if bold else "R", bold))
            n += 1

        for column in range(1 + page % 3):
            p = 40.0
            for k in range(r.randint(3, 14)):
                size = r.choice([10.0, 10.0, 10.0, 11.0, 16.0])
                bold, a = r.random() < 0.2, 30 + 220 * column + r.choice([0, 0, 5, 40])
                for _ in range(r.randint(1, 6)):
                    text = r.choice(["a", "Bc", " ", "word", None, "x\t"])
                    put(text, a, p + r.choice([0, 0, 0.5, 2.0]), size, bold, mode=r.choice([0] * 12 + [3, 7]))
                    if r.random() < 0.15:
                        put(text, a + r.choice([0.3, 1.0]), p, size, bold)
                    a += 0.5 * size * max(1, len(text or " ")) + r.choice([0, 0, 2.5, 4, 12])
                p += size * r.choice([1.2, 1.2, 1.2, 1.5, 2.1, 0.5])
    return glyphs + [(99, 0, " ", 0.0, 0.0, 1.0, 0.0, 10.0, 5.0, 0, "R", False), (98, 0, "big", 0.0, 0.0, 1.0, 0.0, 3000.0, 5.0, 0, "R", False)]


def test_chunks_lines_and_blocks(spark):
    rows = pages()
    chunked = E.glyph_chunks(spark.createDataFrame(rows, SCHEMA).repartition(5), ["page"]).cache()
    chunks = E.chunk_lines(chunked, ["page"]).collect()
    found = E.editor_blocks(E.editor_lines(chunked, ["page"]), ["page"]).collect()
    total = 0
    for page in range(24):
        glyphs = [dict(zip(NAMES, g, strict=True)) for g in rows if g[0] == page]
        blocks, lines, repeated = whole_page(glyphs)
        own = [x for x in found if x.page == page]
        assert sorted((x.angle, round(x.across, 6), x.text, x.bold) for x in own) == lines
        by = {}
        for x in own:
            by.setdefault(x.block, []).append(x.text)
        assert sorted(tuple(sorted(v)) for v in by.values()) == blocks
        assert sum(c.repeated for c in chunks if c.page == page) == repeated
        total += repeated
    assert total >= 20 and not [x for x in found if x.page > 90]
