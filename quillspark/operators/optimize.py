"""Operators that plan smaller documents: equal streams, unreachable objects, image sizes, size targets."""

from __future__ import annotations

import math
from itertools import pairwise, zip_longest

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.geometry import half_up

# Resolution and quality of the presets, and of the coarse rungs of the ladder.
PRESETS = {"low": (220.0, 0.85), "recommended": (150.0, 0.72), "extreme": (96.0, 0.5)}
COARSE = (
    (300.0, 0.9), (250.0, 0.86), (220.0, 0.82), (200.0, 0.78), (170.0, 0.74), (150.0, 0.7), (130.0, 0.64), (110.0, 0.58),
    (96.0, 0.52), (84.0, 0.46), (72.0, 0.4), (60.0, 0.34), (50.0, 0.28), (40.0, 0.22), (30.0, 0.16),
)
KEEP_BELOW = 0.97


def same_streams(streams: DataFrame, key: str, content: str) -> DataFrame:
    """Adds canonical: the least key with exactly the same bytes.  One aggregate by hash and length, then a join on them."""
    hashed = streams.select(key, F.sha2(content, 256).alias("h"), F.octet_length(content).alias("n"))
    first = hashed.groupBy("h", "n").agg(F.min(key).alias("canonical"), F.count(F.lit(1)).alias("copies"))
    return hashed.join(first, ["h", "n"]).select(key, "canonical", "copies", F.col("n").cast("long").alias("n_bytes"))


def with_shortcuts(edges: DataFrame, key: list[str]) -> DataFrame:
    """Edges (key, id, b), and from every object with one successor those to the 2nd, 4th, 8th... object after it.

    Pointers double while the objects before them have one successor each, so that a chain of n objects has log n edges
    more for each of them and is walked in about log n steps.
    """
    own = edges.select(*key, F.col("a").alias("id"), "b").distinct().checkpoint()
    only = own.groupBy(*key, "id").agg(F.max("b").alias("b"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n").checkpoint()
    longest = only.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    jumps, out = only, own
    for _ in range(int(longest).bit_length()):
        jumps = jumps.join(jumps.select(*key, F.col("id").alias("b"), F.col("b").alias("c")), [*key, "b"]).select(*key, "id", F.col("c").alias("b")).checkpoint()
        if jumps.isEmpty():
            break
        out = out.unionByName(jumps)
    return out


def reachable(nodes: DataFrame, edges: DataFrame, roots: DataFrame, key: list[str]) -> DataFrame:
    """Nodes (key, id) that edges (key, a, b) lead to from roots (key, id); cycles are fine.

    A frontier goes one edge or shortcut further each round, drops what was reached before and ends when nothing is new.
    Rounds grow with the number of branchings on the way and the logarithm of the chains between them; each is written to
    the checkpoint folder, which keeps plans short.
    """
    step = with_shortcuts(edges, key).checkpoint()
    done = frontier = roots.select(*key, "id").distinct().checkpoint()
    while not frontier.isEmpty():
        ahead = frontier.join(step, [*key, "id"]).select(*key, F.col("b").alias("id")).distinct()
        frontier = ahead.join(done, [*key, "id"], "left_anti").checkpoint()
        done = done.unionByName(frontier).checkpoint()
    return nodes.join(done, [*key, "id"], "left_semi")


def ladder() -> list[tuple[float, float]]:
    """Rungs (dpi, quality): the coarse ones and, between neighbours, their means to the whole dpi and hundredth."""
    means = [(float(math.floor((d + e) / 2 + 0.5)), math.floor((q + r) * 50 + 0.5) / 100) for (d, q), (e, r) in pairwise(COARSE)]
    return [rung for both in zip_longest(COARSE, means) for rung in both if rung]


def preset_targets(images: DataFrame, key: str) -> DataFrame:
    """(key, preset, quality, target_w, target_h) of images (w, h, shown_w, shown_h, graphic) for every preset, in one pass."""
    presets = F.array(*(F.struct(F.lit(n).alias("preset"), F.lit(dpi).alias("dpi"), F.lit(q).alias("quality")) for n, (dpi, q) in PRESETS.items()))
    each = images.select("*", F.inline(presets))
    w, h = target_dims(F.col("w").cast("double"), F.col("h").cast("double"), F.col("shown_w"), F.col("shown_h"), F.col("dpi"), F.col("graphic"))
    return each.select(key, "preset", "quality", w.cast("long").alias("target_w"), h.cast("long").alias("target_h"))


# Start and factor of the 32-bit FNV-1a hash, and the bytes of a sample's window.
FNV_START, FNV_FACTOR = 0x811C9DC5, 16777619
HASH_WINDOW = 64 * 1024


def sample_hash(content: Column, window: int = HASH_WINDOW) -> Column:
    """FNV-1a over the start, the middle and the end of a binary column, up to ``window`` bytes each; null for null."""
    n = F.octet_length(content)
    at = (F.lit(0), F.greatest(F.floor(n / 2) - window // 2, F.lit(0)), F.greatest(n - window, F.lit(0)))
    sampled = F.concat(*(F.decode(F.substr(content, (a + 1).cast("int"), F.lit(window)), "ISO-8859-1") for a in at))
    chars = F.filter(F.split(sampled, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(FNV_START).cast("long"), lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * FNV_FACTOR).bitwiseAND(F.lit(0xFFFFFFFF)))


def target_dims(w: Column, h: Column, shown_w: Column, shown_h: Column, dpi: Column, graphic: Column) -> tuple[Column, Column]:
    """Pixels of an image for a resolution at its shown size (points), never more than it has, 16 at least.

    Graphics keep 1.4 times the resolution, up to 300; an image that is not shown counts as 11.7 inches long.
    """
    boosted = F.when(graphic, F.greatest(dpi, F.least(dpi * 1.4, F.lit(300.0)))).otherwise(dpi)
    shown = F.greatest(shown_w / 72 * boosted / w, shown_h / 72 * boosted / h)
    known = (shown_w > 1) & (shown_h > 1)
    scale = F.least(F.when(known, shown).otherwise(11.7 * boosted / F.greatest(w, h)), F.lit(1.0))
    return F.greatest(half_up(w * scale), F.lit(16)), F.greatest(half_up(h * scale), F.lit(16))


def image_jobs(images: DataFrame) -> DataFrame:
    """Images worth encoding anew: no stencils or colour keys, 32 pixels both ways, 8,000 bytes; masks take the shown size of their owner."""
    owner = images.select(F.col("image_id").alias("owner_id"), F.col("shown_w").alias("ow"), F.col("shown_h").alias("oh"))
    sized = images.join(owner, "owner_id", "left").withColumns({"shown_w": F.coalesce("shown_w", "ow"), "shown_h": F.coalesce("shown_h", "oh")}).drop("ow", "oh")
    return sized.where("not stencil and not color_key and w >= 32 and h >= 32 and n_bytes >= 8000")


def kept_if_smaller(images: DataFrame, file: str) -> DataFrame:
    """Adds kept, the encoded bytes if below 97 % of the original ones, and whether the images' file gets smaller by it."""
    kept = F.when(F.col("encoded") < F.col("n_bytes") * KEEP_BELOW, F.col("encoded")).otherwise(F.col("n_bytes"))
    done = images.withColumn("kept", kept)
    files = done.groupBy(file).agg(F.when(F.sum("kept") < F.sum("n_bytes"), "smaller").otherwise("unchanged").alias("file"))
    return done.join(files, file)


def custom_level(images: DataFrame, rungs: list[tuple[float, float]], key: str, target: Column) -> DataFrame:
    """The first rung at which the images' estimated bytes and the rest of a document fit its target; the last rung if none does.

    images: key, n_bytes, pixels, other_bytes.  An encoded image has pixels * (dpi / 300)^2 * quality / 2 bytes, kept
    if below 97 % of the original; that falls from rung to rung, so the first fit is what a binary search finds.
    Every rung is one sum of the same aggregate, which shuffles one partial row for each document.
    """

    def kept(dpi: float, quality: float) -> Column:
        size = F.floor(F.col("pixels") * F.lit(dpi / 300) * F.lit(dpi / 300) * F.lit(quality) / 2)
        return F.when(size < F.col("n_bytes") * KEEP_BELOW, size).otherwise(F.col("n_bytes"))

    sums = [F.sum(kept(*r)).alias(f"r{k}") for k, r in enumerate(rungs)]
    found = images.withColumn("target", target).groupBy(key).agg(F.max("other_bytes").alias("other"), F.max("target").alias("target"), *sums)
    totals = F.array(*(F.col(f"r{k}") + F.col("other") for k in range(len(rungs))))
    fit = F.array_position(F.transform("totals", lambda x: x <= F.col("target")), True)
    rung = F.when(fit > 0, fit - 1).otherwise(len(rungs) - 1).cast("int")
    return found.select(key, totals.alias("totals"), "target").select(key, rung.alias("rung"), F.get("totals", rung).cast("long").alias("n_bytes"), (fit > 0).alias("reached"))


def size_text(n: Column) -> Column:
    return F.when(n >= 1048576, F.concat(F.format_string("%.2f", n / 1048576), F.lit(" MB"))).otherwise(F.concat(half_up(n / 1024).cast("string"), F.lit(" KB")))


#: The pair of bits that each permission of a protected document has.
PERMISSION_BITS = {"printing": 4 + 2048, "modifying": 8 + 1024, "copying": 16 + 512, "annotating": 32 + 256}


def permission_bits(allowed: dict[str, Column]) -> Column:
    """The signed 32-bit number of permissions: all bits but the two lowest, less the pairs of what is refused."""
    refused = [F.when(allowed[name], 0).otherwise(bits) for name, bits in PERMISSION_BITS.items()]
    return F.lit(-4) - sum(refused, F.lit(0))
