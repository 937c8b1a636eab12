"""SimHash near-duplicates, found by Golay codes: fingerprints at ``BITS`` or fewer differing bits are linked.

A fingerprint is cut into three segments of at most 23 bits.  Two differing bits leave one segment as it is, and of the
other two one has at most one of them.  So every pair of linked fingerprints agrees in a segment and differs in at most
one bit of another, six cases in all.  In the binary Golay code of length 23 every word lies within three bits of exactly
one codeword, its centre, and within four bits of that one alone or of six: the nearby ones.  If two words differ in one
bit, the centre of either is nearby the other.  A fingerprint's keys in a case are therefore the agreeing segment together
with the index of each nearby codeword of the other segment, and a pair meets under a key that is the centre of one of
them.  Pairs that meet are verified on all 64 bits, so nothing is missed and nothing is taken for certain.

Only distinct fingerprints take part, with the least id of their rows.  A key with more than ``CROWD`` of them is not
compared as it stands: its fingerprints are dealt by all ways in which four of six pieces of the other bits agree, as
two differing bits leave them, so that at most ``2 ** 15`` distinct ones share what a group has in common.  A group gives
its links as stars around the least of every part of it that hangs together, not as pairs.  Stars make components.

Defined results: null and empty texts and those of white space have the fingerprint zero and are linked like any other;
a text of fewer than three words is one shingle; repeated rows have one fingerprint and one component; component_id is the
least id of the component, null where none of its rows has one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import BROADCAST_KEYS, read, small_batches, written
from quillspark.llm.stars import components, looked_up
from quillspark.llm.wordhash import buffers

WORDS, SEED, BITS = 3, 42, 2
#: (shift, width) of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: (agreeing segment, segment of the codeword).
CASES = tuple((i, j) for i in range(3) for j in range(3) if i != j)
#: Distinct fingerprints under a key that are compared at once.
CROWD = 512
#: Bytes of a text that are hashed at a time.
STEP = 1 << 20
#: Rows of a comparison of fingerprints with fingerprints.
ROWS = 256
TASK_ROWS = 500_000
#: The generator polynomial of the Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator; words with the same one differ by a codeword."""
    left = words.astype(np.int64)
    for k in range(22, 10, -1):
        left = np.where(left >> k & 1, left ^ (GENERATOR << (k - 11)), left)
    return left


@lru_cache(1)
def nearby() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome, the differences to the codewords within four bits, the centre's first, and how many there are."""
    masks = np.array([sum(1 << b for b in bits) for n in range(5) for bits in combinations(range(23), n)], dtype=np.int64)
    by = syndromes(masks)
    order = np.argsort(by, kind="stable")  # by weight within a syndrome, as the masks are
    count = np.bincount(by, minlength=2048)
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    table = np.zeros((2048, int(count.max())), dtype=np.int64)
    place = np.arange(len(masks)) - np.repeat(first, count)
    table[by[order], place] = masks[order]
    return table, count


def codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, index, is the centre): the nearby codewords of 23-bit words, by their upper 12 bits."""
    table, count = nearby()
    s = syndromes(words)
    n = count[s]
    row = np.repeat(np.arange(len(words)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, (words[row] ^ table[s[row], place]) >> 11, place == 0


def _words_in(data: bytes) -> Iterator[list[bytes]]:
    """Words of a text in blocks; every block begins with the last ``WORDS - 1`` words of the one before."""
    at, kept = 0, []
    while at < len(data):
        to = at + STEP
        while to < len(data) and data[to] != 0x20 and not 9 <= data[to] <= 13:
            to += 1
        block = kept + data[at:to].translate(_LOWER).split()
        if to < len(data) and len(block) < WORDS:
            kept = block
        else:
            yield block
            kept = block[1 - WORDS :]
        at = to


def ones(data: bytes, seed: int = SEED) -> tuple[np.ndarray, int]:
    """Of the shingles of a text, how often every bit is set, and how many there are."""
    set_, n = np.zeros(64, dtype=np.int64), 0
    digest, short = xxhash.xxh64_intdigest, b""
    for block in _words_in(data):
        joined = b" ".join(block)
        if len(block) < WORDS:
            short = joined
            continue
        ends = np.cumsum([len(w) + 1 for w in block])
        starts = np.concatenate(([0], ends[:-WORDS])).tolist()
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends[WORDS - 1 :] - 1).tolist(), strict=True)], dtype="<u8")
        for k in range(0, len(h), 65536):
            set_ += np.unpackbits(h[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    if not n and short:
        h = np.array([digest(short, seed)], dtype="<u8")
        return np.unpackbits(h.view(np.uint8), bitorder="little").astype(np.int64), 1
    return set_, n


_PLACES = np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))


def fingerprint(data: bytes) -> int:
    """The bits that are set in over half of the shingles' hashes."""
    set_, n = ones(data)
    return int(_PLACES[2 * set_ > n].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, f): the fingerprint of every text as a signed number."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = buffers(b.column(1))
            found = np.array([fingerprint(data[x:y].tobytes()) for x, y in zip(offsets[:-1], offsets[1:], strict=True)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], ["k", "f"])

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(sign, "k long, f long")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(case, key, f, centre) of fingerprints f."""
    for b in batches:
        f = b.column(0).to_numpy()
        part = [f.view(np.uint64) >> np.uint64(s) & np.uint64((1 << w) - 1) for s, w in SEGMENTS]
        part = [p.astype(np.int64) for p in part]
        near = [codewords(p) for p in part]
        for c, (i, j) in enumerate(CASES):
            row, index, centre = near[j]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), c, np.int32)), pa.array(part[i][row] << 12 | index), pa.array(f[row]), pa.array(centre)], ["case", "key", "f", "centre"])


def _stars(f: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Of distinct fingerprints, (fingerprint, least of its part) for all that have a link and aren't the least."""
    order = np.argsort(f)
    f, centre = f[order], centre[order]
    u, middle = f.view(np.uint64), np.flatnonzero(centre)
    if not len(middle):
        return np.empty((0, 2), dtype=np.int64)
    a, b = [], []
    for lo in range(0, len(middle), ROWS):
        x, y = np.nonzero(np.bitwise_count(u[middle[lo : lo + ROWS]][:, None] ^ u) <= BITS)
        x = middle[lo + x]
        a.append(x[x != y])
        b.append(y[x != y])
    a, b = np.concatenate([*a, *b]), np.concatenate([*b, *a])
    low, before = np.arange(len(f)), None
    while before is None or (low != before).any():
        before = low.copy()
        np.minimum.at(low, a, before[b])
        low = low[low]
    own = np.flatnonzero(low != np.arange(len(f)))
    return np.column_stack((f[own], f[low[own]]))


def _star_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of groups of rows (group columns..., f, centre), which are sorted by group."""
    rest: pa.Table | None = None
    batches = iter(batches)
    while True:
        batch = next(batches, None)
        table = pa.Table.from_batches([batch]) if batch is not None else None
        if table is not None and rest is not None:
            table = pa.concat_tables([rest, table])
        elif table is None:
            table = rest
        if table is None or not table.num_rows:
            return
        names = table.column_names[:-2]
        new = np.zeros(table.num_rows, dtype=bool)
        new[0] = True
        for n in names:
            v = table[n].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        first = np.flatnonzero(new)
        # The last group may go on in the next batch.
        rest = None if batch is None else table.slice(first[-1])
        to = np.append(first[1:], table.num_rows) if batch is None else first[1:]
        f, centre = table["f"].to_numpy(), table["centre"].to_numpy(zero_copy_only=False)
        found = [s for x, y in zip(first, to, strict=False) if y - x > 1 and len(s := _stars(f[x:y], centre[x:y]))]
        if found:
            edges = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])
        if batch is None:
            return


#: Six pieces of seven or eight bits of what the agreeing segment leaves, by agreeing segment.
def _pieces(agreeing: int) -> list[list[int]]:
    bits = [s + k for n, (s, w) in enumerate(SEGMENTS) if n != agreeing for k in range(w)]
    return [bits[k::6] for k in range(6)]


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (case, key, f, centre) of crowded keys by every four of six pieces: (case, key, way, piece, f, centre)."""
    ways = list(combinations(range(6), 4))
    for b in batches:
        case, f = b.column(0).to_numpy(), b.column(2).to_numpy()
        u = f.view(np.uint64)
        for i in range(3):
            own = np.flatnonzero(np.isin(case, [c for c, (x, _) in enumerate(CASES) if x == i]))
            if not len(own):
                continue
            masks = [sum(1 << bit for bit in bits) for bits in _pieces(i)]
            rows = b.take(pa.array(own))
            for k, way in enumerate(ways):
                kept = u[own] & np.uint64(sum(masks[p] for p in way))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(np.full(len(own), k, np.int32)), pa.array(kept.view(np.int64)), rows.column(2), rows.column(3)], ["case", "key", "way", "piece", "f", "centre"])


def linked(distinct: DataFrame) -> DataFrame:
    """(a, b): stars that hang together as the links of distinct fingerprints f do."""
    keys = written(distinct.select("f").mapInArrow(_keys, "case int, key long, f long, centre boolean"), "golay-keys")
    spark = distinct.sparkSession
    counts = keys.groupBy("case", "key").agg(F.count(F.lit(1)).alias("members"))
    crowded = written(counts.where(F.col("members") > CROWD).drop("members"), "crowded-keys")
    held = F.broadcast(crowded) if crowded.count() <= BROADCAST_KEYS else crowded
    tasks = max(1, -(-keys.count() // TASK_ROWS), spark.sparkContext.defaultParallelism)
    few = keys.join(held, ["case", "key"], "left_anti").repartition(tasks, "case", "key").sortWithinPartitions("case", "key")
    many = keys.join(held, ["case", "key"], "left_semi").mapInArrow(_dealt, "case int, key long, way int, piece long, f long, centre boolean")
    many = many.repartition("case", "key", "way", "piece").sortWithinPartitions("case", "key", "way", "piece")
    return written(few.mapInArrow(_star_rows, "a long, b long").unionAll(many.mapInArrow(_star_rows, "a long, b long")), "stars")


def simhash_components(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per document: key, fingerprint (16 hexadecimal digits) and component_id."""
    small_batches(docs.sparkSession)
    signed = written(fingerprints(docs, key, text), "fingerprints")
    distinct = written(signed.groupBy("f").agg(F.min("k").alias("least"), F.count(F.lit(1)).alias("copies")), "distinct-fingerprints")
    roots = components(linked(distinct)).withColumnRenamed("v", "f")
    rooted = written(distinct.join(roots, "f", "left").withColumn("root", F.coalesce("root", "f")), "rooted")
    low = rooted.groupBy("root").agg(F.min("least").alias("m"), F.count(F.lit(1)).alias("n"))
    known = looked_up(rooted.select(F.col("root").alias("v"), "f", "copies"), low.withColumnRenamed("root", "v"), "f", "copies")
    rows = looked_up(signed.select(F.col("f").alias("v"), "k"), known.select(F.col("f").alias("v"), "m", F.col("copies").alias("n")), "k")
    return rows.select(F.col("k").alias(key), F.lower(F.lpad(F.hex("v"), 16, "0")).alias("fingerprint"), F.col("m").alias("component_id"))


def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their fingerprint and the least doc_id that links reach."""
    return simhash_components(read(spark, sf_dir, "documents"), "doc_id", "text")
