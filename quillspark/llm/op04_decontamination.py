"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Items fall into size classes: class u holds the items of more than u/2 and at most u shingles.  For every class a
document is covered by windows of 2u shingles, u apart, so that a passage of an item's size lies inside a window whose
size is at most four times its own, however long the document is.  At containment 0.8 the item and that window have
Jaccard similarity of 0.19 at least, and with ``minhashes`` bands of one row the pair is missed with probability
below 0.81 ** minhashes (4e-5 for 48).  Minima of the smallest blocks are merged pairwise into those of larger ones.
Items of up to ``FEW`` shingles must be contained whole, so that their least shingle is looked up itself.  Each candidate
is verified on all shingles of the document; very long documents are searched in parts that overlap by a window.

The searched items are a stated query set: they are read in blocks of bounded size, each broadcast on its own and
released before the next one where there are several; the documents are never shuffled.

Defined results: null and empty texts match nothing; an item of fewer than five words is one shingle and is found only
in documents of exactly these words; repeated documents and items give one row for each pair of rows; rows without a
key give rows with a null key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import SHINGLE_WORDS, SIMILARITY, read, small_batches, written
from quillspark.llm.minhash import multipliers, row_minima
from quillspark.llm.wordhash import shingles, slices, words

MINHASHES = 48
LEAST = 8
#: At the similarity asked for, items of so few shingles must be there whole.
FEW = 4
#: Shingles of a document that are searched at a time.
PART = 1 << 18
BLOCK_BYTES = 16 << 20
_BITS = 20


@dataclass
class ContainmentIndex:
    """Signatures and shingles of a block of items, by size class."""

    sets: list[np.ndarray]
    factors: np.ndarray
    keys: dict[int, np.ndarray]
    owners: dict[int, np.ndarray]
    filters: dict[int, np.ndarray]
    few: np.ndarray
    few_owners: np.ndarray

    @classmethod
    def build(cls, texts: pa.Array, minhashes: int = MINHASHES, least: float = SIMILARITY) -> ContainmentIndex:
        hashes, first = shingles(words(texts), SHINGLE_WORDS)
        sets = [np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
        factors = multipliers(minhashes)
        classes: dict[int, list[int]] = {}
        whole = [k for k, s in enumerate(sets) if 0 < len(s) <= FEW and (len(s) - 1) < least * len(s) - 1e-9]
        whole.sort(key=lambda k: sets[k][0])
        few = set(whole)
        for k, s in enumerate(sets):
            if len(s) and k not in few:
                classes.setdefault(max(LEAST, 1 << (len(s) - 1).bit_length()), []).append(k)
        keys, owners, filters = {}, {}, {}
        for u, members in sorted(classes.items()):
            starts = np.cumsum([0, *(len(sets[k]) for k in members[:-1])])
            minima = row_minima(np.concatenate([sets[k] for k in members]), starts, factors)
            key = (minima.astype(np.uint64) | (np.arange(minhashes, dtype=np.uint64) << np.uint64(32))[:, None]).reshape(-1)
            order = np.argsort(key, kind="stable")
            keys[u], owners[u] = key[order], np.tile(np.array(members), minhashes)[order]
            filters[u] = np.zeros((minhashes, 1 << _BITS), dtype=bool) if len(members) > 4096 else np.zeros((1, 1 << _BITS), dtype=bool)
            filters[u][(np.arange(minhashes) % len(filters[u]))[:, None], minima >> np.uint32(32 - _BITS)] = True
        return cls(sets, factors, keys, owners, filters, np.array([sets[k][0] for k in whole], np.uint64), np.array(whole, np.int64))

    def candidates(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Pairs (row, item) that may match; rows are ``hashes[first[i]:first[i + 1]]``."""
        if len(first) == 2 and len(hashes) > 2 * PART:
            wide = 2 * max(self.keys, default=0)
            step = max(PART, wide)
            return np.unique(np.concatenate([self._candidates(own, np.array([0, len(own)])) for at in range(0, len(hashes), step) for own in [hashes[at : at + step + wide]]]), axis=0)
        return self._candidates(hashes, first)

    def _candidates(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        number = np.diff(first)
        found = [np.empty((0, 2), dtype=np.int64)]
        if len(self.few):
            at = np.flatnonzero(np.isin(hashes, self.few))
            lo, hi = (np.searchsorted(self.few, hashes[at], side) for side in ("left", "right"))
            rows = np.searchsorted(first, at, side="right") - 1
            found += [np.column_stack((np.full(b - a, r), self.few_owners[a:b])) for r, a, b in zip(rows, lo, hi, strict=True)]
        blocks = -(-number // LEAST)
        ends = np.cumsum(blocks)
        row = np.repeat(np.arange(len(number)), blocks)
        place = np.arange(len(row)) - np.repeat(ends - blocks, blocks)
        minima = row_minima(hashes, first[:-1][row] + place * LEAST, self.factors)
        u, largest = LEAST, max(self.keys, default=0)
        while u <= largest and len(row):
            if u in self.keys:
                window = minima.copy()
                more = np.flatnonzero(row[1:] == row[:-1])
                window[:, more] = np.minimum(minima[:, more], minima[:, more + 1])
                table = self.filters[u]
                for k in range(len(self.factors)):
                    hit = np.flatnonzero(table[k % len(table)][window[k] >> np.uint32(32 - _BITS)])
                    key = window[k, hit].astype(np.uint64) | np.uint64(k << 32)
                    lo, hi = np.searchsorted(self.keys[u], key, "left"), np.searchsorted(self.keys[u], key, "right")
                    n = hi - lo
                    if n.any():
                        at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                        found.append(np.column_stack((np.repeat(row[hit], n), self.owners[u][at])))
            even = np.flatnonzero(place % 2 == 0)
            minima = np.minimum.reduceat(minima, even, axis=1)
            row, place = row[even], place[even] // 2
            u *= 2
        return np.unique(np.concatenate(found), axis=0)

    def verified(self, hashes: np.ndarray, first: np.ndarray, least: float = SIMILARITY) -> list[tuple[int, int, int]]:
        """(row, item, shared shingles) of the candidates whose containment is ``least`` or more."""
        out, last, own = [], -1, np.empty(0, np.uint64)
        for r, item in self.candidates(hashes, first).tolist():
            if r != last:
                last, own = r, np.unique(hashes[first[r] : first[r + 1]])
            q = self.sets[item]
            at = np.minimum(np.searchsorted(own, q), len(own) - 1)
            shared = int((own[at] == q).sum())
            if shared >= least * len(q) - 1e-9:
                out.append((r, item, shared))
        return out


def _indexes(items: DataFrame, key: str, text: str, least: float) -> Iterator[tuple[int, tuple[list, ContainmentIndex]]]:
    """(number of blocks, (keys, index)) for every block of items."""
    size = items.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64(key, text), F.lit(blocks)) == block).select(F.col(key).cast("long").alias("i"), F.col(text).alias("t")).toArrow()
        yield blocks, (own["i"].to_pylist(), ContainmentIndex.build(own["t"].combine_chunks(), least=least))


def contained_items(docs: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item_text: str, least: float = SIMILARITY) -> DataFrame:
    """Pairs (key, item_key) with n_shared, n_shingles and containment of the item in the document."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where("t is not null")
    parts = []
    for blocks, own in _indexes(items, item_key, item_text, least):
        held = spark.sparkContext.broadcast(own)

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, index = held.value
            for b in batches:
                for lo, hi in slices(b.column(1)):
                    keys = b.column(0).slice(lo, hi - lo)
                    found = index.verified(*shingles(words(b.column(1).slice(lo, hi - lo)), SHINGLE_WORDS), least)
                    if found:
                        r, i, n = zip(*found, strict=True)
                        columns = [keys.take(pa.array(r)), pa.array([ids[x] for x in i], pa.int64()), pa.array(n, pa.int64()), pa.array([len(index.sets[x]) for x in i], pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns, ["k", "i", "n", "m"])

        part = rows.mapInArrow(search, "k long, i long, n long, m long")
        if blocks > 1:
            part = written(part, "contained")
            held.destroy()
        parts.append(part)
    return reduce(DataFrame.unionAll, parts).select(
        F.col("k").alias(key), F.col("i").alias(item_key), F.col("n").alias("n_shared"), F.col("m").alias("n_shingles"), (F.col("n") / F.col("m")).alias("containment")
    )


def _leaks(held: Broadcast, least: float):
    @F.arrow_udf("boolean")
    def leaks(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in parts:
            out = np.zeros(len(column), dtype=bool)
            for lo, hi in slices(column):
                out[[lo + r for r, _, _ in held.value.verified(*shingles(words(column.slice(lo, hi - lo)), SHINGLE_WORDS), least)]] = True
            yield pa.array(out)

    return leaks


def without_items(docs: DataFrame, items: DataFrame, text: str, item_key: str, item_text: str, least: float = SIMILARITY) -> DataFrame:
    """The rows that contain none of the items; each row is judged by itself, whatever its key."""
    small_batches(docs.sparkSession)
    for blocks, (_, index) in _indexes(items, item_key, item_text, least):
        held = docs.sparkSession.sparkContext.broadcast(index)
        docs = docs.where(~_leaks(held, least)(F.col(text)))
        if blocks > 1:
            docs = written(docs, "free-of-items")
            held.destroy()
    return docs


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark items that any document contains."""
    return contained_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


_SHINGLED = """
    select distinct {key}, case when len(w) >= 5 then array_to_string(list_slice(w, i, i + 4), ' ') else array_to_string(w, ' ') end as s
    from (select {key}, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i
          from (select {key}, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as w from {table}) where len(w) > 0)"""

ORACLE_SQL = {
    "op4_decontamination": f"""
with d as ({_SHINGLED.format(key="doc_id", table="documents")}),
q as ({_SHINGLED.format(key="item_id", table="benchmark")}),
n as (select item_id, count(*) as m from q group by item_id),
c as (select d.doc_id, q.item_id, count(*) as n from d join q on d.s = q.s group by all)
select doc_id, c.item_id, n as n_shared, m as n_shingles, n / m as containment
from c join n on c.item_id = n.item_id where n >= 0.8 * m"""
}
