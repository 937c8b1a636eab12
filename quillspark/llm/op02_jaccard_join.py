"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

Documents with the same set of five-word shingles are one class and enter the join once, whatever their keys.  A class
has ``TREES`` times ``DEPTH`` minima; a tree is a prefix trie of one group of them, held as sorted rows.  Matches start
at full depth.  Each verified pair of similarity J counts with the inverse of the probability that a prefix of that
depth finds it, which estimates how many pairs there are and which share of them any shorter prefix finds; matched
prefixes are then shortened to the longest that reaches the target recall (``shortened``), at most to the one that
reaches it even if every pair had the least similarity (``prefix_depth``).  Pairs met at full depth aren't met again.

Under prefixes of up to ``SMALL`` classes the pairs are listed and joined with their sets of shingles.  Larger prefixes
are cut into blocks of about ``BLOCK`` classes, every pair of blocks is one row group that carries the sets, and all its
pairs are verified there by products of incidence matrices; a pair that shares several large prefixes counts under the
first.  Verification is exact in both.  Verified links make components by alternating star contraction; only ids move
there.  Work in a large prefix grows with the square of its classes, as the links do, but is spread by pairs of blocks.

Defined results: null and empty texts have no shingles, link to nothing and are their own class; a text of fewer than
five words is one shingle; repeated texts share class and links and are counted in n_copies; rows that repeat a key with
other texts are joined by their texts; class_id is the least key in the component, null where no row of it has one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import BROADCAST_KEYS, SHINGLE_WORDS, SIMILARITY, read, small_batches, written
from quillspark.llm.minhash import distinct_per_row, multipliers, row_minima
from quillspark.llm.stars import components
from quillspark.llm.wordhash import mix, shingles, slices, words

TREES, DEPTH = 16, 8
RECALL = 0.9995
#: The estimated share of missed pairs must be that many times less than the recall allows: the pairs of a group are
#: missed together, so their number varies more than that of single pairs.
SAFETY = 5
SMALL = 24
#: Classes, and shingles, of a block of a large prefix.
BLOCK, BLOCK_SHINGLES = 512, 1_000_000
#: Columns of an incidence matrix at a time.
COLUMNS = 8192
TASK_ROWS = 100_000


def prefix_depth(similarity: float = SIMILARITY, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix with which ``trees`` trees find a pair of the given similarity with the recall asked for."""
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return depth


def found_at(j, depth: int):
    """The probability that a prefix of that depth finds a pair of similarity ``j`` in any tree."""
    return 1 - (1 - j**depth) ** TREES


def _weights(j: np.ndarray) -> list[float]:
    """What pairs found at full depth tell: how many there are in all, and how many of them prefixes of 1 to DEPTH find."""
    full = found_at(j, DEPTH)
    return [float((found_at(j, d) / full).sum()) if d else float((1 / full).sum()) for d in range(DEPTH + 1)]


def shortened(weights: DataFrame, least: float, recall: float) -> int:
    """The longest prefix that reaches the recall on the pairs there are, judged by ``weights`` of those found at full depth.

    One pair of the least similarity is added to them, so that where little was found the bound for any data decides.
    The estimated share of missed pairs is multiplied by SAFETY.
    """
    sums = weights.where("weights is not null").agg(*(F.sum(F.get("weights", F.lit(d))) for d in range(DEPTH + 1))).first()
    total, *found = [(s or 0.0) + w for s, w in zip(sums, _weights(np.array([least])), strict=True)]
    floor = prefix_depth(least, recall)
    return max((d for d in range(floor, DEPTH + 1) if found[d - 1] / total >= 1 - (1 - recall) / SAFETY), default=floor)


def _sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return distinct_per_row(*shingles(words(texts), SHINGLE_WORDS))


def _digests(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each row's set; 0 for the empty set."""
    out = []
    with np.errstate(over="ignore"):
        for salt in (1, 2):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes + np.uint64(salt * 0x9E3779B9)), dtype=np.uint64)))
            out.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
    return out[0], out[1]


def _signed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """k, d1, d2, n (shingles) and the signature, tree by tree, big-endian so that bytes sort like minima."""
    factors = multipliers(TREES * DEPTH)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(1)):
                hashes, first = _sets(b.column(1).slice(lo, hi - lo))
                d1, d2 = _digests(hashes, first)
                n = np.diff(first)
                full = np.flatnonzero(n)
                signature = np.zeros((len(n), len(factors)), dtype=">u4")
                signature[full] = row_minima(hashes, first[:-1][full], factors).T
                blobs = pa.Array.from_buffers(pa.binary(signature.shape[1] * 4), len(n), [None, pa.py_buffer(signature.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(d1), pa.array(d2), pa.array(n, pa.int64()), blobs], ["k", "d1", "d2", "n", "s"])

    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return rows.mapInArrow(sign, "k long, d1 long, d2 long, n long, s binary")


def _neighbours(least: float):
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All pairs of ids under a common prefix, of rows (id, size, tree, hash of the prefix) sorted by tree and hash."""
        own = list(batches)
        if sum(b.num_rows for b in own) < 2:
            return
        table = pa.Table.from_batches(own)
        c, n, tree, p = (table[x].to_numpy() for x in ("c", "n", "tree", "p"))
        bucket = np.concatenate(([0], np.cumsum((tree[1:] != tree[:-1]) | (p[1:] != p[:-1]))))
        found = []
        for d in range(1, len(c)):
            near = np.flatnonzero(bucket[d : len(c)] == bucket[: len(c) - d])
            if not len(near):
                break
            x, y = n[near], n[near + d]
            near = near[np.minimum(x, y) >= least * np.maximum(x, y) - 1e-9]
            found.append(np.column_stack((c[near], c[near + d])))
        if found:
            pairs = np.concatenate(found)
            pairs = np.unique(np.sort(pairs, axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return pairs


def _shared(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets numbered ``x`` with those numbered ``y``."""
    out = np.zeros((len(x), len(y)), dtype=np.float32)
    left, right = ([sets[i] for i in rows] for rows in (x, y))
    common = np.intersect1d(np.concatenate(left), np.concatenate(right))
    sides = []
    for part in (left, right):
        hashes, row = np.concatenate(part), np.repeat(np.arange(len(part)), [len(h) for h in part])
        at = np.minimum(np.searchsorted(common, hashes), max(len(common) - 1, 0))
        own = common[at] == hashes if len(common) else np.zeros(len(hashes), bool)
        order = np.argsort(at[own], kind="stable")
        sides.append((at[own][order], row[own][order], len(part)))
    for lo in range(0, len(common), COLUMNS):
        wide = min(COLUMNS, len(common) - lo)
        ones = []
        for at, row, n in sides:
            f, t = np.searchsorted(at, (lo, lo + wide))
            m = np.zeros((n, wide), dtype=np.float32)
            m[row[f:t], at[f:t] - lo] = 1
            ones.append(m)
        out += ones[0] @ ones[1].T
    return out


def _block_links(least: float, again: bool):
    """Of two blocks of a large prefix, every linked class with its partners and the least class of its part; the first one has the weights."""

    def links(table: pa.Table) -> pa.Table:
        c, side = table["c"].to_numpy(), table["side"].to_numpy()
        tree, within = table["tree"][0].as_py(), table["i"][0] == table["j"][0]
        by_tree = lambda name: table[name].combine_chunks().flatten().fill_null(0).to_numpy().reshape(len(c), TREES)
        at = by_tree("at")
        sets = [np.frombuffer(h, np.uint64) for x in table["set"].chunks for h in (v.as_buffer() for v in x)]
        n = np.array([len(h) for h in sets])
        x, y = (np.arange(len(c)),) * 2 if within else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        open_ = c[x][:, None] < c[y] if within else c[x][:, None] != c[y]
        for t in range(tree):
            open_ &= (at[x, t][:, None] != at[y, t]) | (at[x, t] == 0)[:, None]
        if again:
            deep = by_tree("deep")
            for t in range(TREES):
                open_ &= deep[x, t][:, None] != deep[y, t]
        open_ &= np.minimum(n[x][:, None], n[y]) >= least * np.maximum(n[x][:, None], n[y]) - 1e-9
        rows, columns = open_.any(axis=1), open_.any(axis=0)
        x, y, open_ = x[rows], y[columns], open_[rows][:, columns]
        if not len(x):
            return pa.table({"v": pa.array([], pa.int64()), "near": pa.array([], pa.list_(pa.int64())), "weights": pa.array([], pa.list_(pa.float64())), "low": pa.array([], pa.int64())})
        shared = _shared(sets, x, y).astype(np.float64)
        i, j = np.nonzero(open_ & (shared >= least * (n[x][:, None] + n[y] - shared) - 1e-9))
        weights = _weights(shared[i, j] / (n[x[i]] + n[y[j]] - shared[i, j]))
        a, b = np.concatenate((x[i], y[j])), np.concatenate((y[j], x[i]))
        low, before = c.copy(), None
        while before is None or (low != before).any():
            before = low.copy()
            np.minimum.at(low, a, before[b])
        order = np.argsort(a, kind="stable")
        own, first = np.unique(a[order], return_index=True)
        near = pa.ListArray.from_arrays(pa.array(np.append(first, len(a)), pa.int32()), pa.array(c[b[order]]))
        return pa.table({"v": pa.array(c[own]), "near": near, "weights": pa.array([weights, *[None] * (len(own) - 1)][: len(own)], pa.list_(pa.float64())), "low": pa.array(low[own])})

    return links


def _similarity(least: float):
    """Of pairs (a, b) with their sets, those that are similar; the first of a batch has the weights."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = np.zeros(batch.num_rows)
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                alike[k] = shared / (len(x) + len(y) - shared)
            own = np.flatnonzero(alike >= least - 1e-9)
            weights = pa.array([_weights(alike[own]), *[None] * (len(own) - 1)][: len(own)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), batch.column(1).take(pa.array(own)), weights], ["a", "b", "weights"])

    return similar


@dataclass
class _Forest:
    """The classes (c, rep, d1, d2, n, n_copies, s) of the documents, and what is verified so far."""

    docs: DataFrame
    key: str
    text: str
    classes: DataFrame
    least: float
    sets: DataFrame | None = None

    def _prefix(self, tree: Column, depth: int) -> Column:
        return F.xxhash64(tree, F.substring("s", (tree * 4 * DEPTH + 1).cast("int"), F.lit(4 * depth)))

    def _collected(self, wanted: DataFrame) -> DataFrame:
        """(c, set) of the wanted classes, from the documents that carry the keys of their representatives."""
        if self.sets is not None:
            wanted = wanted.join(self.sets.select("c").distinct(), "c", "left_anti")
        named = written(self.classes.join(wanted, "c", "left_semi").select("c", "rep", "d1", "d2", "n"), "wanted")
        few = named.count() <= BROADCAST_KEYS // 4
        held = F.broadcast(named) if few else named
        rows = self.docs.select(F.col(self.key).cast("long").alias("k"), F.col(self.text).alias("t"))
        rows = rows.join(held.select("rep"), F.col("k").eqNullSafe(F.col("rep")), "left_semi").select("t")

        def collect_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo, hi in slices(b.column(0)):
                    hashes, first = _sets(b.column(0).slice(lo, hi - lo))
                    d1, d2 = _digests(hashes, first)
                    blobs = [hashes[x:y].tobytes() for x, y in zip(first[:-1], first[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(d1), pa.array(d2), pa.array(np.diff(first), pa.int64()), pa.array(blobs, pa.binary())], ["d1", "d2", "n", "set"])

        found = rows.mapInArrow(collect_sets, "d1 long, d2 long, n long, set binary").join(held.drop("rep"), ["d1", "d2", "n"]).select("c", "set")
        found = written(found, "sets").dropDuplicates(["c"])
        self.sets = found if self.sets is None else self.sets.unionAll(found)
        return self.sets

    def met_at(self, depth: int, before: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(listed, packed, pairs): similar pairs (a, b), similar pairs by class from large prefixes, and the pairs looked at.

        ``before`` has the pairs listed at full depth, which are left out.
        """
        trees = self.classes.select("c", "n", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "s")
        cells = trees.select("c", "n", "tree", self._prefix(F.col("tree"), depth).alias("p"))
        counted = cells.groupBy("tree", "p").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("total")).where(F.col("members") > SMALL)
        blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("total") / BLOCK_SHINGLES)).cast("int")
        large = written(counted.select("tree", "p", blocks.alias("blocks")), "large-prefixes")
        held = F.broadcast(large) if large.count() <= BROADCAST_KEYS else large
        tasks = max(1, -(-self.classes.count() * TREES // TASK_ROWS), self.docs.sparkSession.sparkContext.defaultParallelism)
        small = cells.join(held, ["tree", "p"], "left_anti").select("c", "n", "tree", "p").repartition(tasks, "tree", "p").sortWithinPartitions("tree", "p", "c")
        pairs = small.mapInArrow(_neighbours(self.least), "a long, b long").distinct()
        pairs = written(pairs if before is None else pairs.join(before, ["a", "b"], "left_anti"), "candidates")
        places = cells.join(held, ["tree", "p"]).select("c", "tree", "p", "blocks").dropDuplicates(["c", "tree"])
        places = written(places.groupBy("c").agg(F.collect_list(F.struct("tree", "p", "blocks")).alias("places")), "places")
        sets = self._collected(written(pairs.select(F.explode(F.array("a", "b")).alias("c")).union(places.select("c")).distinct(), "candidate-classes"))
        left, right = sets.select(F.col("c").alias("a"), F.col("set").alias("x")), sets.select(F.col("c").alias("b"), F.col("set").alias("y"))
        # Pairs that share a large prefix are verified in its blocks.
        met = places.select("c", F.transform("places", lambda x: x["p"]).alias("p"))
        open_ = pairs.join(met.select(F.col("c").alias("a"), F.col("p").alias("p_a")), "a", "left").join(met.select(F.col("c").alias("b"), F.col("p").alias("p_b")), "b", "left")
        open_ = open_.where(~F.coalesce(F.arrays_overlap("p_a", "p_b"), F.lit(False))).select("a", "b")
        checked = open_.join(left, "a").join(right, "b").select("a", "b", "x", "y")
        listed = written(checked.mapInArrow(_similarity(self.least), "a long, b long, weights array<double>"), "links")
        every = F.sequence(F.lit(0), F.lit(TREES - 1))
        by_tree = F.map_from_entries(F.transform("places", lambda x: F.struct(x["tree"], x["p"])))
        at = F.transform(every, lambda t: F.try_element_at(by_tree, t)).alias("at")
        if before is None:
            dealt = places.withColumn("deep", F.array().cast("array<long>"))
        else:
            dealt = places.join(self.classes.select("c", F.transform(every, lambda t: self._prefix(t, DEPTH)).alias("deep")), "c")
        dealt = dealt.select("c", "deep", at, F.explode("places").alias("place")).join(sets, "c").select("c", "deep", "at", "set", "place.*")
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        side = (F.col("own") > F.col("other")).cast("int").alias("side")
        dealt = dealt.select("tree", "p", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side, "c", "at", "deep", "set")
        found = dealt.groupBy("tree", "p", "i", "j").applyInArrow(_block_links(self.least, before is not None), "v long, near array<long>, weights array<double>, low long")
        return listed, written(found, "block-links"), pairs


def jaccard_join(docs: DataFrame, key: str, text: str, least: float = SIMILARITY, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """(membership, links): one row per document, and the verified pairs of class representatives (a <= b).

    membership has the key, class_id (least key of the component), n_links (verified links of its text to other
    texts) and n_copies (rows with the same shingles).
    """
    small_batches(docs.sparkSession)
    signed = written(_signed(docs, key, text), "signatures")
    same = signed.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("k").alias("rep"), F.count(F.lit(1)).alias("n_copies"), F.first("s").alias("s"))
    classes = written(same.withColumn("c", F.monotonically_increasing_id()), "classes")
    forest = _Forest(docs, key, text, classes, least)
    listed, packed, pairs = forest.met_at(DEPTH, None)
    depth = shortened(listed.select("weights").unionAll(packed.select("weights")), least, recall)
    if depth < DEPTH:
        more, more_packed, _ = forest.met_at(depth, pairs)
        listed, packed = listed.unionAll(more), packed.unionAll(more_packed)
    links = listed.select("a", "b").unionAll(packed.select(F.col("v").alias("a"), F.explode(F.filter("near", lambda x: x > F.col("v"))).alias("b")))
    number = listed.select(F.explode(F.array("a", "b")).alias("c"), F.lit(1).alias("n")).unionAll(packed.select(F.col("v").alias("c"), F.size("near").alias("n")))
    degree = number.groupBy("c").agg(F.sum("n").alias("n_links"))
    roots = components(listed.select("a", "b").unionAll(packed.where("v != low").select(F.col("v").alias("a"), F.col("low").alias("b")))).withColumnRenamed("v", "c")
    known = classes.drop("s").join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    known = known.join(known.groupBy("root").agg(F.min("rep").alias("class_id")), "root").join(degree, "c", "left")
    known = known.select("d1", "d2", "n", "n_copies", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    member = signed.drop("s").join(known, ["d1", "d2", "n"], "left").select(
        F.col("k").alias(key), F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("k")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(1)).alias("n_copies")
    )
    keys = classes.select("c", "rep")
    links = links.join(keys.toDF("a", "x"), "a").join(keys.toDF("b", "y"), "b")
    return member, links.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their near-duplicate class: five words, similarity 0.8."""
    return jaccard_join(read(spark, sf_dir, "documents"), "doc_id", "text")[0]
