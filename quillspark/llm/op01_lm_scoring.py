"""LM scoring with an interpolated modified Kneser-Ney bigram model.

Counting is Spark work: tasks count their own rows, pack what they found into one block for each shard, and a shard
merges its blocks.  Three rounds do it: the vocabulary (word hash -> count); the bigrams, whose shards also yield the
numbers of followers met once, twice and more often by context; the numbers of distinct predecessors of every word,
from the merged bigrams.  Shards are ranges of a 64-bit hash, as many as the bytes of the input ask for.  Contexts that
make up more than 1/256 of all tokens (so at most 256, and the start of a text) are salted over 64 places.

Each shard is one file of sorted hash arrays for each of three tables in the shared folder, written once under a
temporary name and renamed, so that a retried task does no harm.  Scoring tasks map these files into memory, at most
``OPEN_FILES`` at a time, and look up the sorted distinct words and bigrams of some megabytes of text at a time; nothing
of the model is broadcast but a few totals and the hot contexts.  Totals are summed in Spark; the driver gets three rows
of them and at most 256 hot words.

Order 2 is what the disk budget holds; see the README.  Defined results: a null or empty text is its end alone; with
no training rows every count is 0 and both scores are those of the uniform distribution over the unknown token.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import fold, read, scratch, small_batches, written
from quillspark.llm.wordhash import mix, slices, words

SHARD_BYTES = 16 << 20
SALTS = 64
HOT_PARTS = 256
FLUSH_TOKENS = 4_000_000
BLOCK_TOKENS = 1_000_000
#: Files of the model that a worker holds open.
OPEN_FILES = 128
END = np.uint64(0xE2D0E2D0E2D0E2D1)
START = np.uint64(0x57A2757A2757A271)


def bigram_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(v * np.uint64(0xD6E8FEB86659FD93) + w)


def route(v: np.ndarray, w: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The hash that places a bigram: its context's, or one of SALTS for a hot context."""
    at = np.minimum(np.searchsorted(hot, v), len(hot) - 1)
    with np.errstate(over="ignore"):
        return np.where(hot[at] == v, mix(v + (w % np.uint64(SALTS) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), v)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of the hash: sorted hashes have sorted shards."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _small(values: np.ndarray) -> bytes:
    """Counts as bytes, with 255 for those that follow in full."""
    big = values[values >= 255]
    return np.uint64(len(big)).tobytes() + np.minimum(values, 255).astype(np.uint8).tobytes() + big.astype(np.uint64).tobytes()


def _unsmall(blob: memoryview, n: int) -> tuple[np.ndarray, memoryview]:
    big = int(np.frombuffer(blob[:8], np.uint64)[0])
    values = np.frombuffer(blob[8 : 8 + n], np.uint8).astype(np.uint64)
    end = 8 + n + 8 * big
    values[values == 255] = np.frombuffer(blob[8 + n : end], np.uint64)
    return values, blob[end:]


def _pack_words(keys: np.ndarray, counts: np.ndarray) -> bytes:
    return np.uint64(len(keys)).tobytes() + keys.tobytes() + _small(counts)


def _unpack_words(blob: memoryview) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob[:8], np.uint64)[0])
    return np.frombuffer(blob[8 : 8 + 8 * n], np.uint64), _unsmall(blob[8 + 8 * n :], n)[0]


def _pack_pairs(v: np.ndarray, w: np.ndarray, counts: np.ndarray) -> bytes:
    """Runs of equal contexts, followers, counts."""
    head = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
    runs = np.diff(np.append(head, len(v)))
    return np.array([len(head), len(v)], np.uint64).tobytes() + v[head].tobytes() + w.tobytes() + _small(runs) + _small(counts)


def _unpack_pairs(blob: memoryview) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    heads, n = map(int, np.frombuffer(blob[:16], np.uint64))
    v, w = np.frombuffer(blob[16 : 16 + 8 * heads], np.uint64), np.frombuffer(blob[16 + 8 * heads : 16 + 8 * (heads + n)], np.uint64)
    runs, rest = _unsmall(blob[16 + 8 * (heads + n) :], heads)
    return np.repeat(v, runs.astype(np.int64)), w, _unsmall(rest, n)[0]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, their sums, and where each of them was first."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    head = np.flatnonzero(np.concatenate((np.ones(min(1, len(k)), bool), k[1:] != k[:-1])))
    return k[head], np.add.reduceat(counts[order], head) if len(head) else counts[:0], order[head]


def _narrow(counts: np.ndarray) -> np.ndarray:
    most = counts.max(initial=0)
    return counts.astype(np.uint8 if most < 256 else np.uint16 if most < 65536 else np.uint64)


def _kinds(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3, 4, and more than 2."""
    return [*(int((counts == k).sum()) for k in (1, 2, 3, 4)), int((counts > 2).sum())]


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens, of the tokens before them, and ``first`` of every row: its words, then its end."""
    w = words(texts, fold=True)
    token = np.insert(w.hashes, w.first[1:], END)
    first = w.first + np.arange(len(w.first))
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[first[:-1]] = START
    return token, before, first


@dataclass(frozen=True)
class Store:
    """Files of arrays in the shared folder; other than local ones are fetched once for each host and mapped there."""

    folder: str

    @property
    def local(self) -> str | None:
        path = self.folder
        if path.startswith("file:"):
            path = "/" + path[5:].lstrip("/")
        return path if path.startswith("/") else None

    def save(self, name: str, columns: dict[str, np.ndarray]) -> None:
        """The names, types and lengths of the arrays as JSON, then the arrays, each from a multiple of 8 bytes."""
        head = json.dumps([[c, a.dtype.str, len(a)] for c, a in columns.items()]).encode()
        head += b" " * (-len(head) % 8)
        blobs = [np.uint64(len(head)).tobytes(), head, *(x for a in columns.values() for x in (a.tobytes(), b"\0" * (-a.nbytes % 8)))]
        if self.local:
            os.makedirs(self.local, exist_ok=True)
            own = f"{self.local}/.{uuid.uuid4().hex}"
            with open(own, "wb") as out:
                out.writelines(blobs)
            os.replace(own, f"{self.local}/{name}")
            return
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.folder)
        own = f"{path}/{name}.{uuid.uuid4().hex}.tmp"
        with system.open_output_stream(own) as out:
            for blob in blobs:
                out.write(blob)
        system.move(own, f"{path}/{name}")

    def load(self, name: str) -> dict[str, np.ndarray]:
        """The mapped arrays of a file; none for a shard that got nothing."""
        path = f"{self.local}/{name}" if self.local else self._fetched(name)
        if not os.path.exists(path):
            return {}
        data = np.memmap(path, np.uint8, "r")
        at = 8 + int(data[:8].view(np.uint64)[0])
        out = {}
        for column, kind, n in json.loads(bytes(data[8:at])):
            size = n * np.dtype(kind).itemsize
            out[column] = data[at : at + size].view(kind)
            at += size + -size % 8
        return out

    def _fetched(self, name: str) -> str:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.folder)
        own = f"{tempfile.gettempdir()}/{self.folder.rstrip('/').rsplit('/', 1)[-1]}"
        os.makedirs(own, exist_ok=True)
        if not os.path.exists(f"{own}/{name}") and system.get_file_info(f"{path}/{name}").is_file:
            part = f"{own}/.{uuid.uuid4().hex}"
            with open(part, "wb") as out, system.open_input_stream(f"{path}/{name}") as source:
                while block := source.read(8 << 20):
                    out.write(block)
            os.replace(part, f"{own}/{name}")
        return f"{own}/{name}"


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of items counted one to four times."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    out = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.0 for k in (1, 2, 3)]
    return tuple(min(max(d, 0.0), float(k + 1)) for k, d in enumerate(out))


@dataclass
class KneserNey:
    """What a scoring task needs besides the mapped arrays."""

    folder: str
    shards: int
    n_tokens: int
    n_words: int
    hot: np.ndarray
    hot_kinds: np.ndarray
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    pair_types: int
    word_kinds: list[int]
    start_total: int
    _open: OrderedDict = field(default_factory=OrderedDict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_open": OrderedDict()}

    def _shard(self, name: str) -> dict[str, np.ndarray]:
        """The arrays of a file; the file used longest ago is closed for it."""
        if name in self._open:
            self._open.move_to_end(name)
        else:
            while len(self._open) >= OPEN_FILES:
                self._open.popitem(last=False)
            self._open[name] = Store(self.folder).load(name)
        return self._open[name]

    def _find(self, places: np.ndarray, keys: np.ndarray, table: str, columns: tuple[str, ...], key: str = "keys") -> np.ndarray:
        """Columns of the given keys, 0 where there is none; keys are sorted within their shard's range."""
        out = np.zeros((len(columns), len(keys)), dtype=np.uint64)
        shard = shard_of(places, self.shards)
        order = np.lexsort((keys, shard))
        in_order = shard[order]
        cuts = np.append(np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), in_order[1:] != in_order[:-1]))), len(keys))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            own = order[lo:hi]
            arrays = self._shard(f"{table}-{in_order[lo]}")
            known = arrays.get(key, keys[:0])
            if len(known):
                at = np.minimum(np.searchsorted(known, keys[own]), len(known) - 1)
                hit = known[at] == keys[own]
                for c, name in enumerate(columns):
                    out[c, own[hit]] = arrays[name][at[hit]]
        return out

    @cached_property
    def _unknown(self) -> float:
        """Probability mass of the words' model that is spread evenly over all words and the unknown one."""
        if not self.pair_types:
            return 1.0
        return sum(d * n for d, n in zip(self.word_discounts, self.word_kinds, strict=True)) / self.pair_types

    def score(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """n_tokens, n_known, base_score and score of every row; a row of many tokens is scored in blocks of them."""
        token, before, first = tokens(texts)
        out = np.zeros((3, len(first) - 1))
        for lo in range(0, len(token), BLOCK_TOKENS):
            hi = min(lo + BLOCK_TOKENS, len(token))
            a, b = np.searchsorted(first, lo, side="right") - 1, np.searchsorted(first, hi)
            own = np.array(self._token_scores(token[lo:hi], before[lo:hi]))
            out[:, a:b] += np.add.reduceat(own, np.maximum(first[a:b], lo) - lo, axis=1)
        return {"n_tokens": np.diff(first), "n_known": out[0].astype(np.int64), "base_score": out[1], "score": out[2]}

    def _token_scores(self, token: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every token whether it is known, the logarithm of its share, and that of its probability."""
        w, w_at = np.unique(token, return_inverse=True)
        count = self._find(w, w, "words", ("counts",))[0].astype(np.int64)
        before_count = self._find(w, w, "before", ("counts",))[0].astype(np.int64)
        even = 1 / (self.n_words + 1)
        take = lambda c, d: np.where(c > 0, np.array((0.0, *d))[np.minimum(c, 3)], 0.0)
        p_word = self._unknown * even + (before_count - take(before_count, self.word_discounts)) / max(self.pair_types, 1)
        pair, pair_first, pair_at = np.unique(bigram_hash(before, token), return_index=True, return_inverse=True)
        v, own = before[pair_first], token[pair_first]
        c = self._find(route(v, own, self.hot), pair, "pairs", ("counts",))[0].astype(np.int64)
        v_known, v_at = np.unique(v, return_inverse=True)
        kinds = self._find(v_known, v_known, "pairs", ("once", "twice", "more"), "contexts").astype(np.float64)
        at = np.minimum(np.searchsorted(self.hot, v_known), len(self.hot) - 1)
        is_hot = self.hot[at] == v_known
        kinds[:, is_hot] = self.hot_kinds[:, at[is_hot]]
        total = self._find(v_known, v_known, "words", ("counts",))[0].astype(np.int64)
        total = np.where(v_known == START, self.start_total, total)
        back = np.where(total > 0, (np.array(self.pair_discounts) @ kinds) / np.maximum(total, 1), 1.0)
        seen = np.maximum(total, 1)[v_at]
        p = (c - take(c, self.pair_discounts)) / seen + back[v_at] * p_word[np.searchsorted(w, own)]
        base = np.log10((count + 1) / (self.n_tokens + self.n_words + 1))
        return (count > 0)[w_at], base[w_at], np.log10(p)[pair_at]


def _by_shard(keys: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    cuts = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cuts)):
        yield int(s), slice(cuts[s], cuts[s + 1])


def _blocks(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], ["shard", "block"])


def _gathered(batches: Iterator[pa.RecordBatch], pairs: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(token, token before) of up to FLUSH_TOKENS tokens of a task at a time."""
    held, n = [], 0
    for b in batches:
        for lo, hi in slices(b.column(0)):
            token, before, _ = tokens(b.column(0).slice(lo, hi - lo))
            held.append((token, before if pairs else token[:0]))
            n += len(token)
            if n >= FLUSH_TOKENS:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def train(docs: DataFrame, text: str) -> KneserNey:
    """Counts all rows and writes the model's arrays to the shared folder."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t"))
    size, n_rows = rows.agg(F.sum(F.octet_length("t")), F.count(F.lit(1))).first()
    shards = max(8, -(-(size or 0) // SHARD_BYTES))
    folder = scratch(spark, "kneser-ney")

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, _ in _gathered(batches, False):
            keys, counts = np.unique(token, return_counts=True)
            yield _blocks([(s, _pack_words(keys[x], counts[x])) for s, x in _by_shard(keys, shards)])

    def merged_words(table: str):
        def merge(key: tuple, group: pa.Table) -> pa.Table:
            s = key[0].as_py()
            parts = [_unpack_words(memoryview(b.as_buffer())) for b in group["block"].combine_chunks() if b.is_valid]
            if s < 0:  # what the merged pairs told about themselves
                return group.select(["kind", "stats"])
            keys, counts, _ = _summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
            Store(folder).save(f"{table}-{s}", {"keys": keys, "counts": _narrow(counts)})
            out = [[len(keys), int(counts.sum()), *_kinds(counts)]]
            top = np.flatnonzero(counts * HOT_PARTS > counts.sum()) if table == "words" else []  # hot ones are among these, 256 at most
            out += [[int(keys[k].view(np.int64)), int(counts[k])] for k in top]
            return pa.table({"kind": pa.array([table] + ["top"] * len(top)), "stats": pa.array(out, pa.list_(pa.int64()))})

        return merge

    def totals(found: DataFrame) -> dict[str, list[int]]:
        sums = found.where("kind in ('words', 'before', 'pairs')").groupBy("kind").agg(*(F.sum(F.get("stats", F.lit(k))).alias(f"s{k}") for k in range(7)))
        return {r[0]: list(r[1:]) for r in sums.collect()}

    counted = rows.mapInArrow(count_words, "shard int, block binary").groupBy("shard").applyInArrow(merged_words("words"), "kind string, stats array<long>")
    counted = written(counted, "word-totals")
    n_words, n_tokens = totals(counted).get("words", [0, 0])[:2]
    top = counted.where("kind = 'top'").select(F.get("stats", F.lit(0)).alias("k"), F.get("stats", F.lit(1)).alias("n")).where(F.col("n") * HOT_PARTS > n_tokens).collect()
    hot = np.unique(np.array([START, *(np.int64(r["k"]).view(np.uint64) for r in top)], dtype=np.uint64))

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, before in _gathered(batches, True):
            _, at, counts = np.unique(bigram_hash(before, token), return_index=True, return_counts=True)
            v, w = before[at], token[at]
            place = route(v, w, hot)
            order = np.lexsort((v, place))
            v, w, counts, place = v[order], w[order], counts[order], place[order]
            yield _blocks([(s, _pack_pairs(v[x], w[x], counts[x])) for s, x in _by_shard(place, shards)])

    def merge_pairs(key: tuple, group: pa.Table) -> pa.Table:
        s = key[0].as_py()
        parts = [_unpack_pairs(memoryview(b.as_buffer())) for b in group["block"].combine_chunks()]
        v, w, c = (np.concatenate([p[k] for p in parts]) for k in range(3))
        del parts
        keys, counts, at = _summed(bigram_hash(v, w), c)
        v, w = v[at], w[at]
        contexts, index = np.unique(v, return_inverse=True)
        kinds = np.array([np.bincount(index[x], minlength=len(contexts)) for x in (counts == 1, counts == 2, counts > 2)]).astype(np.uint32)
        is_hot = hot[np.minimum(np.searchsorted(hot, contexts), len(hot) - 1)] == contexts
        columns = {"keys": keys, "counts": _narrow(counts), "contexts": contexts[~is_hot]} | dict(zip(("once", "twice", "more"), kinds[:, ~is_hot], strict=True))
        Store(folder).save(f"pairs-{s}", columns)
        stats = [[len(keys), int(counts.sum()), *_kinds(counts)], *np.column_stack((contexts[is_hot].view(np.int64), kinds[:, is_hot].T)).tolist()]
        word, n = np.unique(w, return_counts=True)
        blocks = [(t, _pack_words(word[x], n[x])) for t, x in _by_shard(word, shards)]
        none = [None] * len(blocks)
        return pa.table({
            "shard": pa.array([-1 - s] * len(stats) + [t for t, _ in blocks], pa.int32()), "block": pa.array([None] * len(stats) + [b for _, b in blocks], pa.binary()),
            "kind": pa.array(["pairs", *["hot"] * (len(stats) - 1), *none], pa.string()), "stats": pa.array([*stats, *none], pa.list_(pa.int64())),
        })

    pairs = rows.mapInArrow(count_pairs, "shard int, block binary").groupBy("shard").applyInArrow(merge_pairs, "shard int, block binary, kind string, stats array<long>")
    found = written(pairs.groupBy("shard").applyInArrow(merged_words("before"), "kind string, stats array<long>"), "pair-totals")
    hot_kinds = np.zeros((3, len(hot)))
    for r in found.where("kind = 'hot'").groupBy(F.get("stats", F.lit(0)).alias("k")).agg(*(F.sum(F.get("stats", F.lit(k))) for k in (1, 2, 3))).collect():
        hot_kinds[:, np.searchsorted(hot, np.int64(r[0]).view(np.uint64))] = r[1:]
    total = totals(found)
    of_pairs, before = total.get("pairs", [0] * 7), total.get("before", [0] * 7)
    return KneserNey(
        folder, shards, n_tokens, n_words, hot, hot_kinds, discounts(of_pairs[2:6]), discounts(before[2:6]), of_pairs[0], [before[2], before[3], before[6]], n_rows,
    )


def scored(df: DataFrame, text: str, model: KneserNey) -> DataFrame:
    """Adds n_tokens, n_known, base_score and score, in place of columns of these names."""
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<n_tokens: bigint, n_known: bigint, base_score: double, score: double>")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kinds = {"n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
        for column in parts:
            own = [held.value.score(column.slice(lo, hi - lo)) for lo, hi in slices(column, 4 << 20)]
            arrays = [pa.array(np.concatenate([o[k] for o in own]) if own else [], t) for k, t in kinds.items()]
            yield pa.StructArray.from_arrays(arrays, list(kinds))

    new = ["n_tokens", "n_known", "base_score", "score"]
    found = df.withColumn("__scored", score(F.coalesce(F.col(text), F.lit(""))))
    return found.withColumns({c: F.col("__scored")[c] for c in new}).drop("__scored")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents with the model of those whose fold is not 2."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(fold("doc_id", 7) == 2, F.lit(False))
    model = train(docs.where(~held), "text")
    out = scored(docs.select("doc_id", "text", held.alias("held_out")), "text", model)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
