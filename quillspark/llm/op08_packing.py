"""Packing by best-fit decreasing.

Texts become token ids with an end id, through a cache of parts that is bounded in bytes; a document longer than the window is first cut into full windows, and what is
left of it is one more piece.  Pieces are dealt by hash, with their place among the rows so that equal rows do not meet,
into groups of about ``group_pieces`` and every group is packed by itself: longest piece first, each into the open window with the least room that still holds it, found by a segment
tree over the remaining capacities.  A group is bounded, so no task sees more than its share; with thousands of pieces
in a group the waste differs little from that of one group.

Defined results: a null or empty text is its end id alone; repeated rows are packed one by one; an empty table gives no
rows.  Sequence ids are unique, not gapless: the group in the high 32 bits, the window in the low ones.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import read, small_batches, written
from quillspark.llm.wordhash import slices

WINDOW = 4096
END_ID = 2
GROUP_PIECES = 16_384
SLICE = 3 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"

_PLAIN = re.compile(r"[\t-\r -~¡-ÿ]*")
#: How a tokenizer file must normalise and split for texts to be encoded by parts.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts longer than this are cut behind white space; no token crosses it.
LONG = 1 << 20
_CUT = re.compile(r"[ \n](?=[!-~])")

GAP, LETTER, DIGIT, OTHER = range(4)


def _kinds() -> np.ndarray:
    """GAP, LETTER, DIGIT or OTHER for every character of Latin-1."""
    of = lambda c: GAP if c.isspace() else LETTER if c.isalpha() else DIGIT if unicodedata.category(c)[0] == "N" else OTHER
    return np.array([of(chr(c)) for c in range(256)], dtype=np.uint8)


_KIND = _kinds()
_FOLD = np.array([c + 32 if 65 <= c < 91 else c for c in range(256)], dtype=np.uint8)


def split_parts(texts: list[str]) -> tuple[pa.LargeStringArray, np.ndarray]:
    """Lower-case parts of texts of Latin-1 characters, and ``first``: those of text i are ``first[i]:first[i + 1]``.

    A part is a contraction such as 's, a run of letters, one digit, or a run of other marks.
    """
    blob = "\n".join([*texts, "\n\n"]).encode()
    data = _FOLD[np.frombuffer(blob, np.uint8)]
    lead = np.flatnonzero(data >= 0xC2)
    follow = data[lead + 1]
    data[lead + 1] = np.where((data[lead] == 0xC3) & (follow < 0x9F) & (follow != 0x97), follow + 0x20, follow)
    kind = _KIND[data]
    kind[lead] = kind[lead + 1] = _KIND[((data[lead] & 3) << 6) | (data[lead + 1] & 63)]
    start = np.empty(len(data), dtype=bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= kind == DIGIT
    start &= (kind != GAP) & ((data & 0xC0) != 0x80)
    mark = np.flatnonzero(data[:-3] == 0x27)
    mark = mark[(mark == 0) | (kind[mark - 1] != OTHER)]
    a, b = data[mark + 1], data[mark + 2]
    one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
    two = ((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l")))
    start[mark[one | two] + 1] = False
    behind = np.concatenate((mark[one] + 2, mark[two] + 3))
    start[behind] |= kind[behind] == LETTER
    solid = kind != GAP
    places = np.flatnonzero(start[solid])
    offsets = np.append(places, np.count_nonzero(solid)).astype(np.int64)
    parts = pa.LargeStringArray.from_buffers(len(places), pa.py_buffer(offsets), pa.py_buffer(data[solid]))
    edges = np.cumsum([0, *(len(t.encode()) + 1 for t in texts)])
    return parts, np.searchsorted(np.flatnonzero(start), edges)


class PartTokenizer:
    """Ids of whole texts through a cache of parts, bounded in bytes.

    The tokenizer lower-cases, drops white space and never lets a token span two parts, so that a text's ids are its
    parts' ids in a row.  That is used for texts of Latin-1 characters without special strings, where the file's own
    rules are the ones known here; all others are encoded whole.
    """

    def __init__(self, path: str, cache_bytes: int = 64 << 20):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.encode_all = whole.encode_batch_fast
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        steps = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        suffix = (rules.get("model") or {}).get("end_of_word_suffix") or ""
        self.ends_word = np.zeros(whole.get_vocab_size(), dtype=bool)
        self.ends_word[[i for t, i in whole.get_vocab().items() if suffix and t.endswith(suffix)]] = True
        self.by_parts = bool(suffix) and (rules.get("normalizer") or {}).get("normalizers") == _NORMALIZER and steps[0].get("pattern") == {"Regex": _SPLIT} and not rules.get("post_processor")
        self.cache_bytes = cache_bytes
        self._clear()

    def _clear(self) -> None:
        """Parts as places in an array of ids: those of part k end at ends[k]; part 0 is the end id."""
        self.places: dict[str | None, int] = {None: 0}
        self.ids, self.ends, self.held = array("I", [END_ID]), array("q", [1]), 0

    def _learn(self, parts: list[str]) -> None:
        """Encodes some hundred parts as one text; a part's last token is one that ends a word."""
        for at in range(0, len(parts), 512):
            own = parts[at : at + 512]
            ids = np.array(self.encode_all([" ".join(own)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(own):
                raise ValueError("tokens of this file do not tell where words end")
            self.places.update(zip(own, range(len(self.ends), len(self.ends) + len(own)), strict=True))
            self.ends.frombytes((ends + len(self.ids)).astype(np.int64).tobytes())
            self.ids.frombytes(ids.tobytes())
            self.held += 170 * len(own) + sum(map(len, own)) + 4 * len(ids)

    def _by_parts(self, texts: list[str]) -> list[np.ndarray]:
        parts, first = split_parts(texts)
        coded = parts.dictionary_encode()
        names = coded.dictionary.to_pylist()
        if self.held > self.cache_bytes:
            self._clear()
        if new := [p for p in names if p not in self.places]:
            self._learn(new)
        place = np.fromiter(map(self.places.__getitem__, names), np.int64, len(names))
        at = np.insert(place[coded.indices.to_numpy()], first[1:], 0)
        first = first + np.arange(len(first))
        ends = np.frombuffer(self.ends, np.int64)
        begins = np.concatenate(([0], ends[:-1]))
        size = (ends - begins)[at]
        total = np.concatenate(([0], np.cumsum(size)))
        ids = np.frombuffer(self.ids, np.uint32)[np.repeat(begins[at] - total[:-1], size) + np.arange(total[-1])].astype("<u4")
        cut = total[first]
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def _one(self, text: str) -> np.ndarray:
        """A long text in pieces that end with white space."""
        out, at = [], 0
        while at < len(text):
            found = _CUT.search(text, at + LONG)
            to = found.end() if found else len(text)
            out.append(self([text[at:to]])[0][:-1])
            at = to
        return np.concatenate([*out, np.array([END_ID], "<u4")])

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text, with the end id."""
        out: list[np.ndarray | None] = [None] * len(texts)
        plain, other = [], []
        for k, t in enumerate(texts):
            if self.by_parts and len(t) > LONG and _CUT.search(t, LONG):
                out[k] = self._one(t)
            else:
                (plain if self.by_parts and _PLAIN.fullmatch(t) and "<|" not in t else other).append(k)
        for k, ids in zip(plain, self._by_parts([texts[k] for k in plain]), strict=True):
            out[k] = ids
        for k, e in zip(other, self.encode_all([texts[k] for k in other], add_special_tokens=False), strict=True):
            out[k] = np.array([*e.ids, END_ID], dtype="<u4")
        return out


@lru_cache(maxsize=1)
def tokenizer(path: str) -> PartTokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return PartTokenizer(path)


def tokenized(df: DataFrame, key: str, text: str, path: str, window: int = WINDOW) -> DataFrame:
    """Pieces of all rows: full windows first, the rest last; each id lies in exactly one piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path)
        for b in batches:
            keys = b.column(0).to_pylist()
            for lo, hi in slices(b.column(1), SLICE):
                rows: list[tuple] = []
                for k, ids in zip(keys[lo:hi], encode(b.column(1).slice(lo, hi - lo).to_pylist()), strict=True):
                    rows += [(k, a, len(p := ids[a : a + window]), zlib.crc32(p.tobytes()), len(ids)) for a in range(0, len(ids), window)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    small_batches(df.sparkSession)
    return df.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(cut, PIECES)


def best_fit(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of every piece, in the order given (longest first for best fit decreasing).

    ``tree`` counts open windows by remaining capacity; its leftmost leaf at or right of a length is the tightest fit.
    """
    leaves = 1 << window.bit_length()
    tree = [0] * (2 * leaves)
    open_at: list[list[int]] = [[] for _ in range(window + 1)]
    filled: list[int] = []
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)

    def add(room: int, by: int) -> None:
        node = leaves + room
        while node:
            tree[node] += by
            node >>= 1

    def tightest(least: int) -> int:
        node = leaves + least
        if tree[node]:
            return least
        while node > 1:
            if not node & 1 and tree[node + 1]:
                node += 1
                while node < leaves:
                    node = 2 * node if tree[2 * node] else 2 * node + 1
                return node - leaves
            node >>= 1
        return -1

    for k, n in enumerate(lengths.tolist()):
        room = tightest(n)
        if room < 0:
            w, room = len(filled), window
            filled.append(0)
        else:
            w = open_at[room].pop()
            add(room, -1)
        where[k], offset[k] = w, filled[w]
        filled[w] += n
        if room > n:
            open_at[room - n].append(w)
            add(room - n, 1)
    return where, offset


def packed(pieces: DataFrame, window: int = WINDOW, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to pieces."""
    groups = max(1, round(pieces.count() / group_pieces))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        where, offset = best_fit(rows["length"].to_numpy(), window)
        return rows.assign(sequence_id=(rows["grp"].to_numpy().astype(np.int64) << 32) + where, offset=offset).drop(columns="grp")

    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("grp").applyInPandas(pack, PIECES + ", sequence_id long, offset long")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 4096 ids of ``word_bpe_49k.json``."""
    import public_tokenizers

    docs = read(spark, sf_dir, "documents")
    pieces = tokenized(docs, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"))
    return packed(written(pieces, "pieces"))
