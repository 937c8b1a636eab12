"""Token counts with overlap resynchronisation.

Ordinary documents are encoded whole.  A document over ``2 * chunk`` characters is encoded in overlapping chunks with
offsets and the chunks' tokens are spliced at proven stable boundaries: no piece of the vocabulary has its word mark
behind another character (checked when the model is loaded), so no merge ever crosses a place where a space follows
another character, and both encodings of an overlap have a boundary there and agree around it.  An overlap without
such a place is widened until it has one or the text ends.  Memory for encoding is thus bounded by the chunk, not by
the document, except where a document has no such place at all.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import read, small_batches
from quillspark.llm.wordhash import slices

CHUNK = 32_768
OVERLAP = 256
LIMIT = 4096
_MARK = "▁"
_STABLE = re.compile(r"(?<=[^ ▁])[ ]")


@lru_cache(maxsize=2)
def processor(path: str):
    """The model, after the check that makes boundaries before a space stable."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    crossing = [p for p in map(model.id_to_piece, range(model.get_piece_size())) if _MARK in p.lstrip(_MARK)]
    if crossing:
        raise ValueError(f"pieces with a word mark inside: {crossing[:3]}")
    return model


def seam(text: str, at: int, overlap: int) -> int:
    """The first stable boundary at or after ``at``; the overlap is widened until it holds one or the text ends."""
    while at + overlap < len(text):
        found = _STABLE.search(text, at, at + overlap)
        if found:
            return found.start()
        overlap *= 2
    found = _STABLE.search(text, at)
    return found.start() if found else len(text)


def spliced(model, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[list[int]]:
    """The tokens of a long text from overlapping chunks, chunk by chunk.

    Chunk k is encoded from ``overlap`` before its first seam to ``overlap`` behind its last one, and gives the tokens
    that begin between the two seams.  If its encoding has no boundary at a seam, the overlap is doubled.
    """
    start = 0
    while start < len(text):
        end = seam(text, start + chunk, overlap) if start + chunk < len(text) else len(text)
        wide = overlap
        while True:
            a, b = max(0, start - wide), min(len(text), end + wide)
            found = model.encode(text[a:b], return_type="offset_mapping")
            # In a chunk that starts inside the text, the mark put before it belongs to no character of the text.
            pieces = [(at + a, i) for (at, _), i in zip(found["offsets"], found["ids"], strict=True)]
            begins = {p for p, _ in pieces}
            if (start == 0 or start in begins) and (end == len(text) or end in begins) or (a == 0 and b == len(text)):
                break
            wide *= 2
        yield [i for p, i in pieces if start <= p < end]
        start = end


def count_tokens(model, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    long = [k for k, t in enumerate(texts) if len(t) > 2 * chunk]
    skip = set(long)
    counts = [len(x) for x in model.encode(["" if k in skip else t for k, t in enumerate(texts)], return_type="numpy", num_threads=1)]
    for k in long:
        counts[k] = sum(map(len, spliced(model, texts[k], chunk, overlap)))
    return counts


def token_count(text: str | Column, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Number of tokens of every text of a column."""

    @F.arrow_udf("long")
    def count(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = processor(path)
        for texts in parts:
            out: list[int] = []
            for a, b in slices(texts):
                out += count_tokens(model, texts.slice(a, b - a).to_pylist(), chunk, overlap)
            yield pa.array(out, pa.int64())

    return count(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents with the pieces of ``piece_bpe_32k.model``."""
    import public_tokenizers

    small_batches(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    counted = docs.withColumn("n_tokens", token_count("text", public_tokenizers.path("piece_bpe_32k.model")))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return counted.select("doc_id", size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
