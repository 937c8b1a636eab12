"""Language identification: a bidirectional gated recurrent network over bytes.

Two GRUs read windows of bytes in either direction; at every byte a softmax over both states labels the language, and a
document's probabilities are the means over all its bytes.  The network is trained in numpy by backpropagation through
time with Adam.  Windows of a batch run in step, feature-major, so that each step is a few operations on wide arrays.

Training uses the distinct texts with the smallest hashes, at most ``MAX_DOCS`` of every language, and as many excerpts
of each, spread evenly over the whole text, as let all languages together have ``MAX_CHARS`` characters; each language
has the same share.  Prediction reads every byte of every text in windows of ``WINDOW``.

Defined results: ``und`` and score 0.0 for null texts and texts without a letter; also where nothing was learned; with
one learned language it is always that one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import BROADCAST_KEYS, fold, read, small_batches, written
from quillspark.llm.wordhash import buffers, slices

HIDDEN = 8
WINDOW = 128
BATCH = 4096
MAX_DOCS = 400
MAX_CHARS = 16_000_000
EXCERPT, MAX_EXCERPTS = 256, 10


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


@dataclass
class ByteGru:
    """Parameters: ``w`` (3H x 256 input columns, one set for each direction), ``u`` (3H x H), ``b`` (H, added to the
    recurrent part of the candidate), ``v`` (K x 2H) and ``c`` (K).  Gates are stacked as reset, update, candidate."""

    languages: list[str]
    w: np.ndarray
    u: np.ndarray
    b: np.ndarray
    v: np.ndarray
    c: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 3) -> ByteGru:
        r = np.random.Generator(np.random.PCG64(seed))
        draw = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        k = len(languages)
        return cls(languages, draw(2, 3 * hidden, 256, scale=0.3), draw(2, 3 * hidden, hidden, scale=0.35), np.zeros((2, hidden), np.float32), draw(k, 2 * hidden, scale=0.3), np.zeros(k, np.float32))

    def states(self, direction: int, x: np.ndarray, live: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (T, H, B) behind every byte of ``x`` (T, B), read in the given direction; padding keeps the state 0."""
        steps, n = x.shape
        h = self.u.shape[2]
        table = np.ascontiguousarray(self.w[direction].T)
        u, b = self.u[direction], self.b[direction][:, None]
        out = np.empty((steps, h, n), dtype=np.float32)
        state = np.zeros((h, n), dtype=np.float32)
        for t in range(steps) if direction == 0 else range(steps - 1, -1, -1):
            a = np.ascontiguousarray(table[x[t]].T)
            r = u @ state
            gates = _sigmoid(a[: 2 * h] + r[: 2 * h])
            inner = r[2 * h :] + b
            cand = np.tanh(a[2 * h :] + gates[:h] * inner)
            new = cand + gates[h:] * (state - cand)
            if keep is not None:
                keep.append((t, state, gates, inner, cand))
            state = new if live[t].all() else np.where(live[t], new, 0)
            out[t] = state
        return out

    def probabilities(self, x: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Sums (K, B) over the bytes of each window of the probabilities of every byte."""
        h = self.u.shape[2]
        ahead, behind = self.states(0, x, live), self.states(1, x, live)
        total = np.zeros((len(self.c), x.shape[1]), dtype=np.float32)
        for t in range(len(x)):
            z = self.v[:, :h] @ ahead[t]
            z += self.v[:, h:] @ behind[t]
            z += self.c[:, None]
            z -= z.max(axis=0)
            np.exp(z, out=z)
            z /= z.sum(axis=0)
            total += z if live[t].all() else z * live[t]
        return total

    def gradients(self, x: np.ndarray, live: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over bytes, and its gradients by backpropagation through time."""
        h, n = self.u.shape[2], x.shape[1]
        kept: tuple[list, list] = ([], [])
        states = [self.states(d, x, live, kept[d]) for d in (0, 1)]
        both = np.concatenate(states, axis=1)
        z = np.einsum("kh,thb->tkb", self.v, both, optimize=True) + self.c[:, None]
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        weight = live / max(int(live.sum()), 1)
        loss = -float((np.log(np.take_along_axis(p, y[None, None, :].repeat(len(x), 0), 1)[:, 0] + 1e-12) * weight).sum())
        d = p
        d[:, y, np.arange(n)] -= 1
        d *= weight[:, None, :]
        g_v, g_c = np.einsum("tkb,thb->kh", d, both, optimize=True), d.sum(axis=(0, 2))
        d_state = np.einsum("kh,tkb->thb", self.v, d, optimize=True)
        g_w, g_u, g_b = np.zeros_like(self.w), np.zeros_like(self.u), np.zeros_like(self.b)
        for direction in (0, 1):
            carry = np.zeros((h, n), dtype=np.float32)
            part = d_state[:, direction * h : (direction + 1) * h]
            for t, state, gates, inner, cand in reversed(kept[direction]):
                g = (carry + part[t]) * live[t]
                r, s = gates[:h], gates[h:]
                d_cand = g * (1 - s) * (1 - cand**2)
                d_s = g * (state - cand) * s * (1 - s)
                d_r = d_cand * inner * r * (1 - r)
                recurrent = np.concatenate((d_r, d_s, d_cand * r))
                g_u[direction] += recurrent @ state.T
                g_b[direction] += (d_cand * r).sum(axis=1)
                np.add.at(g_w[direction].T, x[t], np.concatenate((d_r, d_s, d_cand)).T)
                carry = self.u[direction].T @ recurrent + g * s
        return loss, [g_w, g_u, g_b, g_v.astype(np.float32), g_c.astype(np.float32)]

    def predict(self, texts: pa.Array, window: int = WINDOW) -> np.ndarray:
        """Mean probabilities (rows, K) over all bytes of every text; 0 for empty ones."""
        data, offsets = buffers(texts)
        size = np.diff(offsets)
        number = -(-size // window)
        row = np.repeat(np.arange(len(size)), number)
        place = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
        start = offsets[:-1][row] + place * window
        length = np.minimum(size[row] - place * window, window)
        order = np.argsort(-length, kind="stable")
        out = np.zeros((len(size), len(self.languages)))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            steps = int(length[own[0]])
            live = np.arange(steps)[:, None] < length[own]
            x = data[np.minimum(start[own] + np.arange(steps)[:, None], len(data) - 1)]
            np.add.at(out, row[own], self.probabilities(x, live).T)
        return out / np.maximum(size, 1)[:, None]


def _capitals(data: np.ndarray) -> np.ndarray:
    """The bytes with a-z and the accented letters of Latin-1 in upper case."""
    out = data.copy()
    out[(data >= 97) & (data < 123)] -= 32
    accented = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0xA0) & (data[1:] != 0xB7)) + 1
    out[accented] -= 32
    return out


def fit(texts: list[str], languages: list[str], updates: int = 300, window: int = 64, batch: int = 192, rate: float = 0.02, seed: int = 9) -> ByteGru:
    """Trains on windows drawn in turn by language from the given texts."""
    names = sorted(set(languages))
    model = ByteGru.fresh(names)
    pool = [np.frombuffer("\n".join(t for t, g in zip(texts, languages, strict=True) if g == name).encode(), np.uint8) for name in names]
    r = np.random.Generator(np.random.PCG64(seed))
    moments = None
    for step in range(1, updates + 1):
        y = ((step - 1) * batch + np.arange(batch)) % len(names)
        x = np.zeros((window, batch), dtype=np.uint8)
        live = np.zeros((window, batch), dtype=bool)
        for k in range(batch):
            data = pool[y[k]]
            at = int(r.integers(0, max(1, len(data) - window)))
            own = data[at : at + window]
            x[: len(own), k], live[: len(own), k] = _capitals(own) if r.random() < 0.15 else own, True
        _, grads = model.gradients(x, live, y)
        parameters = [model.w, model.u, model.b, model.v, model.c]
        moments = moments or [(np.zeros_like(a), np.zeros_like(a)) for a in parameters]
        pace = rate * min(1.0, 2 * (1 - step / (updates + 1)))
        for a, g, (m, s) in zip(parameters, grads, moments, strict=True):
            g = np.clip(g, -1, 1)
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            a -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return model


def train(docs: DataFrame, text: str, lang: str, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> ByteGru | None:
    """Learns all languages of the rows, from ``max_docs`` texts of each at most, and ``max_chars`` characters of all together."""
    small_batches(docs.sparkSession)
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(text).alias("t"), F.col(lang).alias("g"))
    mixed = labelled.withColumn("h", F.xxhash64("t"))
    texts = written(mixed.groupBy("g", "h").agg(F.count(F.lit(1)).alias("n")), "language-texts")
    number = written(texts.groupBy("g").agg(F.count(F.lit(1)).alias("texts")), "languages")
    share = max_chars // EXCERPT // max(1, number.count())
    each = max(1, min(max_docs, share))
    excerpts = max(1, min(MAX_EXCERPTS, share // each))
    # Hashes below a bound that leaves many times the texts wanted, so that ranking sees few texts of large languages.
    bound = 2 * F.least(F.lit(1.0), F.lit(8.0 * max(each, 8)) / F.col("texts"))
    few = texts.select("g", "h").join(number, "g").where(F.col("h") / 2.0**63 + 1 <= bound)
    smallest = written(few.select("g", "h").withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("h"))).where(F.col("n") <= each).select("g", "h"), "smallest")
    held = F.broadcast(smallest) if smallest.count() <= BROADCAST_KEYS else smallest
    chosen = mixed.join(held, ["g", "h"]).dropDuplicates(["g", "h"])
    place = lambda k: F.floor((k + 0.5) * F.length("t") / excerpts - EXCERPT / 2).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.lit(excerpts - 1)), lambda k: F.substring("t", F.greatest(place(k), F.lit(0)) + 1, F.lit(EXCERPT)))
    rows = chosen.select("g", "h", F.when(F.length("t") <= EXCERPT * excerpts, F.col("t")).otherwise(F.array_join(cut, "\n")).alias("t")).orderBy("g", "h").collect()
    return fit([r["t"] for r in rows], [r["g"] for r in rows]) if rows else None


def language(df: DataFrame, text: str, model: ByteGru | None) -> Column:
    """struct<lang, score> of every text."""
    if model is None:
        return F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"))
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang: string, score: double>")
    def predict(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in parts:
            p = [held.value.predict(column.slice(lo, hi - lo)) for lo, hi in slices(column)]
            p = np.concatenate(p) if p else np.zeros((0, len(held.value.languages)))
            best = p.argmax(axis=1)
            names = pa.array([held.value.languages[k] for k in best], pa.string())
            yield pa.StructArray.from_arrays([names, pa.array(np.clip(p.max(axis=1, initial=0), 0, 1))], ["lang", "score"])

    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    found = predict(F.coalesce(F.col(text), F.lit("")))
    return F.when(lettered, found).otherwise(F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those whose fold is not 1."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(fold("doc_id", 3) != 1), "text", "lang")
    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    found = docs.select("doc_id", held.alias("held_out"), language(docs, "text", model).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
