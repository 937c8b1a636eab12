"""Personal data: fixed patterns, and a linear-chain conditional random field that finds what they miss.

The field labels the words of a line with B-/I- of the kinds or O; besides the patterns' four kinds it knows secrets
(keys and tokens).  Its features are word shapes: the shape of the word and of its neighbours, numbers of digits and
characters, marks, and whether a word before names a secret.  It is trained by gradient ascent on the log-likelihood
(forward-backward in numpy) from a small labelled table: ``training_table()``, made of common spellings, and
``corpus_table()``, lines of the documents themselves around matches of the patterns, ``CORPUS_LINES`` at most.  It is
decoded by Viterbi in numpy batches of similar length.  What is decoded are the stretches of a line within ``AROUND``
words of a word with a digit or an at-sign, in parts of ``LONGEST`` words at most; a label span needs such a word, so all
other words are O by constraint.  A span that touches one of the patterns' spans is dropped: those stay as they are.

Positions are code points, ends exclusive.  Defined results: null and empty texts have no spans; repeated rows are
treated one by one; words of any length count whole.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import read, small_batches
from quillspark.llm.wordhash import slices

#: The kinds of the patterns, and what the field finds besides them.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
CORPUS_LINES = 400
AROUND, LONGEST = 8, 4096
LABELS = ("O", *(f"{p}-{k}" for k in ALL_KINDS for p in "BI"))

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LINE = re.compile(r"[^\n]+")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from the at-signs: linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        done = domain.end() if domain else at + 1
        if domain:
            yield start, done
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the fixed patterns, by kind and start."""
    out = [(0, a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((1, *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(digits := re.sub(r"[ -]", "", m.group())) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m.group())) <= 15:
                    out.append((3, *m.span()))
    return out


class _Classes(dict):
    """Letters as A or a, digits as 0, marks of the kinds as they are, all else as x."""

    def __missing__(self, c: int) -> int:
        return ord("x")


_CLASSES = _Classes({c: ord("A") for c in range(65, 91)} | {c: ord("a") for c in range(97, 123)} | {c: ord("0") for c in range(48, 58)} | {ord(c): ord(c) for c in "@.+-()/:="})
_RUNS = re.compile(r"(.)\1+")
_HEX = re.compile(r"[0-9a-fA-F]+")
_CUE = re.compile(r"(?i)token|secret|passw|passwd|pwd|api.?key|private.?key|bearer|credential")
_BINS = 1024
_TRIM = "\"'.,;:!?*#$%&|<>[]{}"


def _shape(word: str) -> str:
    """The classes of a word's characters, runs collapsed."""
    return _RUNS.sub(r"\1", word.strip(_TRIM).translate(_CLASSES))


def word_features(words: list[str]) -> np.ndarray:
    """Feature numbers, one row for each word of a line."""
    shape = [zlib.crc32(_shape(w).encode()) % _BINS for w in words]
    around = [_BINS - 1, *shape, _BINS - 2]
    out = np.empty((len(words), FEATURES_OF_A_WORD), dtype=np.int32)
    cue = -3
    for k, w in enumerate(words):
        bare = w.strip(_TRIM)
        digits = len(_DIGIT.findall(w))
        marks = ("@" in w) + 2 * ("." in bare) + 4 * w.startswith("+") + 8 * w.startswith("(")
        mixed = 0 if not digits or len(bare) < 16 else 1 if _HEX.fullmatch(bare) and digits < len(bare) else 2 if digits < len(bare) and bare.isascii() and bare.isalnum() else 3
        named = bool(_CUE.search(w)) and len(w) < 40
        out[k] = (
            shape[k], _BINS + around[k], 2 * _BINS + around[k + 2], 3 * _BINS + min(digits, 24), 3 * _BINS + 32 + min(len(w), 40), 3 * _BINS + 80 + marks,
            3 * _BINS + 96 + mixed, 3 * _BINS + 100 + (k - cue <= 2 or named),
        )
        cue = k if named else cue
    return out


FEATURES_OF_A_WORD = 8
N_FEATURES = 3 * _BINS + 104


def training_table(lines: int = 600, seed: int = 5) -> list[tuple[list[str], list[int]]]:
    """The small labelled table: lines of words with the labels of personal data in common spellings, and look-alikes."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    letters = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyzéäñ") for _ in range(r.randint(1, 11)))

    def plain() -> str:
        w = letters()
        w = w.capitalize() if r.random() < 0.15 else w.upper() if r.random() < 0.08 else w
        return w + r.choice(["", "", "", "", "", ",", ".", "!!", "***", "&&&", ";"])

    def number() -> str:
        return r.choice([
            digits(1), digits(2), str(r.randint(1900, 2030)), digits(3) + ",", "4.0.", "3.", f"{digits(1)}.{digits(2)}", "v" + digits(1) + "." + digits(1), "$" + digits(3),
            f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(2)}", digits(5), digits(6), digits(7) + "%", "0x" + digits(6), "@", "#" + digits(4),
            "page" + digits(2), letters() + digits(2) + letters() + letters(), "@" + letters(), "(" + digits(1) + ")", "BY-NC", digits(1) + "th", digits(1) + "/" + digits(2),
        ])

    def email() -> list[str]:
        return [f"{r.choice([letters(), letters() + '.' + digits(2), letters() + digits(3)])}@{r.choice([letters() + digits(1), letters()])}.{r.choice(['example.com', 'org', 'example', 'co.uk'])}"]

    def ip() -> list[str]:
        return [".".join(str(r.randint(0, 255)) for _ in range(4))]

    def card() -> list[str]:
        return r.choice([[digits(16)], [digits(16)], [digits(4), digits(4), digits(4), digits(4)], ["-".join(digits(4) for _ in range(4))], [digits(15)], [digits(13)]])

    def phone() -> list[str]:
        return r.choice([
            ["+1", f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"+{digits(2)}", digits(3), digits(7)],
            [f"{digits(3)}-{digits(3)}-{digits(4)}"], [f"+{digits(11)}"], [f"+{digits(2)}-{digits(3)}-{digits(6)}"], [f"{digits(3)}.{digits(3)}.{digits(4)}"],
        ])

    def secret() -> list[str]:
        some = lambda of, n: "".join(r.choice(of) for _ in range(n))
        value = r.choice([some("0123456789abcdef", r.choice([32, 40, 64])), some("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", r.randint(20, 48)), some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", r.randint(16, 32))])
        return [r.choice(["", '"', "'"]) + value + r.choice(["", '"', "'"])]

    table = []
    for _ in range(lines):
        words, labels = [], []
        for _ in range(r.randint(2, 8)):
            kind = r.randint(0, 8)
            if kind < 5:
                own = (email, ip, card, phone, secret)[kind]()
                if kind == 4 and r.random() < 0.8:
                    before = [r.choice(["token", "secret", "password", "api_key", "access_token", "key", "TOKEN", "Secret:", "apikey:"]), *r.choice([["="], [":"], [], ["is"]])]
                    words += before
                    labels += [0] * len(before)
                own[-1] += r.choice(["", "", "", "", ".", ",", "!!", "***", "###"])
                words += own
                labels += [1 + 2 * kind] + [2 + 2 * kind] * (len(own) - 1)
            elif kind < 7:
                words.append(number())
                labels.append(0)
            for _ in range(r.randint(1, 4)):
                words.append(plain())
                labels.append(0)
        table.append((words, labels))
    return table


@dataclass
class ChainModel:
    """Weights of (feature, label), of (label, next label) and of (first label)."""

    weights: np.ndarray
    steps: np.ndarray
    first: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        return self.weights[features].sum(axis=1)

    def viterbi(self, lines: list[np.ndarray], batch: int = 65_536) -> list[np.ndarray]:
        """Most probable labels of every line; lines of similar length are decoded together."""
        out: list[np.ndarray | None] = [None] * len(lines)
        order = sorted(range(len(lines)), key=lambda i: -len(lines[i]))
        at = 0
        while at < len(order):
            longest = len(lines[order[at]])
            own = order[at : at + max(1, batch // max(longest, 1))]
            at += len(own)
            length = np.array([len(lines[i]) for i in own])
            emitted = np.zeros((longest, len(own), len(LABELS)), dtype=np.float32)
            for k, i in enumerate(own):
                emitted[: length[k], k] = self.scores(lines[i])
            back = np.zeros((longest, len(own), len(LABELS)), dtype=np.int8)
            best = emitted[0] + self.first
            final = best.copy()
            for t in range(1, longest):
                live = int((length > t).sum())  # the first ones: lines are sorted by length
                trial = best[:live, :, None] + self.steps
                back[t, :live] = trial.argmax(axis=1)
                best = trial.max(axis=1) + emitted[t, :live]
                final[:live] = best
            label = final.argmax(axis=1)
            path = np.zeros((longest, len(own)), dtype=np.int8)
            for t in range(longest - 1, -1, -1):
                live = length > t
                path[t, live] = label[live]
                move = np.flatnonzero(live)
                label[move] = back[t, move, label[move]] if t else label[move]
            for k, i in enumerate(own):
                out[i] = path[: length[k], k]
        return out


def train(table: list[tuple[list[str], list[int]]], epochs: int = 60, rate: float = 0.5, ridge: float = 1e-3) -> ChainModel:
    """Maximises the conditional log-likelihood by AdaGrad on full batches of padded lines."""
    n = len(LABELS)
    longest = max(len(w) for w, _ in table)
    feats = np.zeros((len(table), longest, FEATURES_OF_A_WORD), dtype=np.int32)
    gold = np.zeros((len(table), longest), dtype=np.int64)
    mask = np.zeros((len(table), longest), dtype=bool)
    for k, (w, y) in enumerate(table):
        feats[k, : len(w)], gold[k, : len(w)], mask[k, : len(w)] = word_features(w), y, True
    weights, steps, first = np.zeros((N_FEATURES, n)), np.zeros((n, n)), np.zeros(n)
    seen = [np.full_like(a, 1e-6) for a in (weights, steps, first)]
    one = np.eye(n)
    size = mask.sum(axis=1)
    rows = np.arange(len(table))

    def logsum(a: np.ndarray, axis: int) -> np.ndarray:
        top = a.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for _ in range(epochs):
        emit = weights[feats].sum(axis=2)
        alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
        alpha[:, 0] = emit[:, 0] + first
        for t in range(1, longest):
            alpha[:, t] = logsum(alpha[:, t - 1, :, None] + steps, 1) + emit[:, t]
        for t in range(longest - 2, -1, -1):
            ahead = logsum(steps + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1, None], ahead, 0.0)
        total = logsum(alpha[rows, size - 1], 1)
        p = np.exp(alpha + beta - total[:, None, None]) * mask[..., None]
        diff = (one[gold] - p) * mask[..., None]
        g_w = np.zeros_like(weights)
        for f in range(FEATURES_OF_A_WORD):
            np.add.at(g_w, feats[..., f][mask], diff[mask])
        g_s = np.zeros_like(steps)
        for t in range(1, longest):
            live = mask[:, t]
            pair = alpha[live, t - 1, :, None] + steps + (emit[live, t] + beta[live, t])[:, None, :] - total[live, None, None]
            g_s -= np.exp(pair).sum(axis=0)
            np.add.at(g_s, (gold[live, t - 1], gold[live, t]), 1)
        for a, g, h in zip((weights, steps, first), (g_w, g_s, diff[:, 0].sum(axis=0)), seen, strict=True):
            g = g / len(table) - ridge * a
            h += g * g
            a += rate * g / np.sqrt(h)
    return ChainModel(weights.astype(np.float32), steps.astype(np.float32), first.astype(np.float32))


def _stretches(text: str) -> Iterator[list[re.Match]]:
    """Neighbouring words of a line of which each is at most AROUND words from one with a digit or an at-sign."""
    for line in _LINE.finditer(text):
        if not _TRIGGER.search(text, line.start(), line.end()):
            continue
        held: list[re.Match] = []
        last = None  # place in held of the last word with a trigger
        for m in _WORD.finditer(text, line.start(), line.end()):
            hit = _TRIGGER.search(text, m.start(), m.end()) is not None
            if last is not None and (len(held) - last > 2 * AROUND or len(held) >= LONGEST):
                yield held[: last + AROUND + 1]
                held, last = held[last + AROUND + 1 :], None
            held.append(m)
            if hit:
                if last is None:
                    held = held[-AROUND - 1 :]
                last = len(held) - 1
            elif last is None and len(held) > 4 * AROUND:
                held = held[-AROUND:]
        if last is not None:
            yield held[: last + AROUND + 1]


def added_spans(model: ChainModel, texts: list[str], known: list[list[Span]]) -> list[list[Span]]:
    """Spans that the field finds in every text and that touch none of the known ones; some thousand words are decoded at a time."""
    out: list[list[Span]] = [[] for _ in texts]
    place: list[int] = []
    words: list[list[re.Match]] = []
    held = 0
    for k, text in enumerate(texts):
        for own in _stretches(text) if _TRIGGER.search(text) else ():
            place.append(k)
            words.append(own)
            held += len(own)
            if held > 100_000:
                _decoded(model, texts, known, place, words, out)
                place, words, held = [], [], 0
    _decoded(model, texts, known, place, words, out)
    return out


def _decoded(model: ChainModel, texts: list[str], known: list[list[Span]], place: list[int], words: list[list[re.Match]], out: list[list[Span]]) -> None:
    lines = [word_features([m.group() for m in own]) for own in words]
    for k, own, labels in zip(place, words, model.viterbi(lines), strict=True):
        at = 0
        while at < len(labels):
            y = int(labels[at])
            to = at + 1
            if y:
                kind = (y - 1) // 2
                while to < len(labels) and labels[to] == 2 + 2 * kind:
                    to += 1
                a, b = own[at].start(), own[to - 1].end()
                inner = texts[k][a:b]
                a += len(inner) - len(inner.lstrip(_TRIM))
                b -= len(inner) - len(inner.rstrip(_TRIM))
                if a < b and _TRIGGER.search(texts[k], a, b) and not _touches(known[k], a, b):
                    out[k].append((kind, a, b))
            at = to


def _touches(spans: list[Span], a: int, b: int) -> bool:
    """Whether any of the spans, which are sorted within their kinds, overlaps a..b."""
    for kind in range(len(KINDS)):
        lo, hi = bisect_left(spans, (kind, 0, 0)), bisect_left(spans, (kind, b, 0))
        if hi > lo and spans[hi - 1][2] > a:
            return True
    return False


def corpus_table(docs: DataFrame, text: str, lines: int = CORPUS_LINES) -> list[tuple[list[str], list[int]]]:
    """Labelled lines of the documents: the words around matches of the patterns, labelled by them.

    Every match falls into one of ``lines`` places by the hash of its words, and the least of each place is taken, so
    that all documents take part and ``lines`` rows reach the driver at most.  Stretches with other long numbers, which
    the patterns can't judge, are left out.
    """

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(0)):
                best: dict[int, tuple[int, str, str]] = {}
                for t in batch.column(0).slice(lo, hi - lo).to_pylist():
                    spans = base_spans(t)
                    for own in _stretches(t) if spans else ():
                        labels, whole = _labelled(own, spans)
                        if not whole or not any(labels):
                            continue
                        words = " ".join(m.group() for m in own)
                        h = zlib.crc32(words.encode())
                        best[h % lines] = min(best.get(h % lines, (1 << 32, "", "")), (h, words, " ".join(map(str, labels))))
                rows = [(k, *v) for k, v in best.items()]
                kinds = [pa.int32(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)], ["place", "h", "words", "labels"])

    found = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")).where(F.col("t").rlike("[0-9@]"))
    least = found.mapInArrow(around, "place int, h long, words string, labels string").groupBy("place").agg(F.min(F.struct("h", "words", "labels")).alias("r"))
    rows = least.orderBy("place").collect()
    return [(r["r"]["words"].split(" "), [int(y) for y in r["r"]["labels"].split(" ")]) for r in rows]


def _labelled(words: list[re.Match], spans: list[Span]) -> tuple[list[int], bool]:
    """Labels of words by the spans that lie in them, and whether nothing is in doubt: words are 200 characters and 64 at most."""
    labels = [0] * len(words)
    own = sorted((a, b, k) for k, a, b in spans if words[0].start() <= a and b <= words[-1].end())
    for a, b, k in own:
        inside = [i for i, m in enumerate(words) if m.start() < b and m.end() > a]
        if any(labels[i] for i in inside):
            return labels, False
        for n, i in enumerate(inside):
            labels[i] = 1 + 2 * k + (n > 0)
    doubt = any(not y and len(_DIGIT.findall(m.group())) > 5 for y, m in zip(labels, words, strict=True))
    return labels, not doubt and len(words) <= 64 and all(m.end() - m.start() <= 200 for m in words)


def written_out(spans: list[Span]) -> str:
    return ",".join(f"{ALL_KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


RESULT = "struct<n_email: bigint, n_ip: bigint, n_card: bigint, n_phone: bigint, base: string, spans: string, n_spans: bigint, n_secret: bigint>"


def personal_data(df: DataFrame, text: str, model: ChainModel) -> Column:
    """Counts of the patterns' spans, these spans and all spans, as a struct."""
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def find(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in parts:
            rows = []
            for lo, hi in slices(column):
                texts = column.slice(lo, hi - lo).to_pylist()
                base = [base_spans(t) for t in texts]
                for own, more in zip(base, added_spans(held.value, texts, base), strict=True):
                    counts = [sum(k == i for k, _, _ in own) for i in range(len(KINDS))]
                    rows.append((*counts, written_out(own), written_out(own + more), len(own) + len(more), sum(ALL_KINDS[k] == "secret" for k, _, _ in more)))
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["n_email", "n_ip", "n_card", "n_phone", "base", "spans", "n_spans", "n_secret"])

    return find(F.coalesce(F.col(text), F.lit("")))


def mask(df: DataFrame, text: str, model: ChainModel) -> Column:
    """The text with every span replaced by its kind in brackets; null for null."""
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def replaced(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in parts:
            out: list[str | None] = []
            for lo, hi in slices(column):
                texts = column.slice(lo, hi - lo).to_pylist()
                base = [base_spans(t or "") for t in texts]
                for t, own, more in zip(texts, base, added_spans(held.value, [t or "" for t in texts], base), strict=True):
                    done, cut = 0, []
                    for a, b, k in sorted((a, b, k) for k, a, b in own + more):
                        if b > done:
                            cut += [t[done : max(a, done)], f"[{ALL_KINDS[k]}]"] if a >= done else []
                            done = b
                    out.append(t if t is None else "".join(cut) + t[done:])
            yield pa.array(out, pa.string())

    return replaced(F.col(text))


def fitted(docs: DataFrame, text: str) -> ChainModel:
    """The field trained on both tables."""
    small_batches(docs.sparkSession)
    return train([*training_table(), *corpus_table(docs, text)])


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.withColumn("found", personal_data(docs, "text", fitted(docs, "text")))
    return found.select(
        "doc_id", "found.n_email", "found.n_ip", "found.n_card", "found.n_phone", F.sha2("found.base", 256).alias("base_sha256"), "found.spans", "found.n_spans", "found.n_secret"
    )
