"""Operators against brute-force versions on odd tables; empty tables; held-out accuracy on given ones."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

import corpus_pipeline
from quillspark import llm
from quillspark.llm import op01_lm_scoring, op02_jaccard_join, op03_url_filter, op04_decontamination, op05_quality_rules, op06_pii, op08_packing, op09_language_id, op10_token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
QUERIES = llm.queries()


def fold(key, n):
    return None if key is None else zlib.crc32(str(key).encode()) % n


def collect(spark, name, folder):
    return [r.asDict() for r in QUERIES[name](spark, folder).collect()]


def by_text(rows):
    return Counter(map(repr, rows))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert collect(spark, name, empty) == []


def shingle_set(text, n=5):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def test_lm_scores(spark, odd, odd_docs):
    got = collect(spark, "op1_lm_scoring", odd)
    assert len(got) == len(odd_docs)
    fold_case = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    tokens = lambda t: [*WORD.findall(fold_case(t or "")), None]
    train = [tokens(d["text"]) for d in odd_docs if fold(d["doc_id"], 7) != 2]
    c, pairs, before, after = Counter(w for t in train for w in t), Counter(p for t in train for p in zip(["<s>", *t], t)), Counter(), defaultdict(list)
    for (v, w), n in pairs.items():
        before[w] += 1
        after[v].append(n)
    n_all, kinds = sum(c.values()), len(c)
    cut = lambda counts: op01_lm_scoring.discounts([sum(x == k for x in counts.values()) for k in (1, 2, 3, 4)])
    d2, d1 = cut(pairs), cut(before)
    rest = sum(d1[min(x, 3) - 1] for x in before.values()) / len(pairs)

    def word(w):
        return (before[w] - d1[min(before[w], 3) - 1] if before[w] else 0) / len(pairs) + rest / (kinds + 1)

    def follow(v, w):
        if v not in after:
            return word(w)
        total, x = sum(after[v]), pairs[v, w]
        return (x - d2[min(x, 3) - 1] if x else 0) / total + sum(d2[min(k, 3) - 1] for k in after[v]) / total * word(w)

    assert sum(follow("the", w) for w in c) + follow("the", object()) == pytest.approx(1)
    expected = defaultdict(list)
    for d in odd_docs:
        t = tokens(d["text"])
        expected[d["doc_id"]].append((len(t), sum(c[w] > 0 for w in t), sum(math.log10((c[w] + 1) / (n_all + kinds + 1)) for w in t), sum(math.log10(follow(v, w)) for v, w in zip(["<s>", *t], t))))
    for r in got:
        e = next(x for x in expected[r["doc_id"]] if x[0] == r["n_tokens"])
        assert (r["n_tokens"], r["n_known"]) == e[:2] and r["train_tokens"] == n_all and r["held_out"] == (fold(r["doc_id"], 7) == 2)
        assert (r["base_score"], r["score"]) == pytest.approx(e[2:], rel=1e-9)


def test_jaccard_join(spark, odd, odd_docs):
    got = collect(spark, "op2_jaccard_join", odd)
    assert len(got) == len(odd_docs)
    sets = {d["doc_id"]: shingle_set(d["text"]) for d in odd_docs if d["doc_id"] is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    for r in got:
        if r["doc_id"] is not None:
            assert r["class_id"] == find(r["doc_id"])
    assert op02_jaccard_join.prefix_depth() == 4


def test_jaccard_recall_of_near_copies(spark):
    import random

    r = random.Random(2)
    rows, links = [], set()
    for g in range(60):
        words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(r.randint(60, 300))]
        for k in range(3):
            own = words.copy()
            for _ in range(k * len(own) // 120):
                own[r.randrange(len(own))] = "edit"
            rows.append((3 * g + k, " ".join(own)))
    by_set = {}
    for i, t in rows:
        by_set.setdefault(shingle_set(t), i)
    sets = {i: s for s, i in by_set.items()}
    for i in sets:
        for j in (x for x in range(i + 1, 3 * (i // 3) + 3) if x in sets):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links.add((i, j))
    _, found = op02_jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    found = {tuple(x) for x in found.collect()}
    assert len(links) > 50 and found <= links and len(found) >= 0.99 * len(links)


def test_jaccard_links_in_large_groups(spark):
    """Every link counts in groups of hundreds of near copies: all alike, and some alike, in one block and in two."""
    import random

    r = random.Random(5)
    rows = []
    for size, edits in ((700, 2), (200, 5)):
        words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(220)]
        for k in range(size):
            own = words.copy()
            for _ in range(1 + k % edits):
                own[r.randrange(len(own))] = f"edit{k}"
            rows.append((len(rows), " ".join(own)))
    by_set = {}
    for i, t in rows:
        by_set.setdefault(frozenset(shingle_set(t)), i)
    sets = {i: s for s, i in by_set.items()}
    links = {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    member, found = op02_jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    found = [tuple(x) for x in found.collect()]
    assert len(set(found)) == len(found) and set(found) <= links and len(found) >= 0.999 * len(links)
    degree = Counter(i for pair in found for i in pair)
    got = {x["doc_id"]: x["n_links"] for x in member.collect()}
    assert all(got[i] == degree[i] for i in sets) and max(got.values()) >= 690


def test_url_rules(spark, odd):
    got = {r["page_id"]: r for r in collect(spark, "op3_url_filter", odd)}
    rule = lambda i: (got[i]["host"], got[i]["path"], got[i]["rule"])
    assert rule(0) == rule(1) == rule(2) == rule(3) == ("", "", None)
    assert rule(4) == ("example.net", "/en/1", "example.net/en/") and got[4]["verdict"] == "allow"
    assert rule(5) == ("a.example.com", "/de/9", "example.com/de/") and got[5]["verdict"] == "block"
    assert rule(6) == ("x.org", "/fr/3", "org/fr/") and rule(7) == ("net", "", None) and rule(8) == ("net", "/", "net/") and rule(9) == ("b.net", "", None)
    assert {r["verdict"] for r in got.values()} <= {"allow", "block"} and len(got) == 93


def test_url_ratio_learns_hosts(spark):
    df = spark.createDataFrame([(f"http://{'good' if k % 2 else 'spam'}-{k % 5}.example.com/p/{k}", k % 2 == 1) for k in range(200)], "url string, ok boolean")
    from pyspark.sql import functions as F

    model = op03_url_filter.fit(df, "url", F.col("ok"))
    new = spark.createDataFrame([("http://good-9.example.com/p/1",), ("http://spam-9.example.com/p/1",)], "url string")
    good, spam = (r[0] for r in new.select(op03_url_filter.url_score(new, "url", model)).collect())
    assert good >= model.threshold > spam


@pytest.mark.parametrize("folder", ["odd", "sf_dir"])
def test_decontamination(spark, request, folder):
    folder = request.getfixturevalue(folder)
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    docs, items = (db.execute(f"select * from {t}").fetchall() for t in ("documents", "benchmark"))
    expected = []
    for i, q in ((r[0], shingle_set(r[1])) for r in items):
        for d in docs:
            n = len(q & shingle_set(d[1]))
            if q and n >= 0.8 * len(q):
                expected.append({"doc_id": d[0], "item_id": i, "n_shared": n, "n_shingles": len(q), "containment": n / len(q)})
    assert by_text(collect(spark, "op4_decontamination", folder)) == by_text(expected)
    if "odd" not in folder:
        assert len(db.execute(op04_decontamination.ORACLE_SQL["op4_decontamination"]).fetchall()) == len(expected)


def test_quality_rules(spark, odd, odd_docs):
    expected = []
    for d in odd_docs:
        t = d["text"] or ""
        w = WORD.findall(t)
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        expected.append((d["doc_id"], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed))
    got = collect(spark, "op5_quality_rules", odd)
    keys = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert by_text(tuple(r[k] for k in keys) for r in got) == by_text(expected)
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_quality_rules_keep_good_documents(spark, sf_dir):
    import pyarrow.parquet as pq

    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{sf_dir}/labels.parquet").to_pylist()}
    judged = [(labels[r["doc_id"]], r["kept"]) for r in collect(spark, "op5_quality_rules", sf_dir) if r["doc_id"] in labels and not r["base_failed"]]
    good, bad = [k for y, k in judged if y], [k for y, k in judged if not y]
    assert sum(good) >= 0.99 * len(good) and (not bad or sum(bad) <= 0.2 * len(bad))


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def test_quality_rules_count_all_good_documents(spark, tmp_path, monkeypatch):
    """Where all documents are good, target and raw counts are equal, also beyond 20,000 and in parts."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(op05_quality_rules, "BROADCAST_KEYS", 6000, raising=False)
    ids = spark.range(20_500).select(F.col("id").alias("doc_id"))
    ids.withColumn("text", F.concat(F.lit("w"), "doc_id")).write.parquet(f"{tmp_path}/documents.parquet")
    ids.withColumn("quality", F.lit(1)).write.parquet(f"{tmp_path}/labels.parquet")
    got = collect(spark, "op5_quality_rules", str(tmp_path))
    assert len(got) == 20_500 and all(r["log_ratio"] == 0 for r in got)


def base_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [f"email:{m.start()}:{m.end()}" for m in EMAIL.finditer(t)]
    out += [f"ip:{m.start()}:{m.end()}" for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [f"card:{m.start()}:{m.end()}" for m in CARD.finditer(t) if 13 <= len(digits(m)) <= 19 and op06_pii.luhn(digits(m))]
    return out + [f"phone:{m.start()}:{m.end()}" for m in PHONE.finditer(t) if 9 <= len(digits(m)) <= 15]


def test_personal_data(spark, odd, odd_docs):
    expected = Counter()
    for d in odd_docs:
        spans = base_spans(d["text"] or "")
        expected[(d["doc_id"], *(sum(s.startswith(k) for s in spans) for k in op06_pii.KINDS), hashlib.sha256(",".join(spans).encode()).hexdigest())] += 1
    got = collect(spark, "op6_pii", odd)
    assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == expected
    text = next(d["text"] for d in odd_docs if d["text"] and d["text"].startswith("mail"))
    spans = next(r["spans"] for r in got if r["n_email"])
    assert f"card:{text.index('9000426309966109')}:{text.index('9000426309966109') + 16}" in spans and set(base_spans(text)) <= set(spans.split(","))


@pytest.mark.parametrize("text", ["a@b@c.d", "x@@y.z a@b.c@d.e", ".@a.b", "a@b..c", "1.2.3.4.5.6.7.8", "999.1.1.1 1.1.1", "4111-1111 1111 1111 1", "+12 34567890-", "++1234567890", "1.2.3.4@x.y"])
def test_personal_data_patterns(text):
    assert op06_pii.written_out(op06_pii.base_spans(text)) == ",".join(base_spans(text))


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    r = np.random.default_rng(1)
    n = len(op06_pii.LABELS)
    model = op06_pii.ChainModel(r.normal(size=(op06_pii.N_FEATURES, n)).astype(np.float32), r.normal(size=(n, n)).astype(np.float32), r.normal(size=n).astype(np.float32))
    lines = [op06_pii.word_features(w.split()) for w in ("a 12 b@c", "x", "1 2 3 4", "+1 (2) y.")]
    for f, path in zip(lines, model.viterbi(lines, batch=7), strict=True):
        e = model.scores(f)
        score = lambda p, e=e: model.first[p[0]] + sum(e[t, y] for t, y in enumerate(p)) + sum(model.steps[a, b] for a, b in itertools.pairwise(p))
        assert score(list(path)) == pytest.approx(max(score(p) for p in itertools.product(range(n), repeat=len(f))), rel=1e-5)


def test_quality_classifier(spark, odd, odd_docs, sf_dir):
    import pyarrow.parquet as pq

    got = collect(spark, "op7_quality_classifier", odd)
    assert len(got) == len(odd_docs) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (fold(r["doc_id"], 3) == 1) for r in got)
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{sf_dir}/labels.parquet").to_pylist()}
    held = [(r["predicted"], labels[r["doc_id"]]) for r in collect(spark, "op7_quality_classifier", sf_dir) if r["held_out"] and r["doc_id"] in labels]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)


def token_ids(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(text or "", add_special_tokens=False).ids, 2]


def test_packing(spark, odd, odd_docs):
    import struct

    got = collect(spark, "op8_packing", odd)
    expected = Counter()
    for d in odd_docs:
        ids = token_ids(d["text"])
        for a in range(0, len(ids), 4096):
            own = ids[a : a + 4096]
            expected[d["doc_id"], a, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own)), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == expected
    windows = defaultdict(list)
    for r in got:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(windows) <= -(-sum(r["length"] for r in got) // 4096) + 1


def test_best_fit_is_the_tightest_window():
    import random

    import numpy as np

    r = random.Random(5)
    lengths = sorted((r.randint(1, 64) for _ in range(400)), reverse=True)
    where, offset = op08_packing.best_fit(np.array(lengths), 64)
    room = []
    for n, w, o in zip(lengths, where, offset, strict=True):
        fits = [x for x in room if x >= n]
        if fits:
            assert room[w] == min(fits) and o == 64 - room[w]
        else:
            assert w == len(room)
            room.append(64)
        room[w] -= n


def test_language_id(spark, odd, odd_docs, sf_dir):
    import pyarrow.parquet as pq

    got = collect(spark, "op9_language_id", odd)
    assert len(got) == len(odd_docs)
    bare = {d["doc_id"] for d in odd_docs if not any(c.isalpha() for c in d["text"] or "")}
    assert all((r["lang_pred"] == "und" and r["score"] == 0) if r["doc_id"] in bare else r["lang_pred"] in ("en", "fr") for r in got)
    lang = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "lang"]).to_pylist()}
    held = [(r["lang_pred"], lang[r["doc_id"]]) for r in collect(spark, "op9_language_id", sf_dir) if r["held_out"]]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def test_languages_of_many_copies_are_learned(spark):
    rows = [(f"{g} " * 30, g) for g in ("aa", "bb", "cc", "dd") for _ in range(200)]
    model = op09_language_id.train(spark.createDataFrame(rows, "t string, g string"), "t", "g", max_docs=1)
    assert model is not None and model.languages == ["aa", "bb", "cc", "dd"]


def test_all_languages_take_their_turn():
    names = ["a", "b", "c"]
    model = op09_language_id.fit([n * 200 for n in names], names, updates=60, batch=2)
    assert model.predict(pa.array([n * 50 for n in names])).argmax(axis=1).tolist() == [0, 1, 2]


def test_gradients():
    import numpy as np

    m = op09_language_id.ByteGru.fresh(["a", "b", "c"], hidden=3)
    for n in ("w", "u", "b", "v", "c"):
        setattr(m, n, getattr(m, n).astype(np.float64))
    x = np.random.default_rng(0).integers(0, 5, (6, 4)).astype(np.uint8)
    live = np.ones((6, 4), bool)
    live[4:, 3] = False
    y = np.array([0, 1, 2, 1])
    _, grads = m.gradients(x, live, y)
    for name, g in zip(("w", "u", "b", "v", "c"), grads, strict=True):
        a = getattr(m, name)
        at = np.unravel_index(int(np.abs(g).argmax()), a.shape)
        a[at] += 1e-3
        up = m.gradients(x, live, y)[0]
        a[at] -= 2e-3
        down = m.gradients(x, live, y)[0]
        a[at] += 1e-3
        assert (up - down) / 2e-3 == pytest.approx(g[at], rel=0.02, abs=1e-4)


def test_token_counts(spark, odd, odd_docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    expected = Counter()
    for d in odd_docs:
        n = len(model.encode(d["text"] or ""))
        expected[d["doc_id"], len((d["text"] or "").encode()), n, n > 4096] += 1
    assert Counter(tuple(r.values()) for r in collect(spark, "op10_token_counts", odd)) == expected


def test_splicing_is_exact():
    import random

    model = op10_token_counts.processor(public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(1)
    parts = ["a", "the", " ", "  ", "\n", "é", "中", "🙂", "word", "un ", "\t", "ing", "x" * 9, "▁", "<s>", "鿿"]
    for _ in range(200):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 300)))
        assert [i for part in op10_token_counts.spliced(model, t, r.choice([5, 20, 60]), r.choice([1, 4, 16])) for i in part] == model.encode(t)


def test_packed_texts_match_the_tokenizer():
    t = op08_packing.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["", "It's a <|endoftext|> x", "ÀÉ don't 12 x²", "İstanbul 中文 é", "a\xa0b\x1cc", "x\x85y", " \n ", "THERE'S 'LL'S''s", "Straße µ ª"]
    assert [x.tolist() for x in t(texts)] == [token_ids(x) for x in texts]


MODELS = {}


def accepted(text, docs, labels):
    """The classifier's decision, its model fitted outside of Spark on the same rows."""
    from quillspark.llm import op07_quality_classifier as op07

    if "quality" not in MODELS:
        best = {}
        for r in labels:
            if r["doc_id"] is not None and r["quality"] is not None and fold(r["doc_id"], 3) != 1:
                best[r["doc_id"]] = max(best.get(r["doc_id"], 0), r["quality"])
        own = [(d["text"], best[d["doc_id"]]) for d in docs if d["doc_id"] in best]
        x, y = op07.features(pa.array([t for t, _ in own], pa.string())), np.array([q for _, q in own], float)
        order = np.lexsort((*x.T, y))
        MODELS["quality"] = op07.fit(x[order], y[order])
    return MODELS["quality"].score(op07.features(pa.array([text], pa.string())))[0] >= 0.5


def packed_pieces(rows):
    windows = defaultdict(list)
    for r in rows:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    return Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows)


def expected_pieces(docs):
    import struct

    out = Counter()
    for d in docs:
        ids = token_ids(d["text"])
        for a in range(0, len(ids), 4096):
            own = ids[a : a + 4096]
            out[d["doc_id"], a, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own)), len(ids)] += 1
    return out


def test_pipeline_stages(spark, odd, odd_docs):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    columns = docs.columns
    kept = []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = corpus_pipeline.scratch(spark, name)
        stage(spark, docs, odd).write.parquet(path)
        after = spark.read.parquet(path)
        before, rows = docs.collect(), after.collect()
        kept.append(len(rows))
        if n < 4:
            assert after.columns == columns
        if n == 0:
            assert by_text(rows) == by_text(r for r in before if accepted(r["text"], before, spark.read.parquet(f"{odd}/labels.parquet").collect()))
        if n == 1:
            ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
            sets = [shingle_set(r["text"]) for r in rows if shingle_set(r["text"])]
            assert len(ids) == len(set(ids))
            assert not any(len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
        if n == 2:
            items = [shingle_set(r["text"]) for r in spark.read.parquet(f"{odd}/benchmark.parquet").collect()]
            leaks = lambda t: any(q and len(q & shingle_set(t)) >= 0.8 * len(q) for q in items)
            assert by_text(r for r in before if not leaks(r["text"])) == by_text(rows)
        if n == 3:
            assert len(rows) == len(before) and not any(base_spans(r["text"] or "") for r in rows)
        docs = after
    assert kept[0] >= kept[1] >= kept[2] == kept[3]
    assert packed_pieces(rows) == expected_pieces(before)


def test_features_do_not_depend_on_the_batch():
    import numpy as np

    from quillspark.llm.op07_quality_classifier import features

    texts = ["a b c\nd e", None, "", "X!! Y!!\nX!! Y!!", "ü" * 50]
    whole = features(pa.array(texts))
    assert np.allclose(whole, np.concatenate([features(pa.array([t], pa.string())) for t in texts]))


def test_quality_ratio_by_brute_force(spark, odd, odd_docs):
    """Log ratios from counts of hashed words and pairs in dictionaries."""
    import regex
    import xxhash

    labels = spark.read.parquet(f"{odd}/labels.parquet").collect()
    good = {r["doc_id"] for r in labels if r["quality"] == 1 and r["doc_id"] is not None}
    symbols = regex.compile(r"[^\p{L}\p{N}_\x20\x09-\x0D]+")

    def buckets(t):
        w = [*WORD.findall(t or ""), *symbols.findall(t or "")]
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in w]
        signed = lambda x: x - (x >> 63 << 64)
        return [signed(x) % 16384 for x in h] + [signed(xxhash.xxh64_intdigest(b.encode(), a)) % 16384 for a, b in zip(h, w[1:])]

    raw, target = Counter(), Counter()
    for d in odd_docs:
        own = Counter(buckets(d["text"]))
        raw.update(own)
        if d["doc_id"] in good:
            target.update(own)
    n_raw, n_target = 16384 + sum(raw.values()), 16384 + sum(target.values())
    ratio = lambda b: math.log((1 + target[b]) / n_target) - math.log((1 + raw[b]) / n_raw)
    own = [(-1 if d["doc_id"] is None else d["doc_id"], buckets(d["text"])) for d in odd_docs]
    expected = sorted((i, sum(map(ratio, b)) / len(b) if b else 0.0) for i, b in own)
    got = collect(spark, "op5_quality_rules", odd)
    found = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["log_ratio"]) for r in got)
    assert [i for i, _ in found] == [i for i, _ in expected] and [x for _, x in found] == pytest.approx([x for _, x in expected], abs=2e-4)
    assert all(r["kept"] == (not r["base_failed"] and r["log_ratio"] >= op05_quality_rules.THRESHOLD) for r in got)


def test_url_ratio_by_brute_force(spark):
    """Witten-Bell estimates character by character, from dictionaries of hashed contexts."""
    from pyspark.sql import functions as F

    word = (1 << 64) - 1

    def mix(h):
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & word
        h = (h ^ h >> 27) * 0x94D049BB133111EB & word
        return h ^ h >> 31

    def cells(url):
        symbols = [int(op03_url_filter._SYMBOL[b]) for b in url.encode()]
        for i, s in enumerate(symbols):
            context = 0
            for k in range(6):
                if k:
                    context = mix((context * 64 + (symbols[i - k] if i >= k else 0) + 1000 * k) & word)
                yield i, k, context >> 51, s

    urls = [(f"http://{'good' if k % 2 else 'spam'}{k % 7}.example.com/p{k * k}", k % 2 == 1) for k in range(120)]
    model = op03_url_filter.fit(spark.createDataFrame(urls, "url string, ok boolean"), "url", F.col("ok"))
    counts = [defaultdict(Counter), defaultdict(Counter)]
    for url, ok in urls:
        if zlib.crc32(url.encode()) % 5:
            for _, k, context, s in cells(url):
                counts[ok][k, context][s] += 1

    def log_likelihood(url, ok):
        total, p = 0.0, 1.0
        for _, k, context, s in cells(url):
            p = 1 / 64 if k == 0 else p
            c = counts[ok].get((k, context), Counter())
            n, kinds = sum(c.values()), len(c)
            p = c[s] / (n + kinds) + kinds / (n + kinds) * p if n else p
            total += math.log(p) if k == 5 else 0.0
        return total

    tried = ["http://good3.example.com/p9", "http://spam1.example.com/", "x", "ftp://elsewhere.org/ä?q=1", "good" * 20]
    expected = [(log_likelihood(u, True) - log_likelihood(u, False)) / len(u.encode()) for u in tried]
    score = model.scorer()
    assert score(pa.array(tried)).tolist() == pytest.approx(expected, rel=1e-4)
    long = pa.array(["".join(tried) * 3000])
    assert score(long)[0] == pytest.approx(log_ratio_in_blocks(model, long), rel=1e-9)


def log_ratio_in_blocks(model, urls):
    cells = op03_url_filter._cells
    op03_url_filter._cells = lambda u, order, bits: cells(u, order, bits, 997)
    try:
        return model.scorer()(urls)[0]
    finally:
        op03_url_filter._cells = cells


def test_additive_score_is_the_sum_of_table_entries():
    from bisect import bisect_right

    from quillspark.llm import op07_quality_classifier as op07

    r = np.random.default_rng(4)
    x = r.normal(size=(300, len(op07.FEATURES)))
    y = (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(float)
    model = op07.fit(x, y, rounds=20)
    assert len(model.pairs) == 6
    for row, score in zip(x[:40], model.score(x[:40]), strict=True):
        own = [bisect_right(e.tolist(), v) for e, v in zip(model.edges, row, strict=True)]
        small = [b * 8 // max(len(e) + 1, 8) for b, e in zip(own, model.edges, strict=True)]
        z = model.bias + sum(t[b] for t, b in zip(model.tables, own, strict=True)) + sum(t[small[i], small[j]] for (i, j), t in model.pairs.items())
        assert score == pytest.approx(1 / (1 + math.exp(-z)))
    assert ((model.score(x) >= 0.5) == y).mean() > 0.85


def test_quality_features_by_brute_force():
    from quillspark.llm import op07_quality_classifier as op07

    texts = ["Some Words here!! and\nmore Words here\nmore Words here #1", "a", "ÜBER | x* y\n\nx* y", "x" * 3_000_000 + " b b"]
    for t, row in zip(texts, op07.features(pa.array(texts)), strict=True):
        w, raw = WORD.findall(t), t.encode()
        lines = [tuple(WORD.findall(x)) for x in t.split("\n") if WORD.findall(x)]
        got = dict(zip(op07.FEATURES, row, strict=True))
        expected = {
            "log_words": math.log1p(len(w)), "word_bytes": sum(len(x.encode()) for x in w) / len(w), "upper": sum(65 <= b < 91 for b in raw) / len(raw), "digits": sum(48 <= b < 58 for b in raw) / len(raw),
            "exclamations": raw.count(b"!") / len(raw), "bars": raw.count(b"|") / len(raw), "line_words": len(w) / len(lines), "repeated_words": 1 - len(set(w)) / len(w), "repeated_lines": 1 - len(set(lines)) / len(lines),
            "upper_words": sum(x[0] in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for x in w) / len(w), "marked_words": sum(x[-1] in "#*$%&|<>!" for x in w) / len(w),
        }
        assert {k: got[k] for k in expected} == pytest.approx(expected)


def test_recurrent_network_by_hand():
    """States and label probabilities step by step, for one text longer than a window and one shorter."""
    m = op09_language_id.ByteGru.fresh(["a", "b", "c"], hidden=3, seed=8)
    h = 3
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def read(direction, data):
        state, out = np.zeros(h), []
        for b in data:
            own, back = m.w[direction][:, b].astype(float), m.u[direction].astype(float) @ state
            r, z = sigmoid(own[:h] + back[:h]), sigmoid(own[h : 2 * h] + back[h : 2 * h])
            state = (1 - z) * np.tanh(own[2 * h :] + r * (back[2 * h :] + m.b[direction])) + z * state
            out.append(state)
        return out

    texts = ["héllo wörld", "0123456789" * 3]
    for text, got in zip(texts, m.predict(pa.array(texts), window=16), strict=True):
        data, total = text.encode(), np.zeros(3)
        for at in range(0, len(data), 16):
            part = data[at : at + 16]
            for ahead, behind in zip(read(0, part), reversed(read(1, part[::-1])), strict=True):
                e = np.exp(m.v.astype(float) @ np.concatenate((ahead, behind)) + m.c)
                total += e / e.sum()
        assert got.tolist() == pytest.approx((total / len(data)).tolist(), rel=1e-4)


def test_field_training_raises_the_likelihood():
    """The conditional log-likelihood by enumeration of all label paths, before and after training."""
    import itertools

    table = [(["mail", "a@b.example.org", "now"], [0, 1, 0]), (["+1", "(017)", "x"], [7, 8, 0]), (["1.2.3.4", "v"], [3, 0])]
    n = len(op06_pii.LABELS)

    def log_likelihood(model):
        total = 0.0
        for words, labels in table:
            e = model.scores(op06_pii.word_features(words)).astype(float)
            value = lambda p, e=e: model.first[p[0]] + sum(e[t, y] for t, y in enumerate(p)) + sum(model.steps[a, b] for a, b in itertools.pairwise(p))
            total += value(labels) - math.log(sum(math.exp(value(p)) for p in itertools.product(range(n), repeat=len(words))))
        return total

    none = op06_pii.ChainModel(np.zeros((op06_pii.N_FEATURES, n)), np.zeros((n, n)), np.zeros(n))
    assert log_likelihood(none) == pytest.approx(-sum(len(w) for w, _ in table) * math.log(n))
    values = [log_likelihood(op06_pii.train(table, epochs=k)) for k in (1, 5, 60)]
    assert values == sorted(values) and values[-1] > -0.5


def test_field_finds_secrets_and_numbers(spark, sf_dir):
    texts = ['set token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" here', "call 017-555-7713 or (017) 555-7713 today", "in 1999 there were 123 of 4567 items", "x " * 5000 + "api_key: Zk3vQ9xT7bLm2RwYp8Hn4 end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = op06_pii.fitted(docs, "text")
    got = [r[0].split(",") for r in docs.select(op06_pii.personal_data(docs, "text", model)["spans"]).collect()]
    at = texts[0].index("04db")
    assert got[0] == [f"secret:{at}:{at + 40}"] and len(got[1]) == 2 and all(x.startswith("phone") for x in got[1]) and got[2] == [""]
    at = texts[3].index("Zk3")
    assert got[3] == [f"secret:{at}:{at + 21}"]


def test_stretches_cover_all_words_near_triggers():
    import random

    r = random.Random(3)
    for _ in range(200):
        words = [r.choice(["a", "b", "c", "7"]) if r.random() < 0.2 else "w" for _ in range(r.randint(1, 120))]
        text = " ".join(words)
        hit = [i for i, w in enumerate(words) if w == "7"]
        near = {i for i in range(len(words)) if any(abs(i - k) <= op06_pii.AROUND for k in hit)}
        got = [m.start() // 2 for own in op06_pii._stretches(text) for m in own]
        assert near <= set(got) and got == sorted(set(got))


def test_classes_go_by_text_not_by_key(spark):
    import random

    r = random.Random(9)
    a, b = (["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(120)] for _ in range(2))
    near = lambda w: " ".join([*w[:60], "changed", *w[61:]])
    rows = [(1, " ".join(a)), (2, near(a)), (1, " ".join(b)), (None, near(b)), (None, " ".join(b)), (7, "")]
    member, links = op02_jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    got = Counter((x["doc_id"], x["class_id"], x["n_links"], x["n_copies"]) for x in member.collect())
    assert got == Counter([(1, 1, 1, 1), (2, 1, 1, 1), (1, 1, 1, 2), (None, 1, 1, 1), (None, 1, 1, 2), (7, 7, 0, 1)])
    assert len(links.collect()) == 2


def test_recall_at_half_similarity(spark):
    import random

    r = random.Random(4)
    rows = []
    for g in range(40):
        words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(150)]
        for _ in range(4):
            own = words.copy()
            for _ in range(r.randint(3, 11)):
                own[r.randrange(150)] = f"edit{len(rows)}"
            rows.append((len(rows), " ".join(own)))
    sets = [shingle_set(t) for _, t in rows]
    links = {(i, j) for i in range(len(rows)) for j in range(i + 1, 4 * (i // 4) + 4) if len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j])}
    _, found = op02_jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 0.5)
    found = {tuple(x) for x in found.collect()}
    assert len(links) > 60 and found <= links and len(found) >= 0.99 * len(links)


def test_prefixes_are_shortened_as_far_as_the_pairs_need(spark):
    depth = lambda j: op02_jaccard_join.shortened(spark.createDataFrame([(op02_jaccard_join._weights(np.full(50_000, j)),), (None,)], "weights array<double>"), 0.8, op02_jaccard_join.RECALL)
    assert depth(0.98) == 8 and depth(0.8) == op02_jaccard_join.prefix_depth() and op02_jaccard_join.prefix_depth() < depth(0.88) < 8


def test_all_languages_are_learned_whatever_their_copies(spark):
    from pyspark.sql import functions as F

    few = spark.range(10_000).select(F.concat(F.lit("aha "), (F.col("id") % 5).cast("string"), F.lit(" aha oho")).alias("t"), F.lit("aa").alias("g"))
    many = spark.range(5000).select(F.concat(F.lit("bub "), F.col("id").cast("string"), F.lit(" bubu")).alias("t"), F.lit("bb").alias("g"))
    names = spark.range(1200).select(F.concat(F.lit("word "), F.col("id").cast("string")).alias("t"), F.concat(F.lit("l"), F.col("id").cast("string")).alias("g"))
    seen = {}
    fit = op09_language_id.fit
    op09_language_id.fit = lambda texts, languages, **k: seen.update(n=Counter(languages), size=sum(map(len, texts)))
    try:
        op09_language_id.train(few.unionAll(many).unionAll(names), "t", "g", max_chars=1_000_000)
    finally:
        op09_language_id.fit = fit
    assert seen["n"]["aa"] == min(5, seen["n"]["bb"]) and len(seen["n"]) == 1202 and seen["size"] <= 1_000_000


def test_short_items_in_long_documents(spark):
    import random

    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([5] * 40 + [6] * 20 + [8] * 20 + [9] * 20 + [300, 3000])]
    docs = []
    for k, t in items:
        around = [word() for _ in range(4000)]
        at = r.choice([0, 4000, r.randrange(4000)])
        docs.append((k, " ".join([*around[:at], t, *around[at:]])))
    index = op04_decontamination.ContainmentIndex.build(pa.array([t for _, t in items]))
    docs.append((1000, " ".join(t for _, t in docs[:60])))
    found = op04_decontamination.contained_items(spark.createDataFrame(docs, "k long, t string"), spark.createDataFrame(items, "k long, t string"), "k", "t", "k", "t")
    pairs = Counter((r[0], r[1]) for r in found.toDF("d", "i", "n", "m", "c").collect())
    assert pairs == Counter([(k, k) for k, _ in items] + [(1000, k) for k in range(60)])
    assert len(index.few) == 80


def test_long_documents_are_searched_in_parts(monkeypatch):
    import random

    from quillspark.llm.wordhash import shingles, words

    r = random.Random(2)
    text = [f"w{r.randrange(10**6)}" for _ in range(20_000)]
    items = [" ".join(text[a : a + n]) for a, n in ((0, 30), (511, 40), (9990, 700), (19_900, 100), (1020, 12))]
    index = op04_decontamination.ContainmentIndex.build(pa.array(items))
    h, first = shingles(words(pa.array([" ".join(text)])), 5)
    whole = index.verified(h, first)
    monkeypatch.setattr(op04_decontamination, "PART", 512)
    assert index.verified(h, first) == whole and len(whole) == 5


def test_words_of_long_rows_are_cut_at_white_space():
    import random

    from quillspark.llm import wordhash

    r = random.Random(1)
    rows = ["", "a b", " ".join("x" * r.randint(1, 12) for _ in range(3000)), None, "y" * 5000, "end of it\n"]
    whole = wordhash.words(pa.array(rows), fold=True)
    size = wordhash.SLICE_BYTES
    wordhash.SLICE_BYTES = 64
    try:
        cut = wordhash.words(pa.array(rows), fold=True)
    finally:
        wordhash.SLICE_BYTES = size
    for a, b in ((whole.hashes, cut.hashes), (whole.starts, cut.starts), (whole.ends, cut.ends), (whole.first, cut.first)):
        assert a.tolist() == b.tolist()


def test_model_of_many_shards_opens_few_files(spark, odd, monkeypatch):
    import resource

    expected = {(r["doc_id"], r["n_tokens"]): r["score"] for r in collect(spark, "op1_lm_scoring", odd)}
    monkeypatch.setattr(op01_lm_scoring, "SHARD_BYTES", 2000)
    docs = spark.read.parquet(f"{odd}/documents.parquet").select("doc_id", "text")
    held = fold_column(docs)
    model = op01_lm_scoring.train(docs.where(~held), "text")
    assert model.shards > 100
    monkeypatch.setattr(op01_lm_scoring, "OPEN_FILES", 8)
    monkeypatch.setattr(op01_lm_scoring, "BLOCK_TOKENS", 1000)
    soft, hard = resource.getrlimit(resource.RLIMIT_NOFILE)
    import os

    resource.setrlimit(resource.RLIMIT_NOFILE, (len(os.listdir("/proc/self/fd")) + 80, hard))
    try:
        rows = docs.collect()
        got = model.score(pa.array([r["text"] for r in rows], pa.string()))
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, (soft, hard))
    assert len(model._open) <= 8
    for r, n, score in zip(rows, got["n_tokens"], got["score"], strict=True):
        assert score == pytest.approx(expected[r["doc_id"], n], rel=1e-9)


def fold_column(docs):
    from pyspark.sql import functions as F

    from quillspark.llm.common import fold as column

    return F.coalesce(column("doc_id", 7) == 2, F.lit(False))


def test_scores_replace_columns_of_their_names(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    model = op01_lm_scoring.train(docs, "text")
    out = op01_lm_scoring.scored(docs, "text", model)
    assert out.columns.count("score") == 1 and out.where("score < 0").count() == docs.count()


def test_long_texts_are_packed_in_pieces(monkeypatch):
    t = op08_packing.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    monkeypatch.setattr(op08_packing, "LONG", 100)
    for text in ("Some words, don't stop: " * 40, "中文 x " * 60, "x" * 500, "a <|endoftext|> b\n" * 30, "ÀÉ 'LL'S " * 30):
        assert t([text])[0].tolist() == token_ids(text)


def test_small_cache_gives_the_same_ids():
    t = op08_packing.PartTokenizer(public_tokenizers.path("word_bpe_49k.json"), cache_bytes=1000)
    texts = [f"words {k} of 'em, that's {k * k} More! word{k}s" for k in range(200)]
    got = [x.tolist() for k in range(0, 200, 10) for x in t(texts[k : k + 10])]
    assert got == [token_ids(x) for x in texts] and t.held < 10_000
