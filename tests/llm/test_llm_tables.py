"""Clustering, manifest and fingerprints against brute-force versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from quillspark.llm import op11_centroid_clustering as op11
from quillspark.llm import op12_merkle_manifest as op12
from quillspark.llm import op13_simhash_dedup as op13
from quillspark.llm.stars import components

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# -- clustering


def clustered(rows):
    kept = [(r["vec_id"], [int(np.floor(256 * np.float64(np.float32(v)))) for v in e]) for r in rows if (e := r["embedding"]) is not None and len(e) == 64 and all(v is not None and np.isfinite(v) for v in e)]
    first = sorted((sha(f"2:{k}"), v) for k, v in kept if k is not None)[:40]
    centroids = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))
    for _ in range(5):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        centroids = [[sum(x) // len(groups[i]) for x in zip(*groups[i], strict=True)] if i in groups else c for i, c in enumerate(centroids)]
    found = [(k, *near(v)) for k, v in kept]
    by = Counter()
    for _, d, c in found:
        by[c] += d
    return Counter((k, c, d, by[c], sum(by.values()), sha(",".join(map(str, centroids[c])))) for k, d, c in found)


def test_clusters(spark, odd):
    import pyarrow.parquet as pq

    got = Counter(tuple(r) for r in op11.op11_centroid_clustering(spark, odd).collect())
    expected = clustered(pq.read_table(f"{odd}/embeddings.parquet").to_pylist())
    assert got == expected and max(r[2] for r in got) >= 0 and any(r[0] is None for r in got)


@pytest.mark.parametrize("n", [1, 5])
def test_fewer_vectors_than_centroids(spark, n):
    rows = [(i, [float(i)] * 64) for i in range(n)] + [(n, [0.0] * 64)] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = Counter(tuple(r) for r in op11.clusters(df, "vec_id", "embedding").collect())
    assert got == clustered([dict(vec_id=k, embedding=e) for k, e in rows])


def test_distances_beyond_a_long_are_null(spark):
    rows = [(i, [float(i)] * 64) for i in range(60)] + [(99, [1e30, *[-1e30] * 63]), (98, [3e30] * 64)]
    got = {r.vec_id: r for r in op11.clusters(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding", n=2).collect()}
    assert len(got) == 62 and {r.distance is None for r in got.values()} == {True, False} and got[0].inertia is None


def test_bounds_hold_and_spare_comparisons():
    r = np.random.default_rng(5)
    middles = r.normal(0, 300, (40, 64))
    x = np.floor(np.repeat(middles, 25, axis=0) + r.normal(0, 30, (1000, 64)))
    simplex, centroids = op11.Simplex.of(np.floor(middles)), op11.whole(np.floor(middles).astype(int).tolist())
    c, d, compared = op11.nearest(x, simplex.apex(simplex.distances(x)), centroids, simplex)
    exact = ((x[:, None] - np.floor(middles)) ** 2).sum(axis=2)
    assert (c == exact.argmin(axis=1)).all() and (d == exact.min(axis=1)).all()
    assert compared < 4 * len(x) and len(simplex.pivots) == op11.PIVOTS


def test_sums_are_exact_in_limbs():
    for v in (0, 1, -1, 5 << 29, -(7 << 90), (1 << 120) + 3, -(1 << 30)):
        assert sum(part << (op11.LIMB * k) for k, part in op11._limbs(v)) == v


# -- manifest


def manifest(rows):
    """Rows of (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha(*(field(r[c]) for c in op12.FIELDS))
    groups = defaultdict(list)
    for r in rows:
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None
        groups[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), leaf(r | {"text": r["text"].replace("\n", "")}) if hit else leaf(r)))

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
        return levels

    def path(levels, i):
        for level in levels[:-1]:
            run = i - i % 3
            yield level[run:i], level[i + 1 : run + 3]
            i //= 3

    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [climb([x[2] for x in sorted(groups[s])]) for s in order]
    top = climb([t[-1][0] for t in trees])
    out = []
    for k, (s, tree) in enumerate(zip(order, trees, strict=True)):
        for i, (known, doc_id, own, changed) in enumerate(sorted(groups[s])):
            steps = [*path(tree, i), *path(top, k)]
            for left, right in steps:
                changed = sha(*left, changed, *right)
            out.append((doc_id if known else None, own, tree[-1][0], top[-1][0], sha(*(x for left, right in steps for x in left + right)), changed, changed == top[-1][0]))
    return Counter(out)


def proven(df):
    return Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect())


def test_manifest_of_odd_rows(spark, odd, odd_docs):
    assert proven(op12.op12_merkle_manifest(spark, odd)) == manifest(odd_docs)


def test_manifest_of_many_levels(spark):
    """Sparse, negative and missing ids, repeated rows, ids with several rows, sources of sizes around the arrays'."""
    r = random.Random(4)
    sizes = {"a": 1, "": 2, None: 3, "é": 242, "z": 243, "Z": 244, "b": 730, **{f"s{k}": 1 for k in range(300)}}
    rows = [(r.choice([None, r.randint(-(2**62), 2**62), r.randint(0, 500)]), s, "en", 1, f"x{r.randint(0, 3)}\ny") for s, n in sizes.items() for _ in range(n)]
    rows += [(5, "copies", None, None, "same\ntext")] * 9000
    got = proven(op12.manifest(spark.createDataFrame(rows, SCHEMA), "doc_id", "source"))
    assert got == manifest([dict(zip(op12.FIELDS, x, strict=True)) for x in rows])


def test_only_deleted_line_ends_are_noticed(spark):
    rows = [(i, "s", "en", 3, "a\nb" if i % 3 else "ab") for i in range(100)]
    for r in op12.manifest(spark.createDataFrame(rows, SCHEMA), "doc_id", "source").collect():
        assert r.verified == (not (r.doc_id % 3 and zlib.crc32(str(r.doc_id).encode()) % 2 == 0))


# -- fingerprints


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(len(w) - 2)] or ([xxhash.xxh64_intdigest(" ".join(w).encode(), 42)] if w else [])
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reached(values, ids):
    """By place, the least id that links of the values reach."""
    of = list(range(len(values)))

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    for i, v in enumerate(values):
        for j in range(i):
            if (v ^ values[j]).bit_count() <= 2:
                of[top(i)] = top(j)
    low = {}
    for i, k in enumerate(ids):
        if k is not None:
            low[top(i)] = min(k, low.get(top(i), k))
    return [low.get(top(i)) for i in range(len(values))]


def test_fingerprints_and_components(spark, odd, odd_docs):
    values = [fingerprint(d["text"]) for d in odd_docs]
    expected = Counter((d["doc_id"], f"{v:016x}", c) for d, v, c in zip(odd_docs, values, reached(values, [d["doc_id"] for d in odd_docs]), strict=True))
    assert Counter(tuple(r) for r in op13.op13_simhash_dedup(spark, odd).collect()) == expected


def test_texts_are_hashed_in_blocks(monkeypatch):
    r = random.Random(2)
    texts = ["  A b  ", "a b c", "one", "", " ".join(r.choice(["A", "bb", "ÇÀ", "d\te", "\n"]) for _ in range(300)), "x" * 500 + " y " + "z" * 100 + " q"]
    for step in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(op13, "STEP", step)
        assert [op13.fingerprint(t.encode()) for t in texts] == [fingerprint(t) for t in texts]


@pytest.mark.parametrize("crowd", [2, 512])
def test_links_of_planted_fingerprints(spark, monkeypatch, crowd):
    """Chains and crowds of fingerprints at 0 to 3 differing bits, at every pair of places."""
    monkeypatch.setattr(op13, "CROWD", crowd)
    r = random.Random(3)
    values = [r.getrandbits(64) for _ in range(60)]
    for v in values[:40]:
        values.append(v ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 3))))
    middle = r.getrandbits(64)
    values += [middle ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(a)]
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = op13.linked(spark.createDataFrame([(v,) for v in signed], "f long"))
    root = {x.v: x.root for x in components(links).collect()}
    expected = reached(values, signed)
    assert [root.get(v, v) for v in signed] == expected


def test_one_differing_bit_keeps_a_codeword():
    _, n = op13.nearby()
    assert sorted(set(n.tolist())) == [1, 6] and int((n == 6).sum()) == 1771
    words = np.random.default_rng(1).integers(0, 1 << 23, 40)
    for b in range(23):
        row, index, _ = op13.codewords(words)
        other, centre, is_centre = op13.codewords(words ^ (1 << b))
        centre = dict(zip(other[is_centre].tolist(), centre[is_centre].tolist(), strict=True))
        assert all(centre[k] in index[row == k] for k in range(len(words)))


@pytest.mark.parametrize("crowd", [1, 256])
@pytest.mark.parametrize("broadcast", [0, 1_000_000])
def test_components_of_crowded_ids(spark, monkeypatch, crowd, broadcast):
    from quillspark.llm import stars

    monkeypatch.setattr(stars, "CROWD", crowd)
    monkeypatch.setattr(stars, "BROADCAST_KEYS", broadcast)
    links = [(0, k) for k in range(1, 400)] + [(k, k + 1) for k in range(1000, 1100)] + [(5, 1050), (7, 7)] + [(2000 + k, 2100 - k) for k in range(100)]
    found = {r.v: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found.get(v, v) == 0 for v in [*range(400), *range(1000, 1101)])
    assert all(found.get(2000 + k, 2000 + k) == min(2000 + k, 2100 - k) for k in range(1, 100) if k != 50)


# -- long words, other tokenizers, ties


def test_long_words_differ_when_blocks_change_places(spark):
    import pyarrow as pa

    from quillspark.llm import op02_jaccard_join, op04_decontamination, wordhash

    r = random.Random(6)
    a, b = ("".join(r.choice("abcdefgh") for _ in range(4096)) for _ in range(2))
    h = wordhash.words(pa.array([a + b, b + a, a + b, a + a + b, a + b + a])).hashes
    assert len(set(h.tolist())) == 4 and h[0] == h[2]
    docs = spark.createDataFrame([(1, a + b), (2, b + a), (3, a + b)], "doc_id long, text string")
    member = {x.doc_id: (x.class_id, x.n_copies) for x in op02_jaccard_join.jaccard_join(docs, "doc_id", "text")[0].collect()}
    assert member == {1: (1, 2), 2: (2, 1), 3: (1, 2)}
    items = spark.createDataFrame([(9, b + a)], "item_id long, text string")
    assert [x.doc_id for x in op04_decontamination.without_items(docs, items, "text", "item_id", "text").orderBy("doc_id").collect()] == [1, 3]


def test_long_texts_with_another_tokenizer_are_encoded_whole(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    from quillspark.llm import op08_packing

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, whole = op08_packing.PartTokenizer(path), Tokenizer.from_file(path)
    monkeypatch.setattr(op08_packing, "LONG", 200)
    for text in ("Some words,   don't stop: \n" * 60, "x = 1\n    y = 2\n" * 80, "中文 x " * 60):
        assert t([text])[0].tolist() == [*whole.encode(text, add_special_tokens=False).ids, op08_packing.END_ID]


def test_of_rows_that_share_an_id_the_least_stays(spark, odd):
    import corpus_pipeline

    texts = ["one text of its own kind with words", "another text that has nothing of it", None]
    rows = [(5, t, "en", s, 1) for t in texts for s in ("b", "a")] + [(6, "x", "en", "s", 1)]
    least = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("xxhash64(text) as h", "*").where("doc_id = 5").orderBy("h", "text", "source").first()
    for k in range(3):
        df = spark.createDataFrame(random.Random(k).sample(rows, len(rows)), "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        kept = {r.doc_id: (r.text, r.source) for r in corpus_pipeline.near_duplicates(spark, df, odd).collect()}
        assert kept == {5: (least.text, least.source), 6: ("x", "s")}


def test_labels_beyond_the_scans_are_joined(spark, sf_dir, monkeypatch):
    from quillspark.llm import op05_quality_rules as op05

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id").distinct()
    ratios = []
    for keys, scans in ((1_000_000, 1), (3, 1)):
        monkeypatch.setattr(op05, "BROADCAST_KEYS", keys)
        parts = list(op05.marked(docs, good, "doc_id"))
        assert len(parts) == scans
        ratios.append(op05.fit(parts, "text", op05.F.col("good"), 512))
    assert ratios[0] == ratios[1]
