"""Proofs of the manifest are folded for every row, also for those that nothing was changed in."""

from hashlib import sha256

from quillspark.llm import op12_merkle_manifest as M


def test_unchanged_leaves_are_folded_too(spark):
    leaves = [sha256(bytes([k])).digest() for k in range(4)]
    h = lambda *x: sha256("".join(x).encode()).hexdigest()
    a, b, c, d = (x.hex() for x in leaves)
    root = h(h(a, b, c), h(d))
    slots = [(k, k, x, None) for k, x in enumerate(leaves)]
    arrays = spark.createDataFrame([("=a", 0, 4, slots), ("=b", 0, 4, slots)], "g string, at long, m long, slots array<struct<slot: int, id: long, leaf: binary, changed: binary>>")
    # the root of b is not that of its leaves
    above = spark.createDataFrame([("=a", 0, [], root, root), ("=b", 0, [], root, "0" * 64)], "g string, at long, path array<struct<l: string, r: string>>, subroot string, root string")
    found = M._leaf_rows(arrays, above, "doc_id", "source").collect()
    assert {(r.source, r.folded_root, r.verified) for r in found} == {("a", root, True), ("b", root, False)}
    assert len(found) == 8
