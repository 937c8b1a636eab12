"""Merkle manifest of a table: leaves of every row, one tree per group, one tree over the groups' roots.

Coordinates come from bitmap ranks instead of a sort.  A group's ids are a bitmap of 64-bit words; tasks make partial
words, which merge by OR, and only words with a bit are kept.  Over them stands a directory of population counts with a
fan-out of ``2 ** FAN`` words: the rank of an id is the count before its word plus the bits below it.  Rows of an id that
occurs several times follow each other; how many a word has above its bits is kept with it.

A leaf goes to the slot ``rank mod ARITY ** DEPTH`` of the array keyed by its group and ``rank div ARITY ** DEPTH``; an
array is reduced by ``DEPTH`` levels at once, its node is a slot of the next array, until one node is left.  Paths then
come down the same arrays: siblings to the left and to the right of every level, kept once for an array and not per leaf.

Defined results: null fields are ``-`` in a leaf; a null group is a group of its own, the first one; rows with a null id
come before those with one and are not tampered with; rows that share group and id are ordered by their leaf; a table
without rows has no tree and no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import read, written

ARITY, DEPTH = 3, 5
SLOTS = ARITY**DEPTH
#: Words of one directory entry, as a power of 2; an entry's running counts are one window.
FAN = 20
#: The word of rows without an id, less than that of any id.
NO_ID = -(1 << 58)
#: Copies of a row that are listed at a time.
COPIES = 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<l: string, r: string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hexadecimal sha256 of the parts, one after another."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """Bytes of the value as text, a colon and the value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame, key: str, group: str, fields: tuple[str, ...], text: str) -> DataFrame:
    """(g, w, bit, id, leaf, changed, n): rows by group, place in the bitmap and leaf, with the number of equal ones.

    g is the group as a text that sorts alike, empty for null; changed is the leaf after tampering where that differs.
    """
    id_ = F.col(key).cast("long")
    hit = (F.crc32(id_.cast("string")) % 2 == 0) & F.contains(F.col(text), F.lit("\n"))
    less = F.replace(F.col(text), F.lit("\n"), F.lit(""))
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit("")).alias("g"),
        F.coalesce(F.shiftright(id_, 6), F.lit(NO_ID)).alias("w"), F.coalesce(id_.bitwiseAND(F.lit(63)), F.lit(0)).cast("int").alias("bit"), id_.alias("id"),
        F.unhex(digest(*(field(F.col(c)) for c in fields))).alias("leaf"), F.when(hit, F.unhex(digest(*(field(less if c == text else F.col(c)) for c in fields)))).alias("changed"),
    )
    return rows.groupBy("g", "w", "bit", "id", "leaf", "changed").agg(F.count(F.lit(1)).alias("n"))


def _before(counts: DataFrame, by: str, shift: int = 0) -> DataFrame:
    """``counts`` (g, by, total, ...) with ``base``: the totals of the group's entries before, by the directory."""
    last = shift + FAN >= 58
    parent = F.shiftright(F.col(by), FAN)
    w = Window.partitionBy("g", "up").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    inside = counts.select("*", (F.lit(0).cast("long") if last else parent).alias("up")).withColumn("base", F.coalesce(F.sum("total").over(w), F.lit(0)))
    if last:
        return inside.drop("up")
    entries = counts.groupBy("g", parent.alias("entry")).agg(F.sum("total").alias("total"))
    above = _before(entries, "entry", shift + FAN).select("g", F.col("entry").alias("up"), F.col("base").alias("more"))
    return inside.join(above, ["g", "up"]).withColumn("base", F.col("base") + F.col("more")).drop("up", "more")


def bitmaps(rows: DataFrame) -> DataFrame:
    """(g, w, mask, extra, base): the words of the groups' bitmaps, copies beyond the bits, and rows before the word."""
    ids = rows.groupBy("g", "w", "bit").agg(F.sum("n").alias("n"))
    extra = F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.struct("bit", (F.col("n") - 1).alias("more")))))
    words = ids.groupBy("g", "w").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"), extra.alias("extra"), F.sum("n").alias("total"))
    return _before(written(words, "bitmaps"), "w").drop("total")


def _among_equal_ids(rows: DataFrame) -> DataFrame:
    """``rows`` with ``inner``: rows of the same id before them, by leaf; other leaves of one id are dealt by their first bytes."""
    id_ = ["g", "w", "bit"]
    crowded = written(rows.groupBy(*id_).agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").drop("kinds"), "crowded")
    if crowded.isEmpty():
        return rows.withColumn("inner", F.lit(0).cast("long"))
    many = rows.join(crowded, id_, "left_semi").withColumn("head", F.substring("leaf", 1, 2))
    running = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    heads = many.groupBy(*id_, "head").agg(F.sum("n").alias("total"))
    heads = heads.withColumn("inner", F.coalesce(F.sum("total").over(running(id_, "head")), F.lit(0))).drop("total")
    own = F.coalesce(F.sum("n").over(running([*id_, "head"], "leaf")), F.lit(0))
    many = many.withColumn("own", own).join(heads, [*id_, "head"]).withColumn("inner", F.col("inner") + F.col("own")).drop("head", "own")
    return rows.join(crowded, id_, "left_anti").withColumn("inner", F.lit(0).cast("long")).unionByName(many)


def ranked(rows: DataFrame) -> DataFrame:
    """(g, rank, id, leaf, changed): one row per row of the table, with its place in its group from 0."""
    below = F.expr("bit_count(mask & ~shiftleft(-1L, bit))")
    copies = F.expr("aggregate(filter(extra, e -> e.bit < bit), 0L, (s, e) -> s + e.more)")
    found = _among_equal_ids(rows).join(bitmaps(rows), ["g", "w"]).select("g", (F.col("base") + below + copies + F.col("inner")).alias("rank"), "id", "leaf", "changed", "n")
    many = found.withColumn("part", F.explode(F.expr(f"sequence(0L, (n - 1) div {COPIES})")))
    many = many.withColumn("copy", F.explode(F.expr(f"sequence(part * {COPIES}, least((part + 1) * {COPIES}, n) - 1)")))
    return many.select("g", (F.col("rank") + F.col("copy")).alias("rank"), "id", "leaf", "changed")


def _levels(nodes: list[bytes], whole: bool) -> list[list[bytes]]:
    """The nodes of an array level by level, in hexadecimal; up to the last node where the array is all there is."""
    out = [nodes]
    for _ in range(DEPTH):
        if whole and len(nodes) == 1:
            break
        nodes = [sha256(b"".join(nodes[i : i + ARITY])).hexdigest().encode() for i in range(0, len(nodes), ARITY)]
        out.append(nodes)
    return out


def _sides(level: list[bytes], i: int) -> tuple[bytes, bytes]:
    run = i - i % ARITY
    return b"".join(level[run:i]), b"".join(level[i + 1 : run + ARITY])


def _arrays(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """(g, at, m, slots): nodes (g, m, rank, columns) by the array that they belong to."""
    slot = F.struct((F.col("rank") % SLOTS).cast("int").alias("slot"), *columns)
    at = F.expr(f"rank div {SLOTS}")
    return nodes.groupBy("g", at.alias("at"), "m").agg(F.array_sort(F.collect_list(slot)).alias("slots"))


def _reduced(arrays: DataFrame, name: str) -> DataFrame:
    """(g, m, rank, node): the node of every array."""

    def reduce_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tops = [_levels([bytes(x).hex().encode() for x in nodes], m <= SLOTS)[-1][0] for m, nodes in zip(b.column("m").to_pylist(), b.column("nodes").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("g"), b.column("m"), b.column("at"), pa.array([bytes.fromhex(t.decode()) for t in tops], pa.binary())], ["g", "m", "rank", "node"])

    rows = arrays.select("g", "at", "m", F.col("slots")[name].alias("nodes"))
    return rows.mapInArrow(reduce_slots, "g string, m long, rank long, node binary").withColumn("m", F.ceil(F.col("m") / SLOTS))


def _climbed(arrays: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The arrays of every round above ``arrays``, and (g, round, node): the node that is left of each group."""
    rounds, tops = [arrays], []
    while True:
        nodes = written(_reduced(rounds[-1], name), "nodes")
        tops.append(nodes.where("m = 1").select("g", F.lit(len(rounds)).alias("round"), "node"))
        open_ = nodes.where("m > 1")
        if open_.isEmpty():
            break
        rounds.append(written(_arrays(open_, ["node"]), "arrays"))
        name = "node"
    out = tops[0]
    for t in tops[1:]:
        out = out.unionAll(t)
    return rounds, written(out, "tops")


def _paths(arrays: DataFrame, above: DataFrame) -> DataFrame:
    """(g, at, path, subroot, root) of the arrays below ``arrays``, whose own paths are ``above``."""

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                levels = _levels([bytes(x).hex().encode() for x in r["nodes"]], r["m"] <= SLOTS)
                for slot in range(len(levels[0])):
                    path, i = [], slot
                    for level in levels[:-1]:
                        left, right = _sides(level, i)
                        path.append({"l": left.decode(), "r": right.decode()})
                        i //= ARITY
                    out.append({"g": r["g"], "at": r["at"] * SLOTS + slot, "path": path + r["path"], "subroot": r["subroot"], "root": r["root"]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("g", pa.string()), ("at", pa.int64()), ("path", pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))), ("subroot", pa.string()), ("root", pa.string())]))

    rows = arrays.join(above, ["g", "at"]).select("g", "at", "m", F.col("slots")["node"].alias("nodes"), "path", "subroot", "root")
    return rows.mapInArrow(descend, f"g string, at long, path {_PATH}, subroot string, root string")


def _numbered(groups: DataFrame) -> DataFrame:
    """``groups`` with ``rank`` by g: running numbers of ranges of groups, and of the groups within."""
    ranges = written(groups.repartitionByRange("g").withColumn("p", F.spark_partition_id()), "ranges")
    base = ranges.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    base = base.select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("p").orderBy("g")) - 1
    return ranges.withColumn("own", own).join(F.broadcast(base), "p").withColumn("rank", F.col("own") + F.col("base")).drop("p", "own", "base")


def _leaf_rows(arrays: DataFrame, above: DataFrame, key: str, group: str) -> DataFrame:
    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, group, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        for b in batches:
            out: dict[str, list] = {n: [] for n in names}
            for r in b.to_pylist():
                levels = _levels([bytes(s["leaf"]).hex().encode() for s in r["slots"]], r["m"] <= SLOTS)
                up = [(x["l"].encode(), x["r"].encode()) for x in r["path"]]
                rest = [b"".join(x + y for x, y in up)]
                for level in reversed(levels[:-1]):  # all siblings from a node up
                    rest = [b"".join(_sides(level, i)) + rest[i // ARITY] for i in range(len(level))]
                for i, s in enumerate(r["slots"]):
                    now, k = levels[0][i] if s["changed"] is None else bytes(s["changed"]).hex().encode(), i
                    for level in levels[:-1]:
                        left, right = _sides(level, k)
                        now, k = sha256(left + now + right).hexdigest().encode(), k // ARITY
                    for left, right in up:
                        now = sha256(left + now + right).hexdigest().encode()
                    folded = now.decode()
                    values = (s["id"], r["g"][1:] if r["g"] else None, levels[0][i].decode(), r["subroot"], r["root"], sha256(rest[i]).hexdigest(), folded, folded == r["root"])
                    for n, v in zip(names, values, strict=True):
                        out[n].append(v)
            kinds = [pa.int64(), *[pa.string()] * 6, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, kinds, strict=True)], names)

    rows = arrays.join(above, ["g", "at"])
    return rows.mapInArrow(prove, f"`{key}` long, `{group}` string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def manifest(docs: DataFrame, key: str, group: str, fields: tuple[str, ...] = FIELDS, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, group, leaf, subroot, root, proof_sha256, folded_root, verified.

    folded_root is what the leaf of the row, after line ends are deleted from the texts of about half of the rows, gives
    with the siblings of the untampered tree.
    """
    rows = written(leaves(docs, key, group, fields, text), "leaves")
    sizes = written(rows.groupBy("g").agg(F.sum("n").alias("m")), "sizes")
    placed = written(ranked(rows), "ranked")
    counts = F.broadcast(sizes) if sizes.count() <= 100_000 else sizes
    first = written(_arrays(placed.join(counts, "g"), ["id", "leaf", "changed"]), "arrays")
    rounds, tops = _climbed(first, "leaf")
    n_groups = tops.count()
    over = _numbered(tops.select("g", "node")).select(F.lit("").alias("g"), F.lit(n_groups).cast("long").alias("m"), "rank", "node", F.col("g").alias("of"))
    over = written(over, "subroots")
    top_rounds, root = _climbed(written(_arrays(over.select("g", "m", "rank", "node"), ["node"]), "arrays"), "node")
    whole = root.select("g", F.lit(0).cast("long").alias("at"), F.array().cast(_PATH).alias("path"), F.lit("").alias("subroot"), F.lower(F.hex("node")).alias("root"))
    for arrays in reversed(top_rounds):
        whole = written(_paths(arrays, whole), "paths")
    by_group = over.join(whole.select(F.col("at").alias("rank"), "path", "root"), "rank").select(F.col("of").alias("g"), F.lit(0).cast("long").alias("at"), "path", F.lower(F.hex("node")).alias("subroot"), "root")
    by_group = written(by_group.join(tops.select("g", "round"), "g"), "subroot-paths")
    above = None
    for k in range(len(rounds), 0, -1):
        own = by_group.where(F.col("round") == k).drop("round")
        above = own if above is None else own.unionByName(above)
        if k > 1:
            above = written(_paths(rounds[k - 1], above), "paths")
    return _leaf_rows(first, above, key, group)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, subroots, root and proofs of all documents, by source."""
    return manifest(read(spark, sf_dir, "documents"), "doc_id", "source")


_STEP = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
_CRC = f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda d: ascii(d)::bigint)), lambda c, b: {_STEP}), 4294967295)"


def _sql_leaf(text: str) -> str:
    parts = (f"coalesce(octet_length(encode({v}::varchar))::varchar || ':' || {v}::varchar, '-')" for v in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256({' || '.join(parts)})"


#: Nodes of all levels by recursion, siblings by self join, and the fold level by level.
ORACLE_SQL = {
    "op12_merkle_manifest": f"""
with recursive rows_ as (
  select row_number() over () as r, doc_id, coalesce('=' || source, '') as g, {_sql_leaf('text')} as leaf,
    case when {_CRC} % 2 = 0 then {_sql_leaf("replace(text, chr(10), '')")} end as changed
  from documents
), leaf_ as (
  select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by g) as m from rows_
), node_ as (
  select g, 0 as lv, i, m, leaf as node from leaf_
  union all
  select g, lv + 1, i // 3, any_value((m + 2) // 3), sha256(string_agg(node, '' order by i)) from node_ where m > 1 group by g, lv, i // 3
), sub_ as (
  select g, node as subroot, row_number() over (order by g) - 1 as i, count(*) over () as m from node_ where m = 1
), top_ as (
  select 0 as lv, i, m, subroot as node from sub_
  union all
  select lv + 1, i // 3, any_value((m + 2) // 3), sha256(string_agg(node, '' order by i)) from top_ where m > 1 group by lv, i // 3
), side_ as (
  select l.r, n.lv, n.i, n.node, n.i < l.i // pow(3, n.lv)::bigint as is_left
  from leaf_ l join node_ n on n.g = l.g and n.i // 3 = l.i // pow(3, n.lv + 1)::bigint and n.i <> l.i // pow(3, n.lv)::bigint and n.m > 1
  union all
  select l.r, n.lv + 100, n.i, n.node, n.i < s.i // pow(3, n.lv)::bigint
  from leaf_ l join sub_ s on s.g = l.g join top_ n on n.i // 3 = s.i // pow(3, n.lv + 1)::bigint and n.i <> s.i // pow(3, n.lv)::bigint and n.m > 1
), step_ as (
  select r, lv, coalesce(string_agg(node, '' order by i) filter (where is_left), '') as l, coalesce(string_agg(node, '' order by i) filter (where not is_left), '') as rt from side_ group by r, lv
), every_ as (
  select l.r, n.lv from leaf_ l join (select distinct g, lv from node_ where m > 1) n on n.g = l.g
  union all select l.r, n.lv + 100 from leaf_ l, (select distinct lv from top_ where m > 1) n
), run_ as (
  select e.r, row_number() over (partition by e.r order by e.lv) as k, coalesce(s.l, '') as l, coalesce(s.rt, '') as rt from every_ e left join step_ s on s.r = e.r and s.lv = e.lv
), fold_ as (
  select r, 0 as k, coalesce(changed, leaf) as h from leaf_
  union all
  select f.r, u.k::integer, sha256(u.l || f.h || u.rt) from fold_ f join run_ u on u.r = f.r and u.k = f.k + 1
), end_ as (
  select r, arg_max(h, k) as folded_root from fold_ group by r
), proof_ as (
  select r, sha256(coalesce(string_agg(l || rt, '' order by k), '')) as proof_sha256 from run_ group by r
)
select l.doc_id, case when l.g <> '' then substr(l.g, 2) end as source, l.leaf, s.subroot, t.node as root, coalesce(p.proof_sha256, sha256('')) as proof_sha256, e.folded_root, e.folded_root = t.node as verified
from leaf_ l join sub_ s on s.g = l.g join top_ t on t.m = 1 join end_ e on e.r = l.r left join proof_ p on p.r = l.r"""
}
