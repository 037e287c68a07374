"""Merkle manifest of a dataset: a digest of every row, of every group and of all, with a proof for each row.

Digests are lowercase hexadecimal sha256. A leaf is the digest of a row's fields, each `-` if null, else its number of UTF-8 bytes, `:` and the value. In each
group the leaves stand in order of doc_id, and while more than one node remains, every `fanout` consecutive ones become their digest; the last run may have fewer,
even one. What remains is the group's subroot, and the subroots, in order of the group (null first, by bytes), give the root in the same way.

Levels are tables of nodes (tree, index). On each level a node is joined with its siblings by their computed indices: `index XOR 1` for two, the other slots of its
run otherwise; then the rows in slot 0 emit the parents. As both sides of each join are spread by tree and index, a group of any size is spread too, and the whole takes
time in proportion to the rows, as levels shrink by the fanout. Proofs come back from the root to the leaves: a node's proof is its own siblings before
those of its parent, which it meets by index. Each level is written to the shared folder, so a lost executor costs its tasks alone.

Null doc_ids stand first in their group; rows with equal doc_id are ordered by their leaves, and repeated rows are leaves each. Null fields are told from empty ones. Very long
texts are digested whole. Extra columns pass through, renamed if they clash, but only the named fields enter a leaf; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sql
from .common import Workspace, positions, read, unclash

FIELDS, FANOUT = ("doc_id", "source", "lang", "n_chars", "text"), 2
#: On the way down every fourth level is written; in between the joins follow each other in one job.
WRITTEN = 4
ADDED = ["leaf", "subroot", "root", "path"]
#: A step of a path: what stands before and after the node in its run.
STEP = "struct<before: string, after: string>"


def digest(*parts) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(name: str, value: Column | None = None) -> Column:
    text = (F.col(name) if value is None else value).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields=FIELDS, changed: dict[str, Column] | None = None) -> Column:
    """The digest of a row; `changed` puts other values in place of fields."""
    return digest(*[field(f, (changed or {}).get(f)) for f in fields])


def with_siblings(nodes: DataFrame, fanout: int) -> DataFrame:
    """nodes (tree, idx, hash and others) with `before` and `after`, the digests of the run's other nodes on either side."""
    key = lambda idx: nodes.select(F.col("tree").alias("_tree"), idx.alias("_idx"), F.col("hash").alias("_hash"))
    slot, met, found = F.col("idx") % fanout, nodes, []
    if fanout == 2:
        other = key(F.col("idx").bitwiseXOR(1)).withColumnsRenamed({"_tree": "_t1", "_idx": "_i1", "_hash": "_h1"})
        met = nodes.join(other, (F.col("tree") == F.col("_t1")) & (F.col("idx") == F.col("_i1")), "left")
        text = F.coalesce("_h1", F.lit(""))
        return met.select(*nodes.columns, F.when(slot == 1, text).otherwise("").alias("before"), F.when(slot == 0, text).otherwise("").alias("after"))
    for d in range(1, fanout):
        # the sibling in slot s is that of the node in slot s - d, so it says where it is wanted
        wanted = F.col("idx") - slot + (slot - d + fanout) % fanout
        other = key(wanted).withColumnsRenamed({"_tree": f"_t{d}", "_idx": f"_i{d}", "_hash": f"_h{d}"})
        met = met.join(other, (F.col("tree") == F.col(f"_t{d}")) & (F.col("idx") == F.col(f"_i{d}")), "left")
        found.append(F.struct(((slot + d) % fanout).alias("slot"), F.col(f"_h{d}").alias("hash")))
    run = F.array_sort(F.filter(F.array(*found), lambda x: x["hash"].isNotNull()))
    side = lambda keep: F.array_join(F.transform(F.filter(run, keep), lambda x: x["hash"]), "")
    return met.select(*nodes.columns, side(lambda x: x["slot"] < slot).alias("before"), side(lambda x: x["slot"] > slot).alias("after"))


def levels(nodes: DataFrame, most: int, fanout: int, ws: Workspace) -> list[DataFrame]:
    """Tables of the levels from the leaves up, with before and after; nodes bring tree, idx, hash and n, the number of nodes of their tree. A tree's root has n = 1."""
    out: list[DataFrame] = []
    while True:
        out.append(done := ws.keep(with_siblings(nodes, fanout)))
        if most <= 1:
            return out
        parent = digest(F.col("before"), F.col("hash"), F.col("after"))
        nodes = done.where((F.col("n") > 1) & (F.col("idx") % fanout == 0)).select("tree", F.floor(F.col("idx") / fanout).alias("idx"), parent.alias("hash"), F.ceil(F.col("n") / fanout).alias("n"))
        most = -(-most // fanout)


def paths(tables: list[DataFrame], roots: DataFrame, fanout: int, ws: Workspace) -> DataFrame:
    """The leaves' table with subroot and path, the steps from a leaf to the root. roots has subroot and path of each tree's root, by tree."""
    above = None
    for k in range(len(tables) - 1, -1, -1):
        # the root of a tree gets its path by tree, other nodes get theirs by the index of their parent
        found = tables[k].where("n = 1").join(roots.select(F.col("tree").alias("_tree"), "subroot", "path"), F.col("tree") == F.col("_tree")).drop("_tree")
        if above is not None:
            parents = above.select(F.col("tree").alias("_tree"), F.col("idx").alias("_idx"), "subroot", F.col("path").alias("_path"))
            below = tables[k].where("n > 1").join(parents, (F.col("tree") == F.col("_tree")) & (F.floor(F.col("idx") / fanout) == F.col("_idx")))
            step = F.array(F.struct("before", "after"))
            found = found.unionByName(below.withColumn("path", F.concat(step, "_path")).drop("_tree", "_idx", "_path"))
        above = found if k == 0 else found.select("tree", "idx", "subroot", "path")
        if k % WRITTEN == WRITTEN - 1:
            above = ws.keep(above)
    return above


def manifest(rows: DataFrame, group: str, fields=FIELDS, fanout: int = FANOUT, columns: list[str] | None = None, others: dict[str, Column] | None = None) -> DataFrame:
    """The given columns of rows (all, if None) with leaf, subroot, root and path; `others` are further columns, computed from rows before texts are left behind."""
    if fanout < 2:
        raise ValueError("a run of nodes has two or more")
    rows = unclash(rows, [*ADDED, "tree", "idx", "hash", "n", "before", "after", "pos", "_n", "_group", "_doc", "_tree", "_idx", "_path", "_t1", "_i1", "_h1", "_id", "_part", "_place", "_g", *(others or {})])
    columns = rows.columns if columns is None else columns
    ws = Workspace(rows.sparkSession, "manifest")
    slim = ws.keep(rows.select(*columns, *[c.alias(name) for name, c in (others or {}).items()], leaf(fields).alias("hash"), F.col(group).alias("_group"), F.col("doc_id").alias("_doc")))
    placed, _ = positions(slim, ["_group"], ["_doc", "hash"], ws, total="_n")
    tree = F.coalesce(F.concat(F.lit("g"), F.col("_group").cast("string")), F.lit("-"))
    nodes = placed.select(*columns, *(others or {}), "_group", "hash", tree.alias("tree"), F.col("pos").alias("idx"), F.col("_n").alias("n"))
    most = nodes.agg(F.max("n")).first()[0] or 0
    trees = levels(nodes, most, fanout, ws)
    # the subroots are the nodes without others in their tree; each stands on one level
    subroots = trees[0].where("n = 1").select("tree", "_group", "hash")
    for t in trees[1:]:
        subroots = subroots.unionByName(t.where("n = 1").select("tree", F.when(F.col("tree") != "-", F.substr("tree", F.lit(2))).cast(rows.schema[group].dataType).alias("_group"), "hash"))
    kept = ws.keep(subroots)
    top, _ = positions(kept, [], ["_group"], ws, total="_n")
    top_nodes = top.select(F.lit("top").alias("tree"), F.col("tree").alias("_of"), F.col("pos").alias("idx"), "hash", F.col("_n").alias("n"))
    top_levels = levels(top_nodes, kept.count(), fanout, ws)
    found = top_levels[-1].where("n = 1").select("hash").first()
    root = F.lit(found.hash if found else None).cast("string")
    whole = rows.sparkSession.range(1).select(F.lit("top").alias("tree"), root.alias("subroot"), F.lit(None).cast(f"array<{STEP}>").alias("path"))
    whole = whole.withColumn("path", F.coalesce("path", F.array().cast(f"array<{STEP}>")))
    roots = ws.keep(paths(top_levels, whole, fanout, ws).select(F.col("_of").alias("tree"), F.col("hash").alias("subroot"), "path"))
    return paths(trees, roots, fanout, ws).select(*columns, *(others or {}), F.col("hash").alias("leaf"), "subroot", root.alias("root"), "path")


def proof(path: Column) -> Column:
    """The siblings of a path in order, as one text."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, start, lambda acc, s: digest(s["before"], acc, s["after"]))


def op11_sibling_manifest(spark, sf_dir):
    number = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    tampered = F.when(F.coalesce(number % 7 == 0, F.lit(False)), leaf(changed={"n_chars": F.col("n_chars") + 1})).otherwise(leaf())
    found = manifest(read(spark, sf_dir, "documents"), "lang", columns=["doc_id"], others={"shown": tampered})
    found = found.withColumn("folded_root", fold(F.col("shown"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


SQL = rf"""
with recursive {sql.CRC_TABLE},
d as (select *, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') as head,
  coalesce(strlen(text) || ':' || text, '-') as tail from documents),
leaves as (select doc_id, lang, sha256(head || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || tail) as leaf,
  sha256(head || coalesce(strlen((n_chars + (case when {sql.crc32("doc_id::varchar")} % 7 = 0 then 1 else 0 end))::varchar) || ':' || (n_chars + (case when {sql.crc32("doc_id::varchar")} % 7 = 0 then 1 else 0 end)), '-') || tail) as shown,
  row_number() over (partition by lang order by doc_id) - 1 as idx, count(*) over (partition by lang) as n from d, crc_table),
nodes(lang, k, idx, hash, n) as (select lang, 0, idx, leaf, n from leaves
  union all select lang, k + 1, idx // 2, sha256(string_agg(hash, '' order by idx)), (any_value(n) + 1) // 2 from nodes where n > 1 group by lang, k, idx // 2),
subs as (select lang, hash, row_number() over (order by lang nulls first) - 1 as idx, count(*) over () as n from nodes where n = 1),
tops(k, idx, hash, n) as (select 0, idx, hash, n from subs union all select k + 1, idx // 2, sha256(string_agg(hash, '' order by idx)), (any_value(n) + 1) // 2 from tops where n > 1 group by k, idx // 2),
walk(doc_id, lang, k, idx, n, acc, proof) as (select doc_id, lang, 0, idx, n, shown, '' from leaves
  union all select w.doc_id, w.lang, w.k + 1, w.idx // 2, (w.n + 1) // 2, sha256(case when w.idx % 2 = 1 then s.hash || acc else acc || coalesce(s.hash, '') end), proof || coalesce(s.hash, '')
  from walk w left join nodes s on s.lang is not distinct from w.lang and s.k = w.k and s.idx = xor(w.idx, 1) where w.n > 1),
climb(doc_id, lang, k, idx, n, acc, proof) as (select doc_id, w.lang, 0, subs.idx, subs.n, acc, proof from walk w join subs on subs.lang is not distinct from w.lang where w.n = 1
  union all select w.doc_id, w.lang, w.k + 1, w.idx // 2, (w.n + 1) // 2, sha256(case when w.idx % 2 = 1 then s.hash || acc else acc || coalesce(s.hash, '') end), proof || coalesce(s.hash, '')
  from climb w left join tops s on s.k = w.k and s.idx = xor(w.idx, 1) where w.n > 1)
select leaves.doc_id, leaf, subs.hash as subroot, tops.hash as root, sha256(proof) as proof_sha256, acc as folded_root, acc = tops.hash as verified
from leaves join climb on climb.doc_id = leaves.doc_id and climb.n = 1 join subs on subs.lang is not distinct from leaves.lang, tops where tops.n = 1
"""
