r"""N-gram Jaccard join, size-aware: subsets for light sets, inverted lists for heavy ones.

A document's set is its distinct k-word shingles as 63-bit hashes (words `[^\x20\x09-\x0D]+`, A-Z lower-cased; fewer words
make one shingle; none, an empty set, which links with nothing). Sets of documents that are equal form one class with one
hash; only classes are joined, so copies cost one row each. Two classes link if 100 * intersection >= percent * union.

Light sets, up to a boundary, enumerate their subsets of the sizes that a link needs as overlap; classes that link share
one. Heavy sets enter the inverted lists of the first shingles of their prefix: of a link's two sets the prefixes share a
shingle in any order that all sets use. That order is by frequency, rare first, counted over all documents; the frequent ones
are told by at most `max_hot` shingles, which are broadcast. Shingles beyond count as rare, which costs time only. Sets near
the boundary do both. The boundary is the largest size up to which subsets cost less than the lists that would be scanned,
by the measured length of a list.

Before two sets meet, the counts of their shingles by the first eight bits bound their intersection; pairs that this
excludes are dropped, so sets are only fetched for pairs that nearly link.

In each list, classes are first compared with the one that has the fewest rarer shingles, so a group of near copies takes a row for each
member. What the links found join is one component; then only pairs of a list that are still in different components and pass the
size and position bounds are compared. No link between components is lost; within one they add nothing. A long list is no group of one task: its first
members are looked up in a broadcast of checked size, and the pairs left are dealt by the logarithm of the set's size, as linked sizes stand
in the same class or the next, and in slices of `SLICE` members.

63-bit hashes stand for shingles and sets: of some 10^9 distinct texts two are expected to share one with a chance of a few per cent, and would count as equal.

Null texts are empty. Null doc_ids are members without a number. Texts of any length are hashed whole, in blocks. Repeated rows keep their rows. Extra columns pass through; an empty table gives an empty one.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HEAVY, MAX_HEAVY, Workspace, mix, read, shingle_sets, unclash, with_first
from .components import connected_components

MAX_HOT, LEAST_HOT, MAX_LIGHT, CHECK_COST, MAX_NODES = 500_000, 16, 40, 8.0, 2_000_000
#: Members of one task of a list that is compared.
SLICE = 256
#: Shingles that are sorted and sent to be counted at once, and that one count is to take.
RUN, PER_COUNT = 1 << 20, 2 << 20


def overlap(a: int, b: int, percent: int) -> int:
    """Least intersection with which sets of these sizes link."""
    return -(-percent * (a + b) // (100 + percent))


def prefix(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def subset_sizes(n: int, percent: int) -> list[int]:
    """Sizes of the subsets that a light set of n shingles enumerates: the overlaps that its links may need."""
    partners = range(-(-percent * n // 100), 100 * n // percent + 1)
    return sorted({c for b in partners if b > 0 and (c := overlap(n, b, percent)) <= min(n, b)})


def light_boundary(percent: int, list_length: float, most: int = MAX_LIGHT) -> int:
    n = 0
    while n < most and sum(comb(n + 1, c) for c in subset_sizes(n + 1, percent)) <= CHECK_COST * prefix(n + 1, percent) * (1 + list_length):
        n += 1
    return n


def subset_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """Negative keys of the subsets of a light set."""
    with np.errstate(over="ignore"):
        each, out = mix(s), []
        whole = np.add.reduce(each)
        for c in subset_sizes(len(s), percent):
            gone = np.array([np.add.reduce(each[list(x)]) if x else np.uint64(0) for x in combinations(range(len(s)), len(s) - c)], np.uint64)
            out.append(mix(whole - gone + np.uint64(c)) >> np.uint64(1))
        return -(np.concatenate(out).astype(np.int64)) - 1


def set_hash(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(np.add.reduce(mix(s + np.uint64(1)), keepdims=True) + np.uint64(len(s)))[0].astype(np.int64)) if len(s) else 0


def frequent(documents: DataFrame, k: int, ws: Workspace, max_hot: int) -> tuple[int, np.ndarray, np.ndarray, float]:
    """(bits of a shingle's hash that were counted, frequent shingles by them, classes of frequency, mean list length of the rest).

    Tasks send sorted runs of distinct shingles, dealt by their first bits, as differences and counts in bytes by significance, so a shingle of every document
    is one value of a run; each deal is counted by itself. The number of deals follows the number of documents.
    """
    b = max(6, int(np.ceil(np.log2(max(1, documents.count() * 600 / PER_COUNT)))))
    shift = 63 - b - 32

    def deal(batches):
        def send(run):
            keys = np.sort(np.concatenate(run) >> np.uint64(max(0, shift)))
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            keys, counts = keys[first], np.diff(np.append(first, len(keys)))
            cuts = np.searchsorted(keys, np.arange((1 << b) + 1, dtype=np.uint64) << np.uint64(32))
            some = np.flatnonzero(cuts[1:] > cuts[:-1])
            planes = lambda x: x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
            blobs = [planes(np.diff(keys[cuts[i] : cuts[i + 1]] & np.uint64(0xFFFFFFFF), prepend=np.uint64(0))) + planes(counts[cuts[i] : cuts[i + 1]]) for i in some]
            return pa.RecordBatch.from_pydict({"deal": pa.array(some, pa.int32()), "run": pa.array(blobs, pa.binary())})

        held, n = [], 0
        for batch in batches:
            for s in shingle_sets(batch.column(0), k):
                held.append(s)
                n += len(s)
                if n >= RUN:
                    yield send(held)
                    held, n = [], 0
        if n:
            yield send(held)

    def count(key, table):
        parts = [np.ascontiguousarray(np.frombuffer(x.as_buffer(), np.uint8).reshape(2, 4, -1).transpose(0, 2, 1)).view("<u4")[..., 0] for x in table.column("run")]
        values, counts = np.concatenate([np.cumsum(x[0], dtype=np.uint32) for x in parts]), np.concatenate([x[1] for x in parts])
        order = np.argsort(values, kind="stable")
        values, counts = values[order], counts[order]
        starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
        n = np.add.reduceat(counts.astype(np.int64), starts)
        hot, rare = n >= LEAST_HOT, n[n < LEAST_HOT].astype(np.int64)
        tokens = (np.int64(key[0].as_py()) << 32) | values[starts[hot]].astype(np.int64)
        return pa.table({"token": pa.array(np.append(tokens, [-1, -2]), pa.int64()), "n": pa.array(np.append(n[hot], [rare.sum(), (rare**2).sum()]), pa.int64())})

    counted = ws.keep(documents.select("text").mapInArrow(deal, "deal int, run binary").groupBy("deal").applyInArrow(count, "token long, n long"))
    sums = {r.token: r.n for r in counted.where("token < 0").groupBy("token").agg(F.sum("n").alias("n")).collect()}
    level = F.floor(F.log2("n")).cast("int")
    levels = sorted(((r.level, r.c) for r in counted.where("token >= 0").groupBy(level.alias("level")).agg(F.count("*").alias("c")).collect()), reverse=True)
    least, total = 99, 0
    for lv, c in levels:
        total += c
        if total > max_hot:
            break
        least = lv
    hot = counted.where("token >= 0").where(level >= least).select("token", level.alias("level")).toPandas().sort_values("token")
    return max(0, shift), hot.token.to_numpy(np.int64), hot.level.to_numpy(np.uint8), sums.get(-2, 0) / max(1, sums.get(-1, 0))


def signed(documents: DataFrame, k: int, percent: int, hot, light: int) -> DataFrame:
    """documents' columns but text, with n_shingles, node (hash of the set; null if empty), keys (list shingles in order, then subsets) and sketch.

    Copies that a task has met before come without keys and sketch.
    """
    shared = documents.sparkSession.sparkContext.broadcast(hot)
    kept = [c for c in documents.columns if c != "text"]

    def run(batches):
        shift, tokens, levels, _ = shared.value
        met = set()
        for batch in batches:
            n, node, keys, sketch = [], [], [], []
            for s in shingle_sets(batch.column(batch.schema.get_field_index("text")), k):
                n.append(len(s))
                node.append(set_hash(s) if len(s) else None)
                mine = []
                if node[-1] is None or node[-1] in met:
                    keys.append(np.zeros(0, np.int64))
                    sketch.append(None)
                    continue
                met.add(node[-1])
                sketch.append(np.minimum(np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes())
                if len(s) > light or 100 * len(s) >= percent * (light + 1):
                    p = prefix(len(s), percent)
                    if len(tokens):
                        at = (s >> np.uint64(shift)).astype(np.int64)
                        i = np.minimum(np.searchsorted(tokens, at), len(tokens) - 1)
                        level = np.where(tokens[i] == at, levels[i], 0)
                        s_ordered = s[np.lexsort((s, level))] if level.any() else s
                    else:
                        s_ordered = s
                    mine.append(s_ordered[:p].astype(np.int64))
                if 0 < len(s) <= light:
                    mine.append(subset_keys(s, percent))
                keys.append(np.concatenate(mine) if mine else np.zeros(0, np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in keys])))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *keys]), pa.int64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], pa.array(n, pa.int64()), pa.array(node, pa.int64()), lists, pa.array(sketch, pa.binary())], names=[*kept, "n_shingles", "node", "keys", "sketch"])

    from pyspark.sql import types as T

    schema = T.StructType([*[documents.schema[c] for c in kept], T.StructField("n_shingles", T.LongType()), T.StructField("node", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())])
    return documents.mapInArrow(run, schema)


def sets_of(documents: DataFrame, nodes: DataFrame, k: int, ws: Workspace) -> DataFrame:
    """(node, shingles) of the given classes, from the texts again. A list of nodes of bounded size is broadcast, a longer one joined."""
    few = nodes.limit(MAX_NODES + 1).count() <= MAX_NODES
    shared = documents.sparkSession.sparkContext.broadcast(np.sort(nodes.toPandas()["node"].to_numpy(np.int64)) if few else None)

    def run(batches):
        wanted = shared.value
        for batch in batches:
            node, sets = [], []
            for s in shingle_sets(batch.column(0), k):
                if len(s):
                    h = set_hash(s)
                    if wanted is None or (i := np.searchsorted(wanted, h)) < len(wanted) and wanted[i] == h:
                        node.append(h)
                        sets.append(s.tobytes())
            yield pa.RecordBatch.from_pydict({"node": pa.array(node, pa.int64()), "shingles": pa.array(sets, pa.binary())})

    found = documents.select("text").mapInArrow(run, "node long, shingles binary")
    if not few:
        found = found.join(nodes, "node", "left_semi")
    return found.dropDuplicates(["node"])


def near(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose shingles by first bits leave room for a link; sketches are (node, n, sketch)."""

    def check(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, 256) for c in (batch.column(3), batch.column(5)))
            most = np.minimum(x, y).sum(1, dtype=np.int64)
            full = ((x == 255) | (y == 255)).any(1)  # counts that may be higher bound nothing
            total = batch.column(2).to_numpy() + batch.column(4).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(full | (100 * most >= percent * (total - most))))

    left = sketches.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("s"))
    right = sketches.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("t"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "s", "nb", "t").mapInArrow(check, "a long, b long")


def verified(pairs: DataFrame, documents: DataFrame, k: int, percent: int, ws: Workspace) -> DataFrame:
    """Those of the pairs (a, b) of classes that link."""
    nodes = ws.keep(pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct())
    sets = ws.keep(sets_of(documents, nodes, k, ws))

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(a) > len(b):
                    a, b = b, a
                shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                keep.append(100 * shared >= percent * (len(a) + len(b) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("s"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("t"))
    out = ws.keep(pairs.join(left, "a").join(right, "b").select("a", "b", "s", "t").mapInArrow(check, "a long, b long"))
    ws.drop(nodes, sets)
    return out


def may_link(n: str, pos: str, m: str, qos: str, percent: int):
    """Whether sizes n, m and, in an inverted list, places pos, qos of the shared shingle leave room for a link."""
    big, small = F.greatest(n, m), F.least(n, m)
    room = 1 + F.least(F.col(n) - F.col(pos), F.col(m) - F.col(qos)) - 1
    return (100 * small >= percent * big) & ((F.col("key") < 0) | (room * (100 + percent) >= percent * (F.col(n) + F.col(m))))


def links(documents: DataFrame, rows: DataFrame, k: int, percent: int, ws: Workspace) -> DataFrame:
    """Links (a, b) between classes that join all that belongs together; rows as signed() gives them."""
    known = rows.where("sketch is not null").select("node", F.col("n_shingles").alias("n"), "sketch").dropDuplicates(["node"])
    every = rows.where("node is not null").select("node", F.col("n_shingles").cast("int").alias("n"), F.posexplode("keys").alias("pos", "key"))
    # keys of many postings are counted before anything is dealt by key; theirs are dealt in slices, whose leads are few
    heavy = ws.keep(every.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > HEAVY).select("key", F.ceil(F.col("c") / HEAVY).cast("int").alias("slices")).limit(MAX_HEAVY))
    sliced = every.join(F.broadcast(heavy), "key", "left").withColumn("slice", F.coalesce(F.pmod(F.xxhash64("node"), F.col("slices")).cast("int") + 1, F.lit(0)))
    postings = sliced.select("node", "n", "pos", "key", "slice").repartition("key", "slice").dropDuplicates(["key", "slice", "node"])
    first = postings.groupBy("key", "slice").agg(F.count("*").alias("c"), F.min(F.struct("pos", "n", "node")).alias("lead")).where("c > 1 or slice > 0")
    parts = ws.keep(postings.join(first, ["key", "slice"]).select("key", "node", "n", "pos", "c", "lead"))
    whole = parts.join(F.broadcast(heavy.select("key")), "key").groupBy("key").agg(F.count("*").alias("_c"), F.min("lead").alias("_lead"))
    joined = parts.join(F.broadcast(whole), "key", "left").withColumns({"c": F.coalesce("_c", "c"), "lead": F.coalesce("_lead", "lead")})
    lists = ws.keep(joined.select("key", "node", "n", "pos", "c", F.col("lead.node").alias("lead"), F.col("lead.n").alias("m"), F.col("lead.pos").alias("qos")))
    ws.drop(parts)
    pair = [F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")]
    stars = ws.keep(lists.where("node <> lead").where(may_link("n", "pos", "m", "qos", percent)).select(*pair).distinct())
    close = ws.keep(near(stars, known, percent))
    found = verified(close, documents, k, percent, ws)
    part = connected_components(found, ws)
    # linked sizes are in one class of the logarithm or in neighbouring ones; the base is a little larger than the ratio, which keeps rounding out
    size_class = F.floor(F.log("n") / (np.log(100 / percent) * (1 + 1e-6))).cast("int") if percent < 100 else F.col("n")
    left = lists.where("c > 2").select("key", "node", "n", "pos").join(part, "node", "left").select("key", "node", "n", "pos", F.coalesce("component", "node").alias("label"), size_class.alias("cls"))
    left = ws.keep(left)
    mixed = left.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("c")).where("x < y").select("key", "c")
    left = ws.keep(with_first(left, mixed, ["key"], "c", ws))
    cells = F.ceil(F.col("c") / SLICE).cast("int")
    mine = left.withColumn("cell", F.pmod(F.xxhash64("node"), cells).cast("int"))
    other = left.select("key", F.col("node").alias("lead"), F.col("n").alias("m"), F.col("pos").alias("qos"), F.col("label").alias("tag"), F.explode(F.array(*([F.col("cls") - 1, F.col("cls"), F.col("cls") + 1] if percent < 100 else [F.col("cls")]))).alias("cls"), cells.alias("cells"))
    other = other.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    rest = mine.join(other, ["key", "cls", "cell"]).where("label < tag").where(may_link("n", "pos", "m", "qos", percent)).select(*pair).distinct()
    rest = ws.keep(near(rest.join(stars, ["a", "b"], "left_anti"), known, percent))
    ws.drop(lists, left, stars, close)
    return found if rest.isEmpty() else found.unionAll(verified(rest, documents, k, percent, ws))


def join(documents: DataFrame, k: int = 3, percent: int = 90, max_hot: int = MAX_HOT, columns: list[str] | None = None) -> DataFrame:
    """The given columns of documents (all but text), n_shingles and component_id, the smallest doc_id that links reach."""
    ws = Workspace(documents.sparkSession, "jaccard")
    documents = unclash(documents, {"n_shingles", "node", "keys", "sketch", "component_id"})
    columns = [c for c in documents.columns if c != "text"] if columns is None else columns
    texts = documents.select("text")
    hot = frequent(texts, k, ws, max_hot)
    rows = ws.keep(signed(documents.select(*dict.fromkeys([*columns, "doc_id"]), "text"), k, percent, hot, light_boundary(percent, hot[3])))
    part = connected_components(links(texts, rows, k, percent, ws), ws)
    # the smallest doc_id of each class, then of each component
    classes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("_first")).join(part, "node", "left").withColumn("_part", F.coalesce("component", "node"))
    classes = ws.keep(classes)
    least = classes.groupBy("_part").agg(F.min("_first").alias("component_id"), F.count("*").alias("_members"))
    named = ws.keep(with_first(classes.select("node", "_part"), least, ["_part"], "_members", ws).select(F.col("node").alias("_node"), "component_id"))
    out = rows.join(named, F.col("node") == F.col("_node"), "left")
    return out.select(*columns, "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op10_jaccard_components(spark, sf_dir):
    return join(read(spark, sf_dir, "documents").select("doc_id", "text"), columns=["doc_id"])


SQL = r"""
with recursive w as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as w from documents),
g as (select distinct doc_id, array_to_string(w[i : i + 2], ' ') as g from (select *, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from g group by doc_id),
s as (select a.doc_id as x, b.doc_id as y, count(*) as shared from g a join g b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as (select x, y from s join n p on p.doc_id = x join n q on q.doc_id = y where 100 * shared >= 90 * (p.n + q.n - shared)),
e2 as (select x, y from e union all select y, x from e),
r as (select doc_id as a, doc_id as b from documents union select r.a, e2.y from r join e2 on r.b = e2.x)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id
from w left join n using (doc_id) join (select a as doc_id, min(b) as component_id from r group by a) c using (doc_id)
"""
