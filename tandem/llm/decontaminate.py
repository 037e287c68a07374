r"""Benchmark decontamination over an FM-index of each training shard.

Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z. A benchmark item's windows are its 10 consecutive words;
an item of fewer words is one window. A shard is the words of some documents of a partition, written in the benchmark's
alphabet: any other word ends a run, and runs shorter than the shortest window hold none. Over the runs stand a suffix
array, its Burrows-Wheeler transform in a wavelet tree, and sampled suffix positions. All windows are searched backward at
once through wavelet-tree ranks; their rows are located by walking to the next sampled position; spans that touch are merged.

A benchmark over `block_bytes` is searched block by block, each block broadcast by itself; of a block only the rows with hits are written, and the
documents once, with numbers that stay. The spans of all blocks are merged at the end, and removal cuts the text once.

Null and empty texts have no words and no hits. Benchmark rows without id or words have no windows. Repeated benchmark ids
count once; repeated documents are judged each for itself. Extra columns pass through, renamed if they clash with the
added ones; an empty table gives an empty one. A text over the shard's size is indexed in overlapping pieces.
"""

from __future__ import annotations

import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, mix, read, unclash

WINDOW, SHARD_WORDS, BLOCK_BYTES, SAMPLED = 10, 1 << 20, 16 << 20, 8
#: On UTF-8 bytes this is the class of the contract: a character over \x7F has only bytes over \x7F.
TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+")
SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
ADDED = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(SPAN)), T.StructField("items", T.ArrayType(T.StringType()))])


class Phrases:
    """Windows of some benchmark items over their own alphabet, 1 and up; 0 is any other word.

    A window is a place in the items' words, laid one after the other, so a block takes some 20 bytes for each of its words. Equal windows
    are one: they are told by a hash and compared; different ones of one hash stay apart.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.alphabet: dict[bytes, int] = {}
        self.ids = sorted({i for i, _ in items})
        number, parts, starts, owners, lengths, at = {x: n for n, x in enumerate(self.ids)}, [], [], [], [], 0
        for item, text in items:
            words = TOKEN.findall(text.lower())
            if not words:
                continue
            parts.append(np.fromiter((self.alphabet.setdefault(w, len(self.alphabet) + 1) for w in words), np.int32, len(words)))
            n = max(1, len(words) - window + 1)
            starts.append(at + np.arange(n))
            owners.append(np.full(n, number[item], np.int32))
            lengths.append(np.full(n, min(window, len(words)), np.int32))
            at += len(words)
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        self.words, starts, owners, lengths = join(parts, np.int32), join(starts, np.int64), join(owners, np.int32), join(lengths, np.int32)
        self.lengths = np.unique(lengths).tolist()
        self.starts, self.owners, self.first = {}, {}, {}
        for n in self.lengths:
            mine = lengths == n
            self._distinct(n, starts[mine], owners[mine])

    def _distinct(self, n: int, starts: np.ndarray, owners: np.ndarray) -> None:
        key = np.zeros(len(starts), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(n):
                key = mix(key + self.words[starts + j].astype(np.uint64)) + np.uint64(j)
        order = np.argsort(key, kind="stable")
        key, starts, owners = key[order], starts[order], owners[order]
        same = key[1:] == key[:-1]
        for j in range(n):
            same &= self.words[starts[1:] + j] == self.words[starts[:-1] + j]
        first = np.flatnonzero(np.concatenate(([True], ~same)))
        self.starts[n], self.owners[n], self.first[n] = starts[first], owners, np.append(first, len(owners))

    def owners_of(self, n: int, window: int) -> list[int]:
        return self.owners[n][self.first[n][window] : self.first[n][window + 1]].tolist()


def suffix_array(ranks: np.ndarray) -> np.ndarray:
    """By prefix doubling. Ranks of separators differ, so suffixes are told apart within a run."""
    n, k = len(ranks), 1
    order = np.argsort(ranks, kind="stable")
    while True:
        by = ranks[order]
        dense = np.empty(n, np.int64)
        dense[order] = np.cumsum(np.concatenate(([0], by[1:] != by[:-1])))
        if dense[order[-1]] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[: n - k] = dense[k:] + 1
        ranks, k = dense * (n + 1) + after, 2 * k
        order = np.argsort(ranks, kind="stable")


class WaveletTree:
    """Ranks and symbols of a sequence: for each bit, from the highest, the zeros before each place, rows parted by it."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = []
        for bit in reversed(range(max(1, top.bit_length()))):
            ones = (symbols >> bit) & 1 == 1
            zeros = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(~ones, out=zeros[1:])
            self.levels.append((bit, zeros))
            symbols = np.concatenate((symbols[~ones], symbols[ones]))

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its end."""
        start = np.zeros_like(ends)
        for bit, zeros in self.levels:
            one = (symbols >> bit) & 1 == 1
            start = np.where(one, zeros[-1] + start - zeros[start], zeros[start])
            ends = np.where(one, zeros[-1] + ends - zeros[ends], zeros[ends])
        return ends - start

    def symbol_rank(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and how often it occurs before."""
        symbols, start = np.zeros_like(places), np.zeros_like(places)
        for bit, zeros in self.levels:
            one = zeros[places + 1] == zeros[places]
            symbols = symbols | (one.astype(np.int64) << bit)
            start = np.where(one, zeros[-1] + start - zeros[start], zeros[start])
            places = np.where(one, zeros[-1] + places - zeros[places], zeros[places])
        return symbols, places - start


class FMIndex:
    """text: symbols from 1, with 0 after each run."""

    def __init__(self, text: np.ndarray, top: int, sampled: int = SAMPLED):
        apart = text == 0
        n_runs = int(apart.sum())
        ranks = text + n_runs
        ranks[apart] = np.arange(n_runs)
        order = suffix_array(ranks)
        self.n = len(text)
        self.tree = WaveletTree(text[order - 1], top)
        self.smaller = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top + 1))))
        kept = (order % sampled == 0) | apart[order - 1]  # and each start of a run, so no walk leaves its run
        self.before = np.concatenate(([0], np.cumsum(kept)))
        self.sample = order[kept]

    def find(self, words: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, place) of every occurrence of the windows of n words that start there."""
        lo, hi, which = np.zeros(len(starts), np.int64), np.full(len(starts), self.n, np.int64), np.arange(len(starts))
        for j in reversed(range(n)):
            symbol = words[starts[which] + j].astype(np.int64)
            lo = self.smaller[symbol] + self.tree.rank(symbol, lo)
            hi = self.smaller[symbol] + self.tree.rank(symbol, hi)
            some = lo < hi
            lo, hi, which = lo[some], hi[some], which[some]
        count = hi - lo
        rows = np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum()) if len(count) else np.zeros(0, np.int64)
        places, todo, walked = np.zeros(len(rows), np.int64), np.arange(len(rows)), 0
        while len(todo):
            there = self.before[rows + 1] > self.before[rows]
            places[todo[there]] = self.sample[self.before[rows[there]]] + walked
            rows, todo, walked = rows[~there], todo[~there], walked + 1
            symbols, rank = self.tree.symbol_rank(rows)
            rows = self.smaller[symbols] + rank
        return np.repeat(which, count), places


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    order = np.lexsort((ends, starts))
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate(([True], starts[1:] > reach[:-1]))
    last = np.concatenate((first[1:], [True]))
    return list(zip(starts[first].tolist(), reach[last].tolist()))


class Shard:
    """Documents of a partition that are indexed together."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.words, self.runs, self.hits = phrases, 0, [], {}

    def add(self, row: int, ids: np.ndarray, offset: int = 0) -> None:
        inside = np.concatenate(([False], ids > 0, [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        for a, b in edges.reshape(-1, 2):
            if b - a >= self.phrases.lengths[0]:
                self.runs.append((row, offset + a, ids[a:b]))
                self.words += b - a + 1

    def search(self) -> None:
        """Adds the hits of the runs so far, then forgets the runs."""
        if not self.runs:
            return
        lengths = np.array([len(r[2]) + 1 for r in self.runs])
        ends = np.cumsum(lengths)
        text = np.zeros(ends[-1], np.int64)
        for end, (_, _, ids) in zip(ends, self.runs):
            text[end - 1 - len(ids) : end - 1] = ids
        index = FMIndex(text, len(self.phrases.alphabet))
        for n in self.phrases.lengths:
            which, places = index.find(self.phrases.words, self.phrases.starts[n], n)
            run = np.searchsorted(ends, places, "right")
            for w, r, at in zip(which.tolist(), run.tolist(), (places - (ends - lengths)[run]).tolist()):
                row, offset, _ = self.runs[r]
                self.hits.setdefault(row, []).append((offset + at, offset + at + n, w, n))
        self.runs, self.words = [], 0

    def take(self, row: int) -> tuple[list, set[int]]:
        hits = self.hits.pop(row, None)
        if not hits:
            return [], set()
        spans = merged(np.array([h[0] for h in hits]), np.array([h[1] for h in hits]))
        return spans, {o for w, n in {(h[2], h[3]) for h in hits} for o in self.phrases.owners_of(n, w)}


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """text without the words of the spans and what stands between them."""
    at = [m.span() for m in TOKEN.finditer(text.lower())]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, text[last:]])


def hits(phrases: Phrases, texts: list[bytes | None], window: int, shard_words: int) -> tuple[list, list, list]:
    """Of each text the number of words, the merged spans and the items."""
    get, shard, done = phrases.alphabet.get, Shard(phrases), 0
    n_words, spans, items = [0] * len(texts), [[]] * len(texts), [[]] * len(texts)

    def finish(to):
        shard.search()
        for i in range(done, to):
            spans[i], owners = shard.take(i)
            items[i] = sorted(phrases.ids[o] for o in owners)

    for i, text in enumerate(texts):
        words = TOKEN.findall(text.lower()) if text else []
        n_words[i] = len(words)
        if phrases.lengths:
            ids = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
            for a in range(0, len(ids), shard_words):
                shard.add(i, ids[a : a + shard_words + window - 1], a)
                if len(ids) > shard_words and shard.words >= shard_words:
                    shard.search()
            if shard.words >= shard_words:
                finish(i + 1)
                done = i + 1
    finish(len(texts))
    return n_words, spans, items


ARROW_SPANS, ARROW_ITEMS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())


def span_column(spans: list) -> pa.Array:
    return pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], ARROW_SPANS)


def texts_of(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()


def completed(batch: pa.RecordBatch, names: list[str], texts: list, n_words: list, spans: list, items: list, remove: bool) -> pa.RecordBatch:
    """A batch with the added columns and, with remove, its texts cut."""
    columns = {f.name: batch.column(k) for k, f in enumerate(batch.schema)}
    if remove:
        columns["text"] = pa.array([cut(t, s) if s else t for t, s in zip(texts, spans)], pa.binary()).cast(pa.string())
    columns |= {"n_words": pa.array(n_words, pa.int64()), "hit_spans": span_column(spans), "items": pa.array(items, ARROW_ITEMS)}
    return pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)


def _search(shared, names: list[str], window: int, shard_words: int, remove: bool):
    """All of the job, for a benchmark of one block."""

    def run(batches):
        for batch in batches:
            texts = texts_of(batch)
            yield completed(batch, names, texts, *hits(shared.value, texts, window, shard_words), remove)

    return run


def _search_block(shared, row: str, window: int, shard_words: int):
    """(row, spans, items) of the rows that one block of several hits."""

    def run(batches):
        for batch in batches:
            _, spans, items = hits(shared.value, texts_of(batch), window, shard_words)
            some = [i for i, s in enumerate(spans) if s]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(row)).take(pa.array(some, pa.int64())), span_column([spans[i] for i in some]), pa.array([items[i] for i in some], ARROW_ITEMS)], names=["row", "found", "owners"])

    return run


def _complete(names: list[str], remove: bool):
    """The added columns from the spans and items that several blocks found."""

    def run(batches):
        for batch in batches:
            texts, column = texts_of(batch), lambda c: batch.column(batch.num_columns + c).to_pylist()  # noqa: B023
            spans = [merged(np.array([x["start"] for x in s]), np.array([x["end"] for x in s])) if s else [] for s in column(-2)]
            yield completed(batch, names, texts, [len(TOKEN.findall(t.lower())) if t else 0 for t in texts], spans, [sorted(set(o or [])) for o in column(-1)], remove)

    return run


def benchmark_blocks(benchmark: DataFrame, block_bytes: int):
    """Lists of (id, text), each of bounded size."""
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    sized = rows.withColumn("_size", F.octet_length("text").cast("long"))
    total = sized.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    n = -(-total // block_bytes)
    if n <= 1:
        yield [(r.item_id, r.text.encode()) for r in rows.collect()]
        return
    # bytes before each row: those of its task before it and those of the tasks before, so no task holds the whole benchmark
    ws = Workspace(benchmark.sparkSession, "benchmark")
    kept = ws.keep(sized.repartitionByRange("item_id", "text").withColumn("_id", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_id", 33))
    parts = kept.groupBy("_part").agg(F.sum("_size").alias("_sum"))
    parts = parts.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    upto = F.col("_before") + F.sum("_size").over(Window.partitionBy("_part").orderBy("_id"))
    dealt = ws.keep(kept.join(F.broadcast(parts), "_part").select("item_id", "text", F.floor((upto - 1) / block_bytes).alias("_block")))
    for b in range(n):
        if block := [(r.item_id, r.text.encode()) for r in dealt.where(F.col("_block") == b).collect()]:
            yield block


def find_hits(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES, remove: bool = False) -> DataFrame:
    """documents with n_words, hit_spans (word numbers, end exclusive, merged) and items; with remove, text goes without the hits."""
    spark = documents.sparkSession
    documents = unclash(documents, ADDED.names)
    schema = T.StructType([*documents.schema.fields, *ADDED.fields])
    blocks = benchmark_blocks(benchmark, block_bytes)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        shared = spark.sparkContext.broadcast(Phrases(first, window))
        return documents.mapInArrow(_search(shared, schema.names, window, shard_words, remove), schema)
    row = "_row"
    while row in documents.columns:
        row = f"_{row}"
    ws, found = Workspace(spark, "decontaminate"), None
    kept = ws.keep(documents.withColumn(row, F.monotonically_increasing_id()))
    slim = T.StructType([T.StructField("row", T.LongType()), T.StructField("found", T.ArrayType(SPAN)), T.StructField("owners", T.ArrayType(T.StringType()))])
    for block in chain([first, second], blocks):
        shared = spark.sparkContext.broadcast(Phrases(block, window))
        part = ws.keep(kept.select(row, "text").mapInArrow(_search_block(shared, row, window, shard_words), slim))
        shared.unpersist()
        found = part if found is None else found.unionAll(part)
    # a row comes from each block at most once
    merged_ = found.groupBy("row").agg(F.flatten(F.collect_list("found")).alias("found"), F.flatten(F.collect_list("owners")).alias("owners"))
    joined = kept.join(merged_.withColumnsRenamed({"row": "_hit_row", "found": "_hit_found", "owners": "_hit_owners"}), F.col(row) == F.col("_hit_row"), "left")
    return joined.select(*documents.columns, F.col("_hit_found"), F.col("_hit_owners")).mapInArrow(_complete(schema.names, remove), schema)


def op1_benchmark_leaks(spark, sf_dir):
    found = find_hits(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


SQL = r"""
with dw as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents),
bw as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bwin as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[i : i + 9], ' ') as win
  from (select *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from bw where len(w) > 0)),
dwin as (select doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') as win
  from (select doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) as s from dw, (select distinct n from bwin))),
hits as (select doc_id, s, dwin.n, item_id from dwin join bwin on dwin.win = bwin.win and dwin.n = bwin.n),
words as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(s, s + n)) as p from hits) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as list from (select distinct doc_id, item_id::varchar as item from hits) group by doc_id)
select dw.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(list, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join words using (doc_id) left join items using (doc_id)
"""
