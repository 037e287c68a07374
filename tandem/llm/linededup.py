r"""Line dedup by winnowing over line hashes, in DataFrame functions alone.

Lines are what stands between \n; those with a word (`[^\x20\x09-\x0D]+`) count. A line is deleted if it lies in a run of lines
of `words` words or more that also stands at an earlier place. Places are in order of doc_id, then of lines.

From each line on, and up to each line, the shortest run of so many words is a window; its line with the smallest hash is its fingerprint.
Runs that repeat share windows, and those share fingerprints, so only the positions of fingerprints whose hash occurs twice are joined. A position
brings the hashes (128 bits) of the windows that it stands for, so frequent lines do not join unrelated texts, and a match is a hash that occurs earlier:
all but the first place of a window goes. The windows that lead up to a line extend a match forward and those that start at one extend it backward, line by
line, as far as any earlier place has the same run; so a tail that only a later copy shares is found too, and no two copies are paired.

A run that overlaps itself repeats from its second line on, so of a periodic run the first period stays, and of other runs the first occurrence.
Equal rows (doc_id and text) are one document and are cut alike; rows with equal doc_id and different texts are ordered by a hash of
the text. Null doc_ids come last. Null texts stay null, empty ones empty. Lines without words are never deleted. A text is never cut for its length. Extra
columns pass through, renamed if they clash; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Workspace, read, unclash, with_first
from .divergence import let

WORDS = 50
ADDED = ["n_lines", "n_deleted", "n_words_deleted", "clean_text"]


def line_rows(documents: DataFrame) -> DataFrame:
    """doc_id, tk (hash of the text), pos, h (hash of the line), n (its words), of lines with words."""
    lines = documents.where("text is not null").select("doc_id", F.xxhash64("text").alias("tk"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.select("doc_id", "tk", "pos", F.xxhash64("line").alias("h"), F.regexp_count("line", F.lit(WORD)).cast("long").alias("n")).where("n > 0")


def fingerprints(lines: DataFrame, words: int) -> DataFrame:
    """One row for each line that is the smallest of a window: doc_id, tk, h and the windows that it stands for (hashes r, q, first and last line a, b by pos).

    Everything is by document, so the lines move once.
    """
    in_order = Window.partitionBy("doc_id", "tk").orderBy("pos")
    e = F.sum("n").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    rows = lines.withColumn("e", e).withColumn("c", F.col("e") - F.col("n"))
    ahead = Window.partitionBy("doc_id", "tk").orderBy("c").rangeBetween(0, words - 1)
    behind = Window.partitionBy("doc_id", "tk").orderBy("e").rangeBetween(1 - words, 0)
    run = lambda w: F.struct(F.collect_list("h").over(w).alias("run"), F.min(F.struct("h", "pos")).over(w).alias("least"), F.min("pos").over(w).alias("a"), F.max("pos").over(w).alias("b"), (F.max("e").over(w) - F.min("c").over(w)).alias("n"))
    rows = rows.select("doc_id", "tk", run(ahead).alias("ahead"), run(behind).alias("behind"))
    window = lambda x: F.struct(x["least"].alias("least"), F.struct(F.xxhash64(F.lit(0), x["run"]).alias("r"), F.xxhash64(F.lit(1), x["run"]).alias("q"), x["a"].alias("a"), x["b"].alias("b")).alias("w"))
    each = F.transform(F.filter(F.array("ahead", "behind"), lambda x: x["n"] >= words), window)
    found = rows.select("doc_id", "tk", F.explode(each).alias("x"))
    return found.groupBy("doc_id", "tk", F.col("x.least").alias("least")).agg(F.collect_set("x.w").alias("windows")).select("doc_id", "tk", F.col("least.h").alias("h"), "windows")


def repeated_runs(documents: DataFrame, words: int, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tk, n_lines; doc_id, tk and runs, the lines to delete as disjoint ranges of pos)."""
    # dealt by document before all that follows, which needs no other exchange; equal rows give equal lines
    lines = line_rows(documents).repartition("doc_id", "tk").dropDuplicates(["doc_id", "tk", "pos"])
    lines = ws.keep(lines)
    sizes = lines.groupBy("doc_id", "tk").agg(F.count("*").alias("n_lines"))
    prints = ws.keep(fingerprints(lines, words))
    shared = prints.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    windows = ws.keep(with_first(prints, shared, ["h"], "n", ws).select("doc_id", "tk", F.explode("windows").alias("w")).select("doc_id", "tk", "w.*"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tk", "a")
    first = windows.groupBy("r", "q").agg(F.count("*").alias("copies"), F.min(place).alias("first")).where("copies > 1")
    later = with_first(windows, first, ["r", "q"], "copies", ws).where(place != F.col("first")).select("doc_id", "tk", "a", "b")
    # overlapping windows of a document become one range
    order = Window.partitionBy("doc_id", "tk").orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = later.withColumn("new", (reach.isNull() | (F.col("a") > reach)).cast("int")).withColumn("range", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ranges = marked.groupBy("doc_id", "tk", "range").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return sizes, ws.keep(ranges.groupBy("doc_id", "tk").agg(F.collect_list(F.struct("a", "b")).alias("runs")))


def dedup(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """documents with n_lines and n_deleted (lines with words), n_words_deleted and clean_text."""
    documents = unclash(documents, [*ADDED, "tk", "_d", "_k", "_n_lines", "_runs", "_cut"])
    ws = Workspace(documents.sparkSession, "lines")
    sizes, runs = repeated_runs(documents, words, ws)
    key = lambda df: df.withColumnsRenamed({"doc_id": "_d", "tk": "_k"})
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("tk") == F.col("_k"))
    counts = sizes.join(key(runs), same, "left").select("doc_id", "tk", F.col("n_lines").alias("_n_lines"), F.col("runs").alias("_runs"))
    out = documents.withColumn("tk", F.xxhash64("text")).join(key(counts), same, "left")

    def cut(lines):
        inside = F.flatten(F.transform("_runs", lambda x: F.sequence(x["a"], x["b"])))
        gone = F.filter(inside, lambda p: F.get(lines, p).rlike(WORD))
        return let(gone, lambda g: F.struct(
            F.size(g).cast("long").alias("n"), F.aggregate(g, F.lit(0).cast("long"), lambda s, p: s + F.regexp_count(F.get(lines, p), F.lit(WORD))).alias("words"),
            F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), g), lambda p: F.get(lines, p)), "\n").alias("text"),
        ))

    out = out.withColumn("_cut", F.when(F.col("_runs").isNotNull(), let(F.split("text", "\n", -1), cut)))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select(*documents.columns, zero("_n_lines").alias("n_lines"), zero("_cut.n").alias("n_deleted"), zero("_cut.words").alias("n_words_deleted"), F.coalesce("_cut.text", "text").alias("clean_text"))


def op5_winnowed_lines(spark, sf_dir):
    found = dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_deleted", "n_words_deleted", F.length("clean_text").cast("long").alias("n_chars_kept"), F.md5(F.col("clean_text")).alias("clean_md5"))


SQL = r"""
with l as (select doc_id, pos, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n
  from (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from documents where text is not null) where regexp_matches(line, '[^\x20\x09-\x0D]')),
p as (select *, (row_number() over w)::int as i, sum(n) over w as e, sum(n) over w - n as c from l window w as (partition by doc_id order by pos rows between unbounded preceding and current row)),
t as (select doc_id, list(line order by i) as lines from p group by doc_id),
pairs as (select a.doc_id, a.i as a, b.i as b from p a join p b on a.doc_id = b.doc_id and b.e - a.c >= 50 and (b.c - a.c < 50 or b.e - a.e < 50)),
w as (select *, min({'d': doc_id, 'a': a}) over (partition by run) as place from (select doc_id, a, b, md5(array_to_string(lines[a : b], chr(10))) as run from pairs join t using (doc_id))),
gone as (select distinct doc_id, unnest(range(a, b + 1)) as i from w where {'d': doc_id, 'a': a} <> place),
k as (select p.*, gone.i is not null as gone from p left join gone using (doc_id, i)),
s as (select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_deleted, coalesce(sum(n) filter (where gone), 0)::bigint as n_words_deleted, list(pos) filter (where gone) as spots from k group by doc_id),
o as (select d.doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_deleted, 0)::bigint as n_deleted, coalesce(n_words_deleted, 0)::bigint as n_words_deleted,
  case when coalesce(n_deleted, 0) = 0 then text else array_to_string([string_split(text, chr(10))[x + 1] for x in range(len(string_split(text, chr(10)))) if not list_contains(spots, x)], chr(10)) end as clean from documents d left join s using (doc_id))
select doc_id, n_lines, n_deleted, n_words_deleted, len(clean)::bigint as n_chars_kept, md5(clean) as clean_md5 from o
"""
