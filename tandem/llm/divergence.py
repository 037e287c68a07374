r"""Quality rules by distribution divergence, in DataFrame functions alone.

Words are `[^\x20\x09-\x0D]+`. Base rules count words, their characters, symbols, repeated lines and words in repeated 3-word windows.
Then two histograms of each document, of character classes and of its language's common words, are compared by
Jensen-Shannon distance (base 2, 0 to 1) with the mean over all documents of the language that pass the base rules. A
document goes if a distance exceeds its limit. Short texts scatter, so each test waits for a minimum length and its limit
falls with the length.

Null and empty texts have no words, so the base rules fail them. A null or unlisted language has no common words, so only
its character classes are compared, with those of the same (or null) language. A language in which no document passes has no reference and no verdict but the base's. Repeated rows are judged each for itself. Extra columns pass
through, renamed if they clash; an empty table gives an empty one. Lines are equal if all their characters are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, read, unclash

#: Common words by language.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not", "he", "this", "are"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "plus", "pas", "au", "sur"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al"],
}
#: Character classes; what none of them takes is the last.
CLASSES = [r"\p{Ll}", r"\p{Lu}", r"\p{Nd}", r"[\x20\x09-\x0D]", r"[.,;:'\x22?()\-]", r"[#*$%&|<>]", r"!"]
MIN_CHARS, MIN_WORDS = 200, 60
#: A distance may be the first number plus the second divided by the characters or words counted.
MAX_CLASS, MAX_WORD = (0.13, 50.0), (0.2, 7.0)
MAX_LANGUAGES = 10_000
ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept"]


def let(value: Column, use) -> Column:
    """use(value) with value computed once, however often and wherever it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def removed(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more: windows that sort beside an equal one."""

    def marked(windows: Column) -> Column:
        def twice(x, i):
            before, after = F.get(windows, i - 1), F.get(windows, i + 1)
            return F.when(((i > 0) & (before["h"] == x["h"])) | F.coalesce(after["h"] == x["h"], F.lit(False)), x["i"])

        places = F.array_compact(F.transform(windows, twice))
        return F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(p, p + 1, p + 2)))))

    def count(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(pairs, marked))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, 0).otherwise(let(hashes, count)).cast("long")


def counted(documents: DataFrame) -> DataFrame:
    """documents with the base counts and both histograms, in one pass over the texts without a shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    common = F.create_map(*[x for k, v in COMMON.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    every = sorted({w for v in COMMON.values() for w in v})
    listed = F.when(F.col("lang").isin(list(COMMON)), F.element_at(common, F.col("lang")))
    hits = F.filter(F.transform("_words", F.lower), lambda w: w.isin(every))
    taken = [removed(text, c).cast("long") for c in CLASSES]
    return (
        documents.withColumn("_words", F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != ""))
        .withColumns({
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": removed(text, r"[#*$%&|<>]+").cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": let(F.col("_words"), repeat_words),
            "_class": F.array(*taken),
            "_common": let(hits, lambda x: F.transform(listed, lambda w: F.size(F.filter(x, lambda y: y == w)).cast("long"))),
            "_chars": F.length(text).cast("long"),
        })
        .drop("_words")
        .withColumn("_class", F.concat("_class", F.array(F.col("_chars") - F.aggregate("_class", F.lit(0).cast("long"), lambda a, x: a + x))))
        .withColumn("_common", F.concat("_common", F.array(F.col("n_words") - F.aggregate("_common", F.lit(0).cast("long"), lambda a, x: a + x))))
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    )


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms; null if one is empty or null."""

    def total(h):
        return F.aggregate(h, F.lit(0.0), lambda a, x: a + x)

    def term(x, y):
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    shares = lambda h, n: F.transform(h, lambda x: x / n)
    both = F.zip_with(shares(p, total(p)), shares(q, total(q)), lambda x, y: (term(x, y) + term(y, x)) / 2)
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(F.greatest(total(both), F.lit(0.0))))


def judge(documents: DataFrame, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS, max_class=MAX_CLASS, max_word=MAX_WORD, columns: list[str] | None = None) -> DataFrame:
    """documents (or the given columns) with the base counts, both distances and the verdict `kept`."""
    documents = unclash(documents, [*ADDED, "_words", "_class", "_common", "_chars", "_lang", "_class_all", "_common_all"])
    columns = documents.columns if columns is None else columns
    ws = Workspace(documents.sparkSession, "divergence")
    counts = ws.keep(counted(documents).select(*dict.fromkeys([*columns, "lang", *ADDED[:6], "_class", "_common", "_chars"])))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    sums = lambda c, n: F.array(*[F.sum(F.get(c, F.lit(i)) / total(c)) for i in range(n)])  # noqa: E731  each document counts alike
    k = max(map(len, COMMON.values())) + 1
    reference = ws.keep(counts.where("not base_failed").groupBy(F.col("lang").alias("_lang")).agg(sums("_class", len(CLASSES) + 1).alias("_class_all"), F.filter(sums("_common", k), lambda x: x.isNotNull()).alias("_common_all")))
    if reference.limit(MAX_LANGUAGES + 1).count() <= MAX_LANGUAGES:
        reference = F.broadcast(reference)
    joined = counts.join(reference, F.col("lang").eqNullSafe(F.col("_lang")), "left").withColumns({
        "class_distance": F.when(F.col("_chars") >= min_chars, distance(F.col("_class"), F.col("_class_all"))),
        "word_distance": F.when(F.col("n_words") >= min_words, distance(F.col("_common"), F.col("_common_all"))),
    })
    over = lambda c, most, n: F.coalesce(F.col(c) > most[0] + most[1] / F.col(n), F.lit(False))
    far = over("class_distance", max_class, "_chars") | over("word_distance", max_word, "n_words")
    return joined.withColumn("kept", ~F.col("base_failed") & ~far).select(*columns, *ADDED)


def op2_divergence_rules(spark, sf_dir):
    found = judge(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), columns=["doc_id"])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_LISTED = "case lang " + " ".join(f"when '{lang}' then [{', '.join(repr(w) for w in listed)}]" for lang, listed in COMMON.items()) + " end"
_TAKEN = ", ".join(f"len(t) - len(regexp_replace(t, '{c.replace(chr(39), chr(39) * 2)}', '', 'g'))" for c in CLASSES)
_SHARES = "[x / list_sum({0})::double for x in {0}]"
_TERM = "case when {0} > 0 then {0} * log2(2 * {0} / ({0} + {1})) else 0.0::double end"
_DISTANCE = "sqrt(greatest(list_sum([(" + _TERM.format("x[1]", "x[2]") + " + " + _TERM.format("x[2]", "x[1]") + ") / 2 for x in list_zip({0}, {1})]), 0.0::double))"

SQL = rf"""
with d as (select doc_id, lang, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] as lines, [{_TAKEN}] as cs, {_LISTED} as listed from d),
g as (select doc_id, i, count(*) over (partition by doc_id, g) as c from (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w))),
r as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from g where c > 1) group by doc_id),
c as (select w.doc_id, lang, len(t) as chars, len(w) as n_words, len(array_to_string(w, '')) as word_chars, cs[6] as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words,
  list_append(cs, len(t) - list_sum(cs)) as hc, [len(list_filter(w, lambda x: lower(x) = k)) for k in listed] as ks from w left join r using (doc_id)),
b as (select *, list_append(ks, n_words - coalesce(list_sum(ks), 0)) as hk, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from c),
h as (select *, case when chars > 0 then {_SHARES.format('hc')} end as pc, case when n_words > 0 and ks is not null then {_SHARES.format('hk')} end as pk from b),
m as (select lang, kind, list(s order by i) as total from (select lang, kind, i, sum(x) as s from (
    select lang, 'c' as kind, unnest(range(len(pc))) as i, unnest(pc) as x from h where not base_failed union all select lang, 'k', unnest(range(len(pk))), unnest(pk) from h where not base_failed) group by all) group by lang, kind),
q as (select lang, kind, {_SHARES.format('total')} as q from m),
j as (select h.*, case when chars >= {MIN_CHARS} then {_DISTANCE.format('pc', 'a.q')} end as dc, case when n_words >= {MIN_WORDS} then {_DISTANCE.format('pk', 'z.q')} end as dk
  from h left join q a on a.kind = 'c' and a.lang is not distinct from h.lang left join q z on z.kind = 'k' and z.lang is not distinct from h.lang)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
  not base_failed and not coalesce(dc > {MAX_CLASS[0]}::double + {MAX_CLASS[1]}::double / chars, false) and not coalesce(dk > {MAX_WORD[0]}::double + {MAX_WORD[1]}::double / n_words, false) as kept from j
"""
