"""Differences of two texts by characters and by words."""

from __future__ import annotations

import re
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions import text as T

CELLS, CHANGES = 50_000, 24
PARTS = "array<struct<type:string,value:string>>"


def part(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), value.alias("value"))


def common_length(a: Column, b: Column, most: Column) -> Column:
    """Code points at the beginning that two texts share, `most` at most: blocks of halving length are compared, each where the last one ended."""
    longer = lambda n, step: F.when((n + step <= most) & (F.substr(a, n + 1, step) == F.substr(b, n + 1, step)), n + step).otherwise(n)
    return F.aggregate(F.array(*[F.lit(1 << k) for k in reversed(range(30))]), F.lit(0), longer)


def prefix_suffix(old: Column, new: Column) -> Column:
    """Common beginning, what was deleted, what was inserted, common end; empty parts left out."""
    fields = lambda s, *names: [s[c].alias(c) for c in names]

    def measured(s):
        head = common_length(s["a"], s["b"], F.least(s["n"], s["m"]))
        return T.let(F.struct(*fields(s, "a", "b", "n", "m"), head.alias("h")), with_tail)

    def with_tail(s):
        both = F.struct(F.reverse(s["a"]).alias("a"), F.reverse(s["b"]).alias("b"))
        tail = T.let(both, lambda r: common_length(r["a"], r["b"], F.least(s["n"], s["m"]) - s["h"]))
        return T.let(F.struct(*fields(s, "a", "b", "n", "m", "h"), tail.alias("t")), build)

    def build(s):
        a, b, n, m, h, t = (s[c] for c in ("a", "b", "n", "m", "h", "t"))
        every = F.array(part("same", F.left(a, h)), part("del", F.substr(a, h + 1, n - h - t)), part("ins", F.substr(b, h + 1, m - h - t)), part("same", F.substr(a, n - t + 1, t)))
        return F.filter(every, lambda p: p["value"] != "")

    x, y = T.text_of(old), T.text_of(new)
    return T.let(F.struct(x.alias("a"), y.alias("b"), F.length(x).alias("n"), F.length(y).alias("m")), measured)


def lcs_parts(old: str, new: str) -> list[dict]:
    """Longest common subsequence of characters, runs merged; read backward, an insertion goes before a deletion of equal worth."""
    a, b = np.array(list(old)), np.array(list(new))
    best = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(1, len(a) + 1):  # a row at a time: the running maximum carries the left neighbour
        same = b == a[i - 1]
        best[i, 1:] = np.maximum.accumulate(np.maximum(best[i - 1, 1:], np.where(same, best[i - 1, :-1] + 1, 0)))
    out, i, j = [], len(a), len(b)
    while i or j:
        if i and j and a[i - 1] == b[j - 1]:
            kind, ch, i, j = "same", a[i - 1], i - 1, j - 1
        elif j and (not i or best[i, j - 1] >= best[i - 1, j]):
            kind, ch, j = "ins", b[j - 1], j - 1
        else:
            kind, ch, i = "del", a[i - 1], i - 1
        if out and out[-1]["type"] == kind:
            out[-1]["value"].append(ch)
        else:
            out.append({"type": kind, "value": [ch]})
    return [{"type": p["type"], "value": "".join(map(str, reversed(p["value"])))} for p in reversed(out)]


@F.pandas_udf(ArrayType(StructType([StructField("type", StringType()), StructField("value", StringType())])))
def exact(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([lcs_parts(a, b) if a is not None and b is not None else None for a, b in zip(old, new)], dtype=object)


def diff(rows: DataFrame, old: str, new: str, out: str = "diff", cells: int = CELLS) -> DataFrame:
    """rows with the parts of a difference: exact up to so many cells, common ends beyond. Pairs that need no table never reach Python."""
    a, b = T.text_of(old), T.text_of(new)
    small = (F.length(a).cast("long") * F.length(b) <= cells) & (a != b)
    found = rows.withColumn("_exact", exact(F.when(small, a), F.when(small, b)))
    equal = F.when(a == "", F.array().cast(PARTS)).otherwise(F.array(part("same", a)))
    return found.withColumn(out, F.when(a == b, equal).when(small, F.col("_exact")).otherwise(prefix_suffix(a, b))).drop("_exact")


def html(parts: Column) -> Column:
    tagged = lambda p: F.when(p["type"] == "same", T.escape_html(p["value"])).otherwise(F.concat(F.lit("<"), p["type"], F.lit(">"), T.escape_html(p["value"]), F.lit("</"), p["type"], F.lit(">")))
    return F.array_join(F.transform(parts, tagged), "")


def compact(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, pos, type, value) with runs of a type merged, numbered from 0."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("pos")
    run = F.sum(F.coalesce((F.col("type") != F.lag("type").over(w)).cast("int"), F.lit(0))).over(w)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]), "")
    return parts.withColumn("run", run).groupBy(*keys, "run", "type").agg(joined.alias("value"))


# ---- words ----

#: What makes a word, and white space other than line breaks. Any other character is a token of its own, so ideographs are.
WORD = r"a-zA-Z0-9_\u00AD\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u02C6\u02C8-\u02D7\u02DE-\u02FF\u1E00-\u1EFF"
BLANK = r"\t\x0B\f \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
TOKENS = re.compile(rf"\r?\n|[{WORD}]+|[{BLANK}]+|[^{WORD}]")
TRIMMED = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Numbers of fronts that are remembered on the way; beyond, every second one is forgotten and worked out again on the way back.
REMEMBERED, NOWHERE = 1 << 22, -(1 << 30)
#: Numbers of fronts that pairs worked out together may have at most, and pairs whose tokens are in memory.
TOGETHER, MANY = 1 << 23, 1000


class Edits:
    """A shortest edit script of two sequences of numbers: the front of the furthest places on every diagonal, an edit at a time (Myers 1986).

    Place x of a and y of b stand on diagonal x - y. Of two ways to a diagonal the one further in a is taken, and a deletion where both are as far. All
    diagonals of a step are arrays. Memory is REMEMBERED numbers and the fronts of one stride between two that are remembered, not all fronts.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.n, self.m = len(a), len(b)
        self.a, self.b = np.append(a, -1), np.append(b, -2)
        front = np.full(self.n + self.m + 3, NOWHERE, np.int32)
        front[self.m + 1] = 0
        self.extend(front, np.zeros(1, np.int64))
        self.kept, self.edits, self.stride = [front.copy()], 0, 1
        while front[self.n + 1] < self.n:
            self.step(front, self.edits + 1)
            self.edits += 1
            if self.edits % self.stride == 0:
                self.kept.append(front.copy())
                if len(self.kept) * len(front) > REMEMBERED and len(self.kept) > 2 * self.stride:
                    self.kept, self.stride = self.kept[::2], 2 * self.stride

    def diagonals(self, d: int) -> np.ndarray:
        low = -d if d <= self.m else -self.m + (d - self.m) % 2
        high = d if d <= self.n else self.n - (d - self.n) % 2
        return np.arange(low, high + 1, 2)

    def step(self, front: np.ndarray, d: int) -> None:
        k = self.diagonals(d)
        at = k + self.m + 1
        insert, delete = front[at + 1], front[at - 1] + 1
        can_insert, can_delete = (insert >= 0) & (insert - k <= self.m), (delete > 0) & (delete <= self.n)
        front[at] = np.where(can_insert & (~can_delete | (delete <= insert)), insert, np.where(can_delete, delete, NOWHERE))
        self.extend(front, k)

    def extend(self, front: np.ndarray, k: np.ndarray) -> None:
        """Goes on along each diagonal while both sides are equal; those that do are compared in longer and longer blocks."""
        k, size = k[front[k + self.m + 1] >= 0], 1
        while len(k):
            x = front[k + self.m + 1]
            along = np.arange(size)
            same = self.a[np.minimum(x[:, None] + along, self.n)] == self.b[np.minimum((x - k)[:, None] + along, self.m)]
            whole = same.all(axis=1)
            front[k + self.m + 1] += np.where(whole, size, same.argmin(axis=1)).astype(np.int32)
            k, size = k[whole], min(8 * size, 4096)

    def script(self) -> list[tuple[str, int]]:
        """(`del`, place in a) and (`ins`, place in b) in order."""
        out, k, d = [], self.n - self.m, self.edits
        while d:
            first = (d - 1) // self.stride
            fronts = [self.kept[first].copy()]
            for i in range(first * self.stride + 1, d):
                fronts.append(fronts[-1].copy())
                self.step(fronts[-1], i)
            for front in reversed(fronts):
                insert, delete = int(front[k + self.m + 2]), int(front[k + self.m]) + 1
                can_insert, can_delete = insert >= 0 and insert - k <= self.m, 0 < delete <= self.n
                if can_insert and (not can_delete or delete <= insert):
                    out.append(("ins", insert - k - 1))
                    k += 1
                else:
                    out.append(("del", delete - 1))
                    k -= 1
            d = first * self.stride
        return out[::-1]


def scripts(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[list[tuple[str, int]]]:
    """The scripts of Edits of many pairs, which take each edit together: a row of the front is a pair. All fronts are remembered, so pairs come in sets that fit."""
    n, m = (np.array([len(p[i]) for p in pairs], np.int32) for i in (0, 1))
    wide, high = int(n.max()), int(m.max())
    a, b = np.full((len(pairs), wide + 1), -1, np.int32), np.full((len(pairs), high + 1), -2, np.int32)
    for i, (x, y) in enumerate(pairs):
        a[i, : len(x)], b[i, : len(y)] = x, y
    a, b = a.ravel(), b.ravel()
    starts = [np.arange(len(pairs), dtype=np.int32) * (width + 1) for width in (wide, high)]

    def along(places: np.ndarray, low: int) -> None:
        """Goes on along every second diagonal from low."""
        x = np.maximum(places, 0)
        x_at, y_at = starts[0][rows, None] + x, starts[1][rows, None] + x
        y_at -= low + 2 * np.arange(places.shape[1], dtype=np.int32)
        # most go no further, so all are compared in one place first; where there is nothing, the place is any
        at, flat, size = np.flatnonzero((a.take(x_at, mode="clip") == b.take(y_at, mode="clip")) & (places >= 0)), places.ravel(), 1
        flat[at] += 1
        who, col = np.divmod(at, places.shape[1])
        who, k = rows[who], (low + 2 * col).astype(np.int32)
        while len(at):
            x, more = flat[at], np.arange(size)
            same = a[starts[0][who, None] + np.minimum(x[:, None] + more, n[who, None])] == b[starts[1][who, None] + np.minimum((x - k)[:, None] + more, m[who, None])]
            whole = same.all(axis=1)
            flat[at] += np.where(whole, size, same.argmin(axis=1)).astype(np.int32)
            at, k, who = at[whole], k[whole], who[whole]
            size = min(4 * size, 4096)

    rows, edits, d = np.arange(len(pairs)), np.zeros(len(pairs), np.int64), 0
    front = np.full((len(pairs), wide + high + 3), NOWHERE, np.int32)
    first = np.zeros((len(pairs), 1), np.int32)
    along(first, 0)
    front[:, high + 1 : high + 2] = first
    told = [(rows, 0, first)]
    while True:
        going = front[np.arange(len(rows)), n[rows] - m[rows] + high + 1] < n[rows]
        edits[rows[~going]] = d
        if not going.all():
            rows, front = rows[going], front[going]
        if not len(rows):
            break
        d += 1
        low = -d if d <= high else -high + (d - high) % 2
        top = d if d <= wide else wide - (d - wide) % 2
        k, at = np.arange(low, top + 1, 2, dtype=np.int32), low + high + 1
        end = at + 2 * len(k) - 1
        insert, delete = front[:, at + 1 : end + 1 : 2], front[:, at - 1 : end - 1 : 2] + 1
        can_insert, can_delete = (insert >= 0) & (insert - k <= m[rows, None]), (delete > 0) & (delete <= n[rows, None])
        places = np.where(can_insert & (~can_delete | (delete <= insert)), insert, np.where(can_delete, delete, NOWHERE)).astype(np.int32)
        along(places, low)
        front[:, at:end:2] = places
        told.append((rows, low, places))
    inserts, spots, k = np.zeros((d, len(pairs)), bool), np.zeros((d, len(pairs)), np.int64), (n - m).astype(np.int64)
    for step in range(d, 0, -1):
        who = np.flatnonzero(edits >= step)
        rows, low, places = told[step - 1]
        at = np.searchsorted(rows, who)

        def reached(to: np.ndarray) -> np.ndarray:
            col = (to - low) // 2  # noqa: B023
            return np.where((col >= 0) & (col < places.shape[1]), places[at, np.clip(col, 0, places.shape[1] - 1)], NOWHERE)  # noqa: B023

        insert, delete = reached(k[who] + 1), reached(k[who] - 1) + 1
        can_insert, can_delete = (insert >= 0) & (insert - k[who] <= m[who]), (delete > 0) & (delete <= n[who])
        chosen = can_insert & (~can_delete | (delete <= insert))
        inserts[step - 1, who], spots[step - 1, who] = chosen, np.where(chosen, insert - k[who] - 1, delete - 1)
        k[who] += np.where(chosen, 1, -1)
    return [[("ins" if c else "del", s) for c, s in zip(inserts[:e, i].tolist(), spots[:e, i].tolist())] for i, e in enumerate(edits.tolist())]


def every_script(pairs: list[tuple[np.ndarray, np.ndarray]], most: int = TOGETHER) -> list[list[tuple[str, int]]]:
    """Scripts in order of the pairs, like ones in size together, as many as `most` numbers of fronts hold; a pair beyond that goes by itself and forgets fronts."""
    out: list = [None] * len(pairs)
    size = [len(a) + len(b) + 1 for a, b in pairs]
    chosen: list[int] = []

    def flush() -> None:
        if chosen:
            for i, script in zip(chosen, scripts([pairs[i] for i in chosen])):
                out[i] = script
            chosen.clear()

    for i in sorted(range(len(pairs)), key=size.__getitem__):
        if size[i] ** 2 // 2 > most:
            out[i] = Edits(*pairs[i]).script()
            continue
        if (len(chosen) + 1) * (size[i] ** 2 // 2) > most:
            flush()
        chosen.append(i)
    flush()
    return out


def word_parts_of(old: list[str], new: list[str]) -> list[list[dict]]:
    """For each pair the parts {type, value} of a shortest difference by words: what stays, goes and comes, in order."""
    tokens = [(TOKENS.findall(a), TOKENS.findall(b)) for a, b in zip(old, new)]
    numbered = []
    for x, y in tokens:
        number: dict[str, int] = {}
        numbered.append(tuple(np.array([number.setdefault(t, len(number)) for t in side], np.int32) for side in (x, y)))
    return [assembled(x, y, script) for (x, y), script in zip(tokens, every_script(numbered))]


def word_parts(old: str, new: str) -> list[dict]:
    return word_parts_of([old], [new])[0]


def assembled(x: list[str], y: list[str], script: list[tuple[str, int]]) -> list[dict]:
    """Parts of a script of tokens."""
    out, i, j = [], 0, 0

    def stays(to: int) -> None:
        if to > i:
            out.append({"type": "same", "value": "".join(x[i:to])})

    for (kind, _), run in groupby(enumerate(script), lambda e: (e[1][0], e[1][1] - e[0])):
        places = [place for _, (_, place) in run]
        to = places[0] if kind == "del" else i + places[0] - j
        stays(to)
        i, j = to, j + to - i
        out.append({"type": kind, "value": "".join((x if kind == "del" else y)[p] for p in places)})
        i, j = (i + len(places), j) if kind == "del" else (i, j + len(places))
    stays(len(x))
    return out


@F.pandas_udf(ArrayType(StructType([StructField("type", StringType()), StructField("value", StringType())])))
def _word_parts(old: pd.Series, new: pd.Series) -> pd.Series:
    some = (old.notna() & new.notna()).to_numpy()
    out = pd.Series([None] * len(old), index=old.index, dtype=object)
    at = np.flatnonzero(some)
    for begin in range(0, len(at), MANY):  # so many pairs at a time, so that their tokens are not all in memory
        part = at[begin : begin + MANY]
        for i, parts in zip(part.tolist(), word_parts_of(old.iloc[part].tolist(), new.iloc[part].tolist())):
            out.iat[i] = parts
    return out


def word_diff(old: Column, new: Column) -> Column:
    """Parts of a shortest difference by words. Equal texts never reach Python."""
    a, b = T.text_of(old), T.text_of(new)
    equal = F.when(a == "", F.array().cast(PARTS)).otherwise(F.array(part("same", a)))
    return F.when(a == b, equal).otherwise(_word_parts(F.when(a != b, a), F.when(a != b, b)))


def word_changes(parts: Column, most: int = CHANGES) -> Column:
    """Lines of what goes and comes, without white space at their ends; empty ones do not count, and after `most` there are no more."""
    line = lambda p: F.concat(F.when(p["type"] == "del", "- ").otherwise("+ "), F.trim(p["value"], F.lit(TRIMMED)))
    return F.slice(F.transform(F.filter(parts, lambda p: (p["type"] != "same") & (F.trim(p["value"], F.lit(TRIMMED)) != "")), line), 1, most)


def summary(old: Column, new: Column, left: str = "非原文 B", right: str = "非原文 C") -> Column:
    changes = F.array_join(word_changes(word_diff(old, new)), "\n")
    return F.when(changes == "", "差异辅助未发现明显词级差异。").otherwise(F.concat(F.lit(f"{left} -> {right}简体化\n"), changes))
