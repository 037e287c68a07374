"""Text columns: normalisation, n-gram similarity, block and heading tests, small scalar helpers. All are Column builders; NFKC and the scores of long rows run in Arrow batches."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from . import points

#: White space as the web's regular expressions have it, for use inside a character class.
WS = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: The same characters themselves.
BLANKS = "\t\n\x0b\x0c\r " + "".join(map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
ZERO_WIDTH = r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}]"
#: What the script-aware normaliser deletes beside white space.
CJK_DROPPED = r"「」『』“”‘’（）()【】《》〈〉—\-─…、，。！？：；,.!?;:0-9a-z"
#: What may end a sentence.
SENTENCE_MARKS = r"[。．.!！？?」』”’）)]"

_NUMBER = "[一二三四五六七八九十0-9０-９]+"
#: Chapter headings by role.
HEADINGS = {
    "tw": rf"^(第{_NUMBER}卷\s+)?(序\s*章(?:\s+.*)?|行間\s*{_NUMBER}|第{_NUMBER}(?:章|話)(?:\s+.*)?|終章(?:\s+.*)?)\s*$",
    "cn": rf"^(序\s*章(?:\s+.*)?|行间\s*{_NUMBER}|第{_NUMBER}(?:章|话)(?:\s+.*)?|终章(?:\s+.*)?)\s*$",
    "jp": rf"^(序\s*章(?:\s+.*)?|行間\s*{_NUMBER}|第{_NUMBER}(?:章|話)(?:\s+.*)?|終章(?:\s+.*)?)\s*$",
}
#: A picture's placeholder, and lines that only part sections. No group repeats, as repeated groups are matched by recursion.
MEDIA = rf"(?i)\[[{WS}]*+(?:(?:图片|圖片|图像|圖像|插图|插圖|image|img|p\d{{1,5}}+)[{WS}]*+)?\]"
SEPARATOR = rf"^[\-─－—＊*☆★{WS}]+$"
#: What only blocks before the body hold, in letters of either case.
FRONT_WORDS = ["本電子書籍", "本电子书籍", "リーディングシステム", "再ダウンロード", "ePub3", "Reasily", "图书观看", "內容由", "内容由", "试看学习交流", "商業用途", "商业用途", "转载时请保留", "如有任何问题请联系", "汉化组", "漢化組"]
#: Blocks before the body.
FRONT_MATTER = [
    r"(?i)^(contents|目錄|目录|ＣＯＮＴＥＮＴＳ|navigation)$",
    r"(?i)^(制作信息|製作信息|网翻|翻译|翻譯|校对|校對|美工|录入|錄入|简介|簡介)(?:\s|：|:|$)",
    "(?i)" + "|".join(FRONT_WORDS),
]
#: Patterns of titles and authors that stand alone before the body; they are of one book or series, so there are none unless they are given.
SERIES: list[str] = []
SYNOPSIS = r"(?i)^(简介|簡介)(?:\s|：|:|$)"


def let(value: Column, use) -> Column:
    """use(value) with value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text_of(c) -> Column:
    """The column with null as empty text."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


#: Passes over characters of the first block by one look into a table, where a class of ranges would be tested range by range.
BEYOND = f"(?![{''.join(rf'{chr(92)}x{c:02X}' for c in range(0x100))}])"
#: A run of white space other than one blank.
SPREAD = rf"\x20[{WS}]++|[\x09\x0A\x0B\x0C\x0D\xA0][{WS}]*+|{BEYOND}[\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{FEFF}}][{WS}]*+"


def strip(c) -> Column:
    return F.btrim(text_of(c), F.lit(BLANKS))


def collapse(c) -> Column:
    """White space runs as one blank, ends trimmed. Single blanks are such runs as they are."""
    return F.trim(F.regexp_replace(text_of(c), SPREAD, " "))


def read_text(c) -> Column:
    """Without byte order mark, line breaks as \\n."""
    return F.regexp_replace(F.regexp_replace(text_of(c), r"^\x{FEFF}", ""), r"\r\n?", "\n")


def document_text(c) -> Column:
    t = F.regexp_replace(read_text(c), r"\x{A0}", " ")
    for pattern, by in ((r"[ \t]+\n", "\n"), (r"\n[ \t]+", "\n"), (r"\n{3,}", "\n\n")):
        t = F.regexp_replace(t, pattern, by)
    return strip(t)


def text_length(c) -> Column:
    """Code points other than white space."""
    return F.length(F.regexp_replace(text_of(c), rf"[{WS}]+", ""))


def utf16_length(c) -> Column:
    t = text_of(c)
    return F.length(t) + F.regexp_count(t, F.lit(r"[\x{10000}-\x{10FFFF}]"))


_STABLE = [*range(0xA0), *range(0xA1, 0xA8), 0xA9, *range(0xAB, 0xAF), 0xB0, 0xB1, 0xB6, 0xB7, 0xBB, *range(0xBF, 0x100)]
#: Begins a text with a character that NFKC may change: the rest of the first two blocks is neither changed by it nor composed. Single characters are looked
#: up in a table by the JVM, ranges are tested one after the other, so none are used.
UNSTABLE = f"^[{''.join(rf'{chr(92)}x{c:02X}' for c in _STABLE)}]*+(?s:.)"
#: Zero-width characters and white space, those of the first block by a table.
NOTHING = rf"[\x09\x0A\x0B\x0C\x0D\x20\xA0]+|{BEYOND}[\x{{1680}}\x{{2000}}-\x{{200D}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{2060}}\x{{3000}}\x{{FEFF}}]+"


#: What the script-aware normaliser deletes, that of the first block by a table; ideographs are passed over by one test.
DROPPED = r"[\x09\x0A\x0B\x0C\x0D\x20\xA0()\-,.!?;:0123456789abcdefghijklmnopqrstuvwxyz]+|(?![\x{4E00}-\x{9FFF}])[「」『』“”‘’（）【】《》〈〉—─…、，。！？：；\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def canonical(c, compatibility: bool = True) -> Column:
    """NFKC, no zero-width characters or white space, lower case. Only texts that NFKC may change leave the JVM."""
    t = text_of(c)
    t = F.coalesce(nfkc(F.when(t.rlike(UNSTABLE), t)), t) if compatibility else t
    return F.lower(F.regexp_replace(t, NOTHING, ""))


def similarity_text(canon: Column) -> Column:
    return F.regexp_replace(canon, r"[\p{P}\p{S}]", "")


def script_text(simplified: Column) -> Column:
    """What the version similarity compares: simplified script, lower case, without punctuation, white space, digits and Latin letters."""
    return F.regexp_replace(F.lower(simplified), DROPPED, "")


def bigrams(c: Column) -> Column:
    """Distinct neighbouring pairs of code points; of a shorter text its characters. The pairs are the twos of the text and those of the text from its second character on."""
    twos = lambda t: F.regexp_extract_all(t, F.lit(r"(?s).."), F.lit(0))

    def pairs(t: Column) -> Column:
        return F.when(t == "", F.array().cast("array<string>")).when(F.length(t) == 1, F.array(t)).otherwise(F.array_distinct(F.concat(twos(t), twos(F.substr(t, F.lit(2))))))

    return let(text_of(c), pairs)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets: 1 if both are empty, 0 if one is. Each set is built once, however it is expressed."""

    def ratio(s):
        n, m, both = s["n"], s["m"], s["both"]
        return F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0), 0.0).otherwise(both / (n + m - both))

    sizes = lambda s: F.struct(F.size(s["a"]).alias("n"), F.size(s["b"]).alias("m"), F.size(F.array_intersect(s["a"], s["b"])).alias("both"))
    return let(F.struct(a.alias("a"), b.alias("b")), lambda s: let(sizes(s), ratio))


def length_ratio(a: Column, b: Column) -> Column:
    x, y = F.greatest(a, F.lit(1)), F.greatest(b, F.lit(1))
    return F.least(x, y) / F.greatest(x, y)


def paragraph_score(grams_a: Column, grams_b: Column, length_a: Column, length_b: Column, empty: Column) -> Column:
    """0.72 of the bigram similarity and 0.28 of the length ratio; 0 where a text is empty."""
    return F.when(empty, 0.0).otherwise(jaccard(grams_a, grams_b) * 0.72 + length_ratio(length_a, length_b) * 0.28)


#: Code points of the texts that are scored together.
SCORED = 1 << 20


@F.pandas_udf(DoubleType())
def row_score(a: pd.Series, b: pd.Series, empty: pd.Series) -> pd.Series:
    """paragraph_score of two long texts beside each other."""
    x, y, blank = a.tolist(), b.tolist(), empty.to_numpy(bool)
    sizes, out = [np.array(list(map(len, t)), np.int64) for t in (x, y)], [np.zeros(0)]
    for part in points.pieces(sizes[0] + sizes[1], SCORED):
        out.append(points.pair_scores(*points.row_shared(x[part], y[part]), *(n[part].astype(float) for n in sizes), blank[part]))
    return pd.Series(np.concatenate(out))


def is_structured(canon: Column) -> Column:
    short = (F.length(canon) > 0) & (F.length(canon) <= 32)
    return short & ((canon.rlike(r"\p{N}") & canon.rlike(r"^[\p{N}\p{P}\p{S}]+$")) | (canon.rlike("[a-z0-9]") & canon.rlike(r"^[a-z0-9._:/#%+\-]+$")))


def protected_tokens(canon: Column) -> Column:
    """Runs of Latin letters or of numbers, which two texts must share in order."""
    return F.regexp_extract_all(canon, F.lit(r"([a-z]+|\p{N}+)"), F.lit(1))


def by_role(lang: Column, patterns: dict[str, str], test) -> Column:
    out = F.lit(None)
    for role, pattern in patterns.items():
        out = F.when(lang == role, test(pattern)).otherwise(out)
    return out


def heading(line: Column, lang: Column) -> Column:
    """The trimmed line if it is a chapter heading of its role, else empty."""
    t = strip(line)
    return F.when(F.coalesce(by_role(lang, HEADINGS, t.rlike), F.lit(False)), t).otherwise("")


def is_media(block: Column) -> Column:
    """Whether a block holds placeholders of pictures and nothing else."""
    t = strip(block)
    return F.contains(t, F.lit("[")) & (strip(F.regexp_replace(t, MEDIA, "")) == "")


def is_front_matter(block: Column, lang: Column, series: list[str] = SERIES) -> Column:
    def test(t: Column) -> Column:
        out = (t == "") | is_media(t) | (heading(t, lang) != "")
        for pattern in [*FRONT_MATTER[:-1], *series]:
            out = out | t.rlike(pattern)
        return let(F.lower(t), lambda low: functools.reduce(lambda a, w: a | F.contains(low, F.lit(w.lower())), FRONT_WORDS, out))

    return let(collapse(block), test)


def is_likely_body(block: Column, lang: Column, series: list[str] = SERIES) -> Column:
    def test(t: Column) -> Column:
        n = F.length(F.replace(t, F.lit(" "), F.lit("")))  # a collapsed text has no other white space
        return (n >= 18) & ((n >= 80) | t.rlike(SENTENCE_MARKS)) & ~is_front_matter(t, lang, series)

    return let(collapse(block), test)


#: What parts comparable units, beside the sign that is put after their ends.
UNIT_ENDS = r"[。！？!?\x01]"


def comparable_units(c) -> Column:
    """Sentences: after an end mark and the end marks and closing brackets that follow it, trimmed, none empty."""
    marked = F.regexp_replace(read_text(c), r"([。！？!?][。！？!?」』）)】]*)", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), strip), lambda x: x != "")


def blocks(c) -> Column:
    return F.split(text_of(c), r"\n\s*\n+")


def meaningful_blocks(c) -> Column:
    return F.filter(F.transform(F.split(document_text(c), r"\n\s*\n+"), collapse), lambda x: F.length(x) >= 2)


def is_text_dense(block: Column) -> Column:
    return (text_length(block) >= 20) & ((text_length(block) >= 80) | (F.regexp_count(block, F.lit(r"[。．.!！？?」』”’）)]")) >= 2))


def escape_html(c) -> Column:
    t = text_of(c)
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(mark), F.lit(entity))
    return t


def escape_replace_list(c) -> Column:
    return F.replace(F.replace(text_of(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def percent_ratio(c, fallback: float = 0.92) -> Column:
    """"92%", 92 or 0.92 as a ratio between 0.5 and 1; the fallback where it is no number."""
    raw = strip(c)
    number = F.regexp_replace(raw, "%", "").try_cast("double")
    ratio = F.when(raw.contains("%") | (number > 1), number / 100).otherwise(number)
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    return F.when((raw != "") & finite, F.least(F.greatest(ratio, F.lit(0.5)), F.lit(1.0))).otherwise(fallback)


def format_percent_ratio(c) -> Column:
    percent = percent_ratio(c) * 100
    return F.concat(F.regexp_replace(F.format_string("%.1f", percent), r"\.0$", ""), F.lit("%"))


def clamp_number(c, low: float, high: float, fallback: float) -> Column:
    """null counts as 0 and so becomes the lower bound; only what is no number takes the fallback."""
    text = F.trim((F.col(c) if isinstance(c, str) else c).cast("string"))
    number = F.when(text.isNull() | (text == ""), 0.0).otherwise(text.try_cast("double"))
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    return F.when(finite, F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), number))).otherwise(float(fallback))


def clamp_integer(c, low: int, high: int, fallback: int) -> Column:
    """clamp_number, rounded half up before it is clamped."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.floor(clamp_number(c, low - 1, high + 1, fallback) + 0.5).cast("int")))


def preview(c, most: int = 1200) -> Column:
    t = text_of(c)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.left(t, F.lit(most)), F.lit("\n...（已截断，完整内容已发送给模型）")))


def display_url(c) -> Column:
    """Without credentials, query and fragment. Of a web address scheme and host are in lower case, the scheme's own port goes and an empty path is a slash."""
    t = strip(c)
    plain = F.regexp_extract(text_of(c), r"(?s)^([^?#]*)", 1)
    head = r"(?s)^([A-Za-z]+):[/\\]+(?:[^/\\?#@]*@)?([^/\\?#:@]+)(?::(\d*))?([^?#]*)"
    scheme, host, port, path = F.lower(F.regexp_extract(t, head, 1)), F.lower(F.regexp_extract(t, head, 2)), F.regexp_extract(t, head, 3), F.replace(F.regexp_extract(t, head, 4), F.lit("\\"), F.lit("/"))
    own = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    web = scheme.isin("http", "https") & (host != "")
    return F.when(web, F.concat(scheme, F.lit("://"), host, F.when(own, "").otherwise(F.concat(F.lit(":"), port)), F.when(path == "", "/").otherwise(path))).otherwise(plain)


def api_url(base: Column, endpoint: str) -> Column:
    """base with the endpoint at its end, once."""
    b = F.regexp_replace(strip(base), r"/+$", "")
    return F.when(b.endswith(endpoint), b).otherwise(F.concat(b, F.lit(endpoint)))


def progress(line: Column, prefix: str, low: float = 0.0, high: float = 100.0) -> Column:
    """struct(percent, label, current, total) of a progress line, percent clamped and mapped to a range; null for other lines."""
    data = F.from_json(F.when(line.startswith(prefix), F.substr(line, F.lit(len(prefix) + 1))), "percent double, label string, current long, total long")
    inner = F.greatest(F.lit(0.0), F.least(F.lit(100.0), data["percent"]))
    mapped = F.floor((low + (high - low) * inner / 100) * 10 + 0.5) / 10
    return F.when(data["percent"].isNotNull(), F.struct(mapped.alias("percent"), data["label"].alias("label"), data["current"].alias("current"), data["total"].alias("total")))


def line_rows(chunks, keys: list[str], order: str, text: str = "text"):
    """Lines of streams that come in pieces (keys, order, text): keys, line_no from 0, line. A line may be spread over pieces; the last one needs no end."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), text_of(text).alias("t")))), lambda x: x["t"])
    whole = chunks.groupBy(*keys).agg(F.regexp_replace(F.array_join(rows, ""), r"\r\n?", "\n").alias("_whole"))
    lines = F.split(F.regexp_replace("_whole", r"\n$", ""), "\n", -1)
    return whole.where("_whole <> ''").select(*keys, F.posexplode(lines).alias("line_no", "line"))


def expand_path(c, home: str) -> Column:
    """A path as it is given: quotes and blanks around it go, a leading ~ is the home folder."""
    t = F.regexp_replace(strip(c), r"^[\x22'](.*)[\x22']$", "$1")
    return F.when((t == "~") | t.startswith("~/") | t.startswith("~\\"), F.concat(F.lit(home), F.substr(t, F.lit(2)))).otherwise(t)


def safe_filename(c) -> Column:
    base = F.regexp_extract(text_of(c), r"([^/\\]*)$", 1)
    return F.regexp_replace(base, r'[<>:"|?*\x00-\x1F]', "_")


def short_timestamp(c) -> Column:
    return F.date_format(c, "MMdd-HHmm")


def duration(ms: Column) -> Column:
    seconds = F.floor(F.greatest(F.coalesce(ms, F.lit(0)), F.lit(0)) / 1000)
    return F.when(seconds < 60, F.format_string("%d 秒", seconds)).otherwise(F.format_string("%d 分 %02d 秒", F.floor(seconds / 60), seconds % 60))
