"""Books: archive entries as rows, manifest and spine as joins, body chosen by features of the spine documents."""

from __future__ import annotations

import io
import zipfile
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import markup

#: What labels and beginnings say of a spine document.
NON_BODY = r"(?i)後記|后记|あとがき|特典|番外|extra|bonus|版權|版权|colophon|copyright|cover|書封|封面|目錄|目录|contents|制作信息|簡介|简介"
BODY = r"(?i)序|章|行間|行间|終章|终章|prologue|chapter|epilogue|between"
FRONT = r"(?i)^(contents|目錄|目录|ＣＯＮＴＥＮＴＳ|navigation|本電子書籍|本电子书籍|Kadokawa)"
BACK = r"(?i)^(後記|后记|あとがき|特典|電子書特典|番外|extra|bonus|版權頁|版权页|colophon|copyright|Kadokawa Fantastic Novels)(?:\s|$|[：:])"
PRODUCTION = r"(?i)©|copyright|all rights reserved|isbn|kadokawa|出版|發行|发行|著者|作者|譯者|译者|校[對对]|製作|制作|電子書籍|电子书|本電子書|本电子书|无断転載|無断転載|版权所有|版權所有|版权页|版權頁"
NAV_MARK = r"(?i)<\s*nav\b|epub:type\s*=\s*[\x22'][^\x22']*(toc|landmarks|page-list)"


def resolve(base: Column, href: Column) -> Column:
    """href from the folder of base, with . and .. resolved and / for \\."""
    folder = F.regexp_replace(base, r"[^/]*$", "")
    parts = F.split(F.replace(F.concat(folder, href), F.lit("\\"), F.lit("/")), "/")
    up = lambda acc, p: F.when(p.isin("", "."), acc).when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(parts, F.expr("cast(array() as array<string>)"), up), "/")


def strip_fragment(href: Column) -> Column:
    return F.split_part(href, F.lit("#"), F.lit(1))


def href_form(href: Column) -> Column:
    return F.lower(F.replace(href, F.lit("\\"), F.lit("/")))


def base_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def entries(books: DataFrame) -> DataFrame:
    """(path, entry, at, data, error) of the text entries of zip archives (path, content), one row each; a broken archive gives one row with its error and no entry."""

    def unzip(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf.path, pdf.content):
                try:
                    z = zipfile.ZipFile(io.BytesIO(content))
                    names = [(n, i) for n, i in enumerate(z.infolist()) if i.filename.lower().endswith((".xml", ".opf", ".xhtml", ".html", ".htm"))]
                    rows += [(path, i.filename, n, z.read(i).decode("utf-8", "replace"), None) for n, i in names]
                except (zipfile.BadZipFile, OSError, zlib.error) as e:
                    rows.append((path, None, -1, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "entry", "at", "data", "error"])

    return books.select("path", "content").mapInPandas(unzip, "path string, entry string, at int, data string, error string")


def attribute(c: Column, name: str) -> Column:
    return F.regexp_extract(c, rf"(?is)\s{name}\s*=\s*[\x22']([^\x22']*)[\x22']", 1)


def tags(c: Column, name: str) -> Column:
    return F.regexp_extract_all(c, F.lit(rf"(?is)(<(?:\w+:)?{name}\b[^>]*>)"), F.lit(1))


def spine(files: DataFrame) -> DataFrame:
    """(path, spine, entry, is_nav) of the documents that a book's package lists in its order, without linear="no" and other media."""
    container = files.where("entry = 'META-INF/container.xml'").select("path", attribute(F.get(tags(F.col("data"), "rootfile"), F.lit(0)), "full-path").alias("opf"))
    package = files.alias("f").join(container.alias("c"), (F.col("f.path") == F.col("c.path")) & (F.col("f.entry") == F.col("c.opf"))).select("f.path", "c.opf", "f.data")
    item = package.select("path", "opf", F.explode(tags(F.col("data"), "item")).alias("t"))
    items = item.select("path", attribute(F.col("t"), "id").alias("id"), resolve(F.col("opf"), attribute(F.col("t"), "href")).alias("entry"), attribute(F.col("t"), "media-type").alias("media"), F.array_contains(F.split(attribute(F.col("t"), "properties"), r"\s+"), "nav").alias("is_nav"))
    refs = package.select("path", F.posexplode(tags(F.col("data"), "itemref")).alias("spine", "t")).where(F.lower(attribute(F.col("t"), "linear")) != "no").select("path", "spine", attribute(F.col("t"), "idref").alias("id"))
    listed = refs.join(items, ["path", "id"]).where(F.col("media").contains("html"))
    return listed.select("path", "spine", "entry", "is_nav"), items.where("is_nav").select("path", "entry")


def nav_labels(files: DataFrame, nav: DataFrame, docs: DataFrame) -> DataFrame:
    """(path, spine, labels): labels of the links of a book's navigation by the spine document they lead to.

    A link leads to the document of its path, else to the first whose file name is its file name or ends in it.
    """
    first = nav.groupBy("path").agg(F.min("entry").alias("entry"))
    pages = files.join(first, ["path", "entry"])
    links = pages.select("path", "entry", F.posexplode(F.regexp_extract_all("data", F.lit(r"(?is)(<a\b[^>]*\bhref\s*=.*?</a\s*>)"), F.lit(1))).alias("n", "a"))
    label = T.collapse(F.regexp_replace(F.regexp_replace("a", r"(?s)<[^>]*>", " "), "&amp;", "&"))
    links = links.select("path", "n", label.alias("label"), href_form(resolve(F.col("entry"), strip_fragment(markup.attribute(F.col("a"), "href")))).alias("to"))
    d = docs.select(F.col("path").alias("_p"), "spine", href_form(F.col("entry")).alias("_e"))
    exact = links.join(d, (F.col("path") == F.col("_p")) & (F.col("to") == F.col("_e"))).groupBy("path", "n", "label").agg(F.min("spine").alias("spine"))
    rest = links.join(exact.select("path", "n"), ["path", "n"], "left_anti").where(base_of(F.col("to")) != "")
    near = rest.join(d, (F.col("path") == F.col("_p")) & F.endswith(base_of(F.col("_e")), base_of(F.col("to")))).groupBy("path", "n", "label").agg(F.min("spine").alias("spine"))
    every = exact.unionByName(near)
    return every.groupBy("path", "spine").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "label"))), lambda x: x["label"]).alias("labels"))


def looks_like_front(text: Column) -> Column:
    t = T.collapse(T.document_text(text))
    return (F.length(t) < 30) | t.rlike(FRONT)


def document_features(docs: DataFrame, html: str = "html", text: str = "text", labels: str = "labels") -> DataFrame:
    """docs with counts, scores and flags of a spine document from its page, its text and its labels."""
    blocks = T.meaningful_blocks(text)
    compact = T.collapse(T.document_text(text))
    tags_ = F.coalesce(F.col(labels), F.expr("cast(array() as array<string>)"))
    out = docs.withColumns({"_b": blocks, "_c": compact, "_l": tags_}).withColumns({
        "length": T.text_length("_c"), "dense_blocks": F.size(F.filter("_b", T.is_text_dense)), "sentence_marks": F.regexp_count("_c", F.lit("[。．.!！？?]")), "dialogue_marks": F.regexp_count("_c", F.lit("[「『]")),
        "link_count": markup.link_count(F.col(html)), "image_count": markup.image_count(F.col(html)), "has_nav": T.text_of(html).rlike(NAV_MARK),
        "has_body_label": F.exists("_l", lambda x: (x != "") & ~x.rlike(NON_BODY) & x.rlike(BODY)), "has_non_body_label": F.exists("_l", lambda x: x.rlike(NON_BODY)),
        "back_matter": F.coalesce(F.get("_b", F.lit(0)), F.lit("")).rlike(BACK), "_lead": F.array_join(F.slice("_b", 1, 4), " "),
    })
    production = F.col("_lead").rlike(PRODUCTION) & (F.col("length") < 1600)
    short_nav = (F.col("link_count") >= 4) & (F.col("length") < 1200)
    points = lambda *p: sum((F.when(c, n).otherwise(0) for c, n in p), F.lit(0))
    c = F.col
    body = points((c("length") >= 120, 2), (c("length") >= 500, 2), (c("dense_blocks") >= 2, 2), (c("sentence_marks") >= 3, 1), (c("dialogue_marks") >= 1, 1), (c("has_body_label"), 4))
    label_text = F.array_join("_l", " ").rlike("(?i)cover|contents|toc|nav|colophon|copyright")
    non = points((c("length") == 0, 3), (c("has_nav") | short_nav, 4), (production, 4), (c("back_matter"), 5), (c("has_non_body_label"), 6), (label_text, 2))
    out = out.withColumns({"body_score": body, "non_body_score": non, "is_empty_or_image": (c("length") == 0) & (c("image_count") > 0), "is_structural": (c("length") == 0) | c("has_nav") | short_nav, "is_end": c("has_non_body_label") | c("back_matter") | production})
    return out.withColumn("is_body", (c("body_score") >= 4) & (c("non_body_score") < 6)).drop("_b", "_c", "_l", "_lead")


def select_body(features: DataFrame, keys: list[str], order: str = "spine", text: str = "text") -> DataFrame:
    """Documents of the body: from the first with a body label, and those right before it that are no front matter, to the first end after it.

    A book without body labels, or of which nothing would be left, keeps all its documents.
    """
    w, all_ = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(order)
    f = features.withColumn("_first", F.min(F.when(F.col("has_body_label"), F.col(order))).over(w))
    stops = looks_like_front(F.col(text)) | F.col("is_structural") | F.col("is_end")
    f = f.withColumn("_stop", F.max(F.when((F.col(order) < F.col("_first")) & stops, F.col(order))).over(w))
    f = f.withColumn("_start", F.coalesce(F.min(F.when(F.col(order) > F.coalesce("_stop", F.lit(-1)), F.col(order))).over(w), F.col("_first")))
    f = f.withColumn("_end", F.min(F.when((F.col(order) > F.col("_start")) & F.col("is_end"), F.col(order))).over(w))
    inside = (F.col(order) >= F.col("_start")) & (F.col("_end").isNull() | (F.col(order) < F.col("_end"))) & (T.text_of(text) != "") & ~F.col("is_structural") & ~F.col("is_end")
    f = f.withColumn("_in", F.coalesce(inside, F.lit(False))).withColumn("_any", F.max(F.col("_in").cast("int")).over(w))
    return f.where("_in or _any = 0").drop("_first", "_stop", "_start", "_end", "_in", "_any")


def book_texts(books: DataFrame, inline: dict | None = None) -> DataFrame:
    """(path, text, error) of books (path, content): the body documents in their order. A broken archive, and a book without a document, has no text and an error."""
    files = entries(books)
    docs, nav = spine(files)
    labels = nav_labels(files, nav, docs)
    pages = docs.join(files.select("path", "entry", F.col("data").alias("html")), ["path", "entry"]).join(labels, ["path", "spine"], "left")
    pages = pages.withColumn("text", T.document_text(markup.html_text(F.col("html"), inline)))
    body = select_body(document_features(pages), ["path"])
    ordered = F.transform(F.sort_array(F.collect_list(F.when(F.col("text") != "", F.struct("spine", "text")))), lambda x: x["text"])
    texts = body.groupBy("path").agg(F.array_join(ordered, "\n\n").alias("text"))
    states = files.groupBy("path").agg(F.max("error").alias("error"))
    found = books.select("path").join(states, "path", "left").join(texts, "path", "left")
    return found.select("path", "text", F.coalesce("error", F.when(F.col("text").isNull(), "no document in the book")).alias("error"))


def converted_texts(books: DataFrame, inline: dict | None = None, command: str = "pandoc") -> DataFrame:
    """(path, text, error) of books through an external converter; note references come back as the book writes them."""
    from . import plain

    pages = plain.converted(books, "html", command).withColumnRenamed("output", "html")
    if markup.keep_options(inline)["noteref"]:
        listed = entries(books).where(F.col("entry").rlike(r"(?i)\.x?html?$")).select("path", "at", F.explode(markup.noterefs(F.col("data"))).alias("n"))
        originals = listed.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "n.markup"))), lambda x: x["markup"]).alias("originals"))
        none = F.expr("cast(array() as array<string>)")
        pages = pages.join(originals, "path", "left").withColumn("html", F.when(F.col("html").isNotNull(), markup.restore_noterefs(F.col("html"), F.coalesce("originals", none))))
    text = F.when(F.col("html").isNotNull(), T.document_text(markup.html_text(F.col("html"), inline)))
    found = pages.select("path", text.alias("text"), "error")
    empty = F.when(F.col("error").isNull() & (T.text_of("text") == ""), "the converter gave no text")
    return found.select("path", F.nullif(F.col("text"), F.lit("")).alias("text"), F.coalesce("error", empty).alias("error"))


def read_books(books: DataFrame, converter: str = "auto", inline: dict | None = None, command: str = "pandoc") -> DataFrame:
    """(path, text, error) of books. `internal` reads them by their spine, `pandoc` by the converter alone, `auto` by the converter and, where that fails, by the spine; error then keeps why."""
    if converter == "internal":
        return book_texts(books, inline)
    outer = converted_texts(books, inline, command)
    if converter == "pandoc":
        return outer
    inner = book_texts(books, inline).withColumnsRenamed({"text": "_text", "error": "_error"})
    both = outer.join(inner, "path")
    return both.select("path", F.coalesce("text", "_text").alias("text"), F.concat_ws("; ", "error", F.when(F.col("text").isNull(), F.col("_error"))).alias("error")).withColumn("error", F.nullif(F.col("error"), F.lit("")))
