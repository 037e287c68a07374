"""What the registered queries share: the registry, the tables and pieces of SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents 2n beside 2n + 1 as two versions: pair, lang, left, right."""
    d = table(spark, sf_dir, "documents").withColumn("pair", F.floor(F.col("doc_id") / 2))
    even = d.where("doc_id % 2 = 0").select("pair", "lang", F.col("text").alias("left"))
    return even.join(d.where("doc_id % 2 = 1").select("pair", F.col("text").alias("right")), "pair")


PAIRS = "p as (select a.doc_id // 2 as pair, a.lang, a.text as l, b.text as r from documents a join documents b on b.doc_id = a.doc_id + 1 and a.doc_id % 2 = 0)"
_CANON = r"lower(regexp_replace(regexp_replace({0}, '[\x{{200B}}-\x{{200D}}\x{{2060}}\x{{FEFF}}]', '', 'g'), '[\t\n\x0B\f\r \x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{FEFF}}]+', '', 'g'))"
_SIM = r"regexp_replace({0}, '[\p{{P}}\p{{S}}]', '', 'g')"


def canon(c: str) -> str:
    return _CANON.format(c)


def simil(c: str) -> str:
    return _SIM.format(c)


GRAMS = "case when len({0}) < 2 then list_distinct(string_split({0}, '')) else list_distinct([{0}[i : i + 1] for i in range(1, len({0}))]) end"
JACCARD = "case when len(ga) = 0 and len(gb) = 0 then 1.0 when len(ga) = 0 or len(gb) = 0 then 0.0 else len(list_intersect(ga, gb))::double / (len(ga) + len(gb) - len(list_intersect(ga, gb))) end"
STRUCTURED = r"(len({0}) between 1 and 32 and ((regexp_matches({0}, '\p{{N}}') and regexp_matches({0}, '^[\p{{N}}\p{{P}}\p{{S}}]+$')) or (regexp_matches({0}, '[a-z0-9]') and regexp_matches({0}, '^[a-z0-9._:/#%+\-]+$'))))"
TOKENS = r"regexp_extract_all({0}, '([a-z]+|\p{{N}}+)')"
