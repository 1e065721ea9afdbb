"""Text functions: normalising, fuzzy ratio, searches, documents by variant."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Least score, of 100, at which a text counts as an identifier.
FUZZY_HIT = 65.0


def normalised(x: Column | str) -> Column:
    """Upper case without anything but letters A-Z and digits."""
    return F.regexp_replace(F.upper(x), "[^A-Z0-9]", "")


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by rows of bits."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for ch in b:
        u = s & where.get(ch, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    """200 times the common length over both lengths: similarity by insertions and deletions alone."""
    n = len(a) + len(b)
    return 200.0 * common_length(a, b) / n if n else 100.0


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def fuzzy_match(texts: DataFrame, identifiers: DataFrame, least: float = FUZZY_HIT) -> DataFrame:
    """Best identifier for each text: ``id``, ``identifier``, ``score``, ``hit``.

    ``texts`` (id, text) is split at white space; the whole text and each token are compared. ``identifiers`` is a
    library, a small dimension table; it is deduplicated, and Spark broadcasts it if its measured size allows. Texts
    are reduced to distinct tokens before comparing, so each pair is scored once however many texts hold the token.
    """
    tokens = texts.select("id", F.explode(F.concat(F.array("text"), F.split("text", r"\s+"))).alias("raw"))
    tokens = tokens.select("id", normalised("raw").alias("token")).where(F.length("token") >= 2).distinct()
    names = identifiers.select(F.col("identifier"), normalised("identifier").alias("name")).where("name <> ''").distinct()
    # a token and a name that share no letter pair and differ in length can't reach the bound; blocking by length keeps
    # pairs in proportion: 200 * min / (a + b) must reach it
    spread = names.withColumn("n", F.length("name"))
    low = least / (200 - least)
    spread = spread.withColumn("len", F.explode(F.sequence(F.ceil(F.col("n") * low).cast("int"), F.floor(F.col("n") / low).cast("int"))))
    distinct = tokens.select("token").distinct().withColumn("len", F.length("token"))
    pairs = distinct.join(spread, "len").select("token", "identifier", indel_ratio("token", "name").alias("score"))
    best = pairs.groupBy("token").agg(F.max(F.struct("score", "identifier")).alias("b"))
    each = tokens.join(best, "token").groupBy("id").agg(F.max("b").alias("b"))
    return (texts.select("id").join(each, "id", "left")
            .select("id", F.when(F.col("b.score") >= least, F.col("b.identifier")).alias("identifier"),
                    F.coalesce("b.score", F.lit(0.0)).alias("score"), F.coalesce(F.col("b.score") >= least, F.lit(False)).alias("hit")))


def search_any(df: DataFrame, term: str, fields: Sequence[str], arrays: Sequence[str] = ()) -> DataFrame:
    """Rows where a field, or an element of an array field, holds the term in any case; all rows for an empty term."""
    q = term.strip().lower()
    if not q:
        return df
    test = F.lit(False)
    for f in fields:
        test = test | F.coalesce(F.contains(F.lower(f), F.lit(q)), F.lit(False))
    for a in arrays:
        test = test | F.coalesce(F.exists(a, lambda x: F.contains(F.lower(x), F.lit(q))), F.lit(False))
    return df.where(test)


def search_joined(df: DataFrame, term: str, fields: Sequence[str]) -> DataFrame:
    """Rows whose fields, joined by blanks, hold the term; null fields are left out."""
    return df.where(F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(term.strip().lower())))


def approximate_search(df: DataFrame, term: str, field: str, threshold: float = 0.45) -> DataFrame:
    """Rows within a relative edit distance of the term, best first (an extension: the distance is Levenshtein's)."""
    q = term.strip().lower()
    rel = F.levenshtein(F.lower(field), F.lit(q)) / F.greatest(F.length(field), F.lit(len(q) or 1))
    rel = F.when(F.contains(F.lower(field), F.lit(q)), F.lit(0.0)).otherwise(rel)
    return df.withColumn("score", 1 - rel).where(F.col("score") >= 1 - threshold).orderBy(F.desc("score"), field)


#: What titles of one variant's documents begin with, and the family's stand-in for a missing manual.
VARIANT_TITLE, FAMILY_TITLE = r"^RE[A-Z]615\b", r"(?i)^REF615 Product guide"


def docs_for_variant(devices: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents of each device (device, type, variant) among those of its type (type, title), with ``warning``.

    Documents of its own variant and those of no variant; if its own are missing, the family's and those of no variant,
    with a warning; all where no document is of a variant.
    """
    w = Window.partitionBy("device")
    some = F.col("title").rlike(VARIANT_TITLE)
    own = some & F.coalesce((F.col("variant") != "unknown") & F.col("title").startswith(F.concat("variant", F.lit(" "))), F.lit(False))
    family = ~some | F.col("title").rlike(FAMILY_TITLE)
    count = lambda c: F.count_if(c).over(w)
    j = devices.join(docs, "type").select("device", "title", some.alias("some"), own.alias("own"), family.alias("fam"), count(some).alias("n_some"), count(own).alias("n_own"), count(family).alias("n_fam"))
    keep = F.when(F.col("n_some") == 0, True).when(F.col("n_own") > 0, F.col("own") | ~F.col("some")).when(F.col("n_fam") > 0, F.col("fam")).otherwise(True)
    return j.where(keep).select("device", "title", ((F.col("n_some") > 0) & (F.col("n_own") == 0)).alias("warning"))
