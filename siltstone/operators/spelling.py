"""Corrections of words by shared deletions of their beginnings, and what a vocabulary makes of words."""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ocr.language import BEGINNING, WORD

PREFIX, FAR = 7, 2


def deletions(word: str, prefix: int = PREFIX, far: int = FAR) -> list[str]:
    """The word's beginning and all that is left of it without up to ``far`` characters."""
    head = word[:prefix]
    return sorted({"".join(c for k, c in enumerate(head) if k not in gone) for n in range(min(far, len(head)) + 1) for gone in combinations(range(len(head)), n)})


def corrections(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """word, suggestion, distance: for each of ``words`` (word) the nearest of ``vocabulary`` (word, n) within two edits, then the most frequent, then the first.

    Words within two edits share a deletion of their beginnings, so an equi-join
    finds all of them; every meeting is verified on whole words.
    """

    @F.pandas_udf("array<string>")
    def keys(w: pd.Series) -> pd.Series:
        return w.map(deletions)

    left = words.distinct().withColumn("key", F.explode(keys("word")))
    right = vocabulary.select(F.col("word").alias("suggestion"), "n").withColumn("key", F.explode(keys("suggestion")))
    met = left.join(right, "key").select("word", "suggestion", "n").distinct()
    near = met.withColumn("distance", F.levenshtein("word", "suggestion", FAR)).where("distance >= 0")
    return near.groupBy("word").agg(F.min(F.struct("distance", (-F.col("n")).alias("rare"), "suggestion")).alias("x")).select("word", "x.suggestion", "x.distance")


def corrected(rows: DataFrame, key: str, text: str, vocabulary: DataFrame) -> DataFrame:
    """``key``, ``text``: texts whose words are in the vocabulary (word, n) or replaced by the nearest word of it.

    A word is a run of letters; what stands around it stays, and so does its first
    letter's case. Words without a near one, and all white space, stay as they are.
    Each different word is corrected once; the table of corrections is joined by
    word, however often that occurs, and texts come together again by their place.
    """
    known = vocabulary.select(F.lower("word").alias("word"), "n")
    cut = rows.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))).alias("pos", "piece")).withColumn("word", F.lower("piece"))
    strange = cut.select("word").distinct().where(F.regexp_like("word", F.lit(r"^\p{L}"))).join(known, "word", "left_anti")
    better = corrections(strange, known).select("word", "suggestion")
    named = cut.join(better, "word", "left")
    shown = F.when(F.col("suggestion").isNull(), F.col("piece")).when(F.regexp_like("piece", F.lit(r"^\p{Lu}")), F.concat(F.upper(F.substring("suggestion", 1, 1)), F.expr("substring(suggestion, 2)"))).otherwise(F.col("suggestion"))
    whole = named.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", shown.alias("piece")))).alias("pieces"))
    made = whole.select(F.col(key).alias("_key"), F.array_join(F.transform("pieces", lambda x: x["piece"]), "").alias("_made"))
    return rows.join(made, F.col(key).eqNullSafe(F.col("_key")), "left").select(key, F.coalesce("_made", text).alias(text))


def bonus(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """word, bonus: 1 for a word of the vocabulary, 0.2 for a beginning of one, else 0."""
    known = vocabulary.select("word", F.lit(WORD).alias("worth"))
    heads = vocabulary.where(F.length("word") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda k: F.substring("word", F.lit(1), k))).alias("word"), F.lit(BEGINNING).alias("worth"))
    best = known.unionAll(heads).groupBy("word").agg(F.max("worth").alias("worth"))
    return words.join(best, "word", "left").select("word", F.coalesce("worth", F.lit(0.0)).alias("bonus"))
