"""Quality rules whose thresholds follow the data of each language and source.

Measures of the documents go into relative-error quantile sketches: counts of
logarithmic buckets, one sketch for each language, source and measure.  Sketches are
merged by adding counts, so partial ones are added before the shuffle, and groups
with few documents fall back to the merged sketch of their language, then of all.
A document is kept if every measure lies within the fences of its group: quartiles
plus or minus ``REACH`` times the spread between them.

Defined cases: null text has no word and fails the base rules; null language or
source is a group of its own; rows are judged one by one, so repeated rows get equal
verdicts; a table without any document that passes the base rules has no fences.
"""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxaflow.llm.common import BLANKS, batches_of, portions, utf8
from taxaflow.session import durable

SYMBOLS = b"#*$%&|<>"
#: Relative error of a sketched quantile; GAMMA is the ratio of bucket bounds.
ERROR = 0.01
GAMMA = (1 + ERROR) / (1 - ERROR)
#: Documents that a group's own sketch needs.
ENOUGH = 200
#: Times the spread of the quartiles, and the smallest spread that counts for each measure.
REACH = 3.0
SPREADS = {"mean_word": 0.5, "symbols": 0.05, "dup_lines": 0.2, "repeat_words": 0.2}


def repeated_words(words: list[list[bytes]]) -> np.ndarray:
    """Per text, the words that lie in a three-word window found twice or more in it."""
    sizes = np.array([len(x) for x in words], np.int64)
    out = np.zeros(len(words), np.int64)
    for rows in batches_of(sizes, 1 << 20):
        part, n = words[rows], sizes[rows]
        own = np.fromiter(map(hash, chain.from_iterable(part)), np.int64, int(n.sum())).view(np.uint64)
        if len(own) < 3:
            continue
        text = np.repeat(np.arange(len(part), dtype=np.int64), n)
        inside = np.flatnonzero(text[2:] == text[:-2])
        with np.errstate(over="ignore"):
            window = own[:-2] * np.uint64(0x9E3779B97F4A7C15) + own[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + own[2:] * np.uint64(0x165667B19E3779F9)
            window = (window ^ (window >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + text[:-2].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        window = window[inside]
        order = np.argsort(window, kind="stable")
        ordered = window[order]
        same = ordered[1:] == ordered[:-1]
        twice = inside[order[np.r_[same, False] | np.r_[False, same]]] if len(ordered) else inside
        marked = np.zeros(len(own), bool)
        for shift in range(3):
            marked[twice + shift] = True
        out[rows] = np.bincount(text[marked], minlength=len(part))
    return out


def _measured(texts: pa.Array) -> pa.Array:
    data = utf8(texts)
    parts = [_measures(data[rows]) for rows in portions(data)] or [_measures([])]
    return pa.concat_arrays(parts)


def _measures(data: list[bytes]) -> pa.Array:
    words = [x.split() for x in data]
    dup, lines = [], []
    for text in data:
        own = [x for x in text.split(b"\n") if x.strip(BLANKS)] if b"\n" in text else [text]
        lines.append(len(own))
        dup.append(len(own) - len(set(own)))
    columns = {
        "n_words": [len(x) for x in words],
        "word_chars": [len(x.translate(None, BLANKS).decode()) for x in data],
        "n_symbols": [len(x) - len(x.translate(None, SYMBOLS)) for x in data],
        "n_dup_lines": dup,
        "n_repeat_words": repeated_words(words),
        "n_lines": lines,
    }
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in columns.values()], list(columns))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``m``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word)."""
    kind = "struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,n_lines:long>"
    return docs.withColumn("m", F.arrow_udf(_measured, kind)(text))


def sketches(values: DataFrame) -> DataFrame:
    """Bucket counts ``(lang, source, measure, bucket, n)`` of long rows ``(lang, source, measure, value)``; zero is the null bucket."""
    bucket = F.when(F.col("value") > 0, F.ceil(F.ln("value") / math.log(GAMMA)))
    return values.groupBy("lang", "source", "measure", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def quartiles(buckets: DataFrame, by: list[str]) -> DataFrame:
    """First and third quartile and number of values of each merged sketch.  A sketch has as many buckets as its error needs, not as its data."""
    merged = buckets.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(*by).orderBy(F.asc_nulls_first("bucket")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = merged.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy(*by)))
    value = F.when(F.col("bucket").isNull(), F.lit(0.0)).otherwise(F.lit(2 / (GAMMA + 1)) * F.pow(F.lit(GAMMA), "bucket"))

    def quantile(q: float) -> F.Column:
        return F.min(F.when(F.col("upto") > F.floor((F.col("all") - 1) * q), value))

    return ranked.groupBy(*by).agg(F.first("all").alias("n"), quantile(0.25).alias("q1"), quantile(0.75).alias("q3"))


def fences(buckets: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """Lower and upper fence of each (lang, source, measure), from the smallest group that holds enough documents."""
    own = quartiles(buckets, ["lang", "source", "measure"])
    of_lang = quartiles(buckets, ["lang", "measure"]).select(F.col("lang").alias("l"), F.col("measure").alias("lm"), F.struct("n", "q1", "q3").alias("by_lang"))
    of_all = quartiles(buckets, ["measure"]).select(F.col("measure").alias("am"), F.struct("n", "q1", "q3").alias("by_all"))
    joined = own.join(of_lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("measure") == F.col("lm"))).join(of_all, F.col("measure") == F.col("am"))
    pick = F.when(F.col("n") >= enough, F.struct("n", "q1", "q3")).when(F.col("by_lang.n") >= enough, F.col("by_lang")).otherwise(F.col("by_all"))
    least = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in SPREADS.items()))[F.col("measure")]
    reach = F.lit(REACH) * F.greatest(F.col("p.q3") - F.col("p.q1"), least)
    return joined.withColumn("p", pick).select("lang", "source", "measure", (F.col("p.q1") - reach).alias("low"), (F.col("p.q3") + reach).alias("high"))


def judge(docs: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang, source): the measures, ``base_failed`` and ``kept``."""
    own = measures(docs.select("doc_id", "text", "lang", "source")).select("doc_id", "lang", "source", "m.*")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    own = durable(own.withColumn("base_failed", failed))
    ratio = {
        "mean_word": F.try_divide(F.col("word_chars"), F.col("n_words")),
        "symbols": F.try_divide(F.col("n_symbols"), F.col("n_words")),
        "dup_lines": F.try_divide(F.col("n_dup_lines"), F.col("n_lines")),
        "repeat_words": F.try_divide(F.col("n_repeat_words"), F.col("n_words")),
    }
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), v.alias("value")) for k, v in ratio.items())))
    values = own.where("not base_failed").select("lang", "source", pairs.alias("x")).select("lang", "source", "x.*")
    limits = fences(durable(sketches(values)), enough).groupBy("lang", "source").pivot("measure", list(SPREADS)).agg(F.first(F.struct("low", "high")))
    limits = limits.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), *SPREADS)
    same = F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source"))
    inside = [(ratio[k] >= F.col(f"{k}.low")) & (ratio[k] <= F.col(f"{k}.high")) for k in SPREADS]
    kept = ~F.col("base_failed") & F.coalesce(inside[0] & inside[1] & inside[2] & inside[3], F.lit(False))
    judged = own.join(limits, same, "left").withColumn("kept", kept)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
