"""Data selection by importance resampling over hashed n-grams.

Two bag-of-n-gram models are counted: target text (labelled good and not toxic) and
raw text (everything).  A document's log weight sums the log ratios of its hashed
words, word beginnings and bigrams.  Ratios are bounded by one, so that much ordinary text does not
outweigh what the target never holds, and ratios above ``NOISE`` are taken as one:
counts that small data could show by chance.  Documents are drawn without
replacement, with probabilities by weight, as the top k of ``log weight / TAU`` plus
Gumbel noise; k is the number of documents whose weight is above the cutoff that
separates the labelled rows best.

The raw model and the draw cover all documents; the target and the cutoff come from
a sample of at most ``LABELS`` labelled documents, chosen by a hash, whose ids go to
all tasks, so that no text is shuffled.  Defined cases: null or empty text has
log weight 0; documents with several labels take the worst; null labels are not
good; without labels every document is drawn; noise depends on the doc_id and text
only, so repeated rows stay or go together; further columns are left as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaflow.llm.common import Memo, claim, portions, remembers, utf8
from taxaflow.session import durable

#: Buckets of words, of their beginnings of two lengths (in bytes), and of bigrams; four times one word is a feature of its own, whatever the word.
WORDS, STEMS, BIGRAMS, SHORT, LONG = 1 << 19, 1 << 17, 1 << 17, 5, 7
BUCKETS = WORDS + 2 * STEMS + BIGRAMS
#: Added to both counts; log ratios above NOISE count as 0.
SMOOTHING, NOISE = 1.0, -2.5
#: Temperature of the draw: weights are raised to its inverse.
TAU = 0.1
#: Buckets in a segment of the counts.
SEGMENT = 1 << 14
#: Weight of a good document lost against a bad one kept, when the cutoff is set.
CARE = 20.0
#: Most labelled documents that are used.
LABELS = 100_000
#: Of so many labelled documents one sets the cutoff; the others are the target.
FOLDS = 4



def _word(word: bytes) -> int:
    """Buckets of a word and of its two beginnings in one number."""
    word = word.lower().rstrip(b".,")
    own, short, long = (xxhash.xxh64_intdigest(x, n) for n, x in enumerate((word, word[:SHORT], word[:LONG])))
    return own % WORDS | short % STEMS << 19 | long % STEMS << 36


_words = Memo(_word, 200_000)
remembers("resampling", _words.clear)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of the texts, and the text each belongs to."""
    claim("resampling")
    words = [x.split() for x in texts]
    sizes = np.array([len(x) for x in words], np.int64)
    own = np.fromiter(map(_words.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
    text = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    word = (own & (WORDS - 1)).astype(np.int32)
    stems = [(own >> shift & (STEMS - 1)).astype(np.int32) + np.int32(start) for shift, start in ((19, WORDS), (36, WORDS + STEMS))]
    inside = text[1:] == text[:-1]
    two = word[:-1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7) + word[1:].astype(np.uint64) * np.uint64(0x3C6EF372FE94F)
    two = (1 + (two >> np.uint64(20)) % np.uint64(BIGRAMS - 1)).astype(np.int32) + np.int32(WORDS + 2 * STEMS)
    same = (own[1:] == own[:-1]) & inside
    runs = np.flatnonzero(same[2:] & same[1:-1] & same[:-2])
    buckets = [word, *stems, two[inside], np.full(len(runs), WORDS + 2 * STEMS, np.int32)]
    return np.concatenate(buckets), np.concatenate([text, text, text, text[1:][inside], text[runs]])


def _count(targets: Broadcast):
    """Rows (doc_id, text) to counts of all texts and of those whose ids are ``targets``, by segment."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, wanted = BUCKETS, targets.value
        raw, target = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for batch in batches:
            texts = utf8(batch.column(1))
            good = np.array([x in wanted for x in batch.column(0).to_pylist()], bool)
            for rows in portions(texts, 2 << 20):
                bucket, text = grams(texts[rows])
                raw += np.bincount(bucket, minlength=n)
                target += np.bincount(bucket[good[rows][text]], minlength=n)
        if raw.any():
            starts = range(0, n, SEGMENT)
            parts = [pa.array([x[i : i + SEGMENT].astype("<u4").tobytes() for i in starts], pa.binary()) for x in (raw, target)]
            yield pa.record_batch([pa.array([i // SEGMENT for i in starts], pa.int32()), *parts], ["segment", "raw", "target"])

    return count


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by segment to one sum each."""
    now, sums = None, None
    for batch in batches:
        for segment, *counts in zip(*(c.to_pylist() for c in batch.columns)):
            if segment != now:
                if now is not None:
                    yield _row(now, sums)
                now, sums = segment, np.zeros((2, SEGMENT), np.int64)
            sums += np.stack([np.frombuffer(x, "<u4") for x in counts])
    if now is not None:
        yield _row(now, sums)


def _row(segment: int, sums: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([segment], pa.int32()), pa.array([sums.tobytes()], pa.binary())], ["segment", "sums"])


@dataclass
class Sampler:
    """Log ratios of all buckets (of a fixed number), the cutoff of weights, and k with the k-th key of a drawn table."""

    ratios: Broadcast
    cutoff: float
    k: int
    least_key: float

    def log_weight(self, text: str | Column) -> Column:
        return _log_weight(self.ratios, text)

    def key(self, doc_id: str | Column, text: str | Column, weight: Column) -> Column:
        return weight / TAU + _gumbel(doc_id, text)

    def drawn(self, key: Column) -> Column:
        return key >= F.lit(self.least_key)


def _log_weight(ratios: Broadcast, text: str | Column) -> Column:
    def weight(texts: pa.Array) -> pa.Array:
        data, out = utf8(texts), np.zeros(len(texts))
        for rows in portions(data, 2 << 20):
            bucket, text = grams(data[rows])
            out[rows] = np.bincount(text, ratios.value[bucket], rows.stop - rows.start)
        return pa.array(out)

    return F.arrow_udf(weight, "double")(text)


def _gumbel(doc_id: str | Column, text: str | Column) -> Column:
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit("gumbel"), doc_id, text), 11) + F.lit(0.5)) * F.lit(2.0**-53)
    return -F.ln(-F.ln(uniform))


def good_labels(labels: DataFrame, most: int = LABELS) -> DataFrame:
    """(doc_id, good, target) for at most ``most`` labelled documents; good ones that don't set the cutoff are the target."""
    one = (F.col("quality") == 1) & (F.col("toxic") == 0)
    each = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("__doc")).agg(F.min(F.coalesce(one, F.lit(False))).alias("good"))
    share = min(1.0, 0.98 * most / max(each.count(), 1))
    each = each.where(F.pmod(F.xxhash64("__doc"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).limit(most)
    return each.withColumn("target", F.col("good") & (F.crc32(F.col("__doc").cast("string")) % FOLDS != 0))


def log_ratios(docs: DataFrame, good: DataFrame) -> np.ndarray:
    """Bounded log ratio of target and raw model for each bucket."""
    targets = docs.sparkSession.sparkContext.broadcast({r[0] for r in good.where("target").select("__doc").collect()})
    counts = docs.select("doc_id", "text").mapInArrow(_count(targets), "segment int, raw binary, target binary")
    rows = counts.repartition("segment").sortWithinPartitions("segment").mapInArrow(_add, "segment int, sums binary").collect()
    sums = np.zeros((2, BUCKETS))
    for segment, part in rows:
        sums[:, segment * SEGMENT : (segment + 1) * SEGMENT] = np.frombuffer(part, np.int64).reshape(2, SEGMENT)
    raw, target = sums
    if not target.any():
        return np.zeros(len(raw), np.float32)
    expected = raw * (target.sum() / raw.sum())
    ratio = np.log((target + SMOOTHING) / (expected + SMOOTHING))
    return np.where(ratio > NOISE, 0, ratio).astype(np.float32)


def cutoff_of(weights: DataFrame, good: DataFrame) -> float:
    """The weight that parts good and other labelled documents at least cost; ``weights``: doc_id, log_weight."""
    bins = F.least(F.lit(400), F.floor(-F.col("log_weight") * 4))
    rows = weights.join(good.where("not target"), F.col("doc_id") == F.col("__doc")).groupBy(bins.alias("bin"), "good").count().collect()
    kept = np.zeros((2, 401))
    for b, is_good, n in rows:
        kept[int(is_good), int(b)] = n
    if not kept[1].any() or not kept[0].any():
        return -100.0 if kept[1].any() else float("-inf")
    shares = np.cumsum(kept, axis=1) / kept.sum(axis=1, keepdims=True)
    cost = CARE * (1 - shares[1]) + shares[0]
    return -(int(np.argmin(cost)) + 1) / 4


def kth_largest(values: DataFrame, column: str, k: int) -> float:
    """The exact k-th largest value by counts over ever narrower ranges; no row leaves the executors."""
    if k <= 0:
        return float("inf")
    low, high = values.agg(F.min(column), F.max(column)).first()
    while low < high:
        step = (high - low) / 1024
        if step == 0 or low + step == low:
            break
        at = F.least(F.lit(1023), F.floor((F.col(column) - F.lit(low)) / F.lit(step)))
        inside = values.where((F.col(column) >= F.lit(low)) & (F.col(column) <= F.lit(high)))
        for b, n, least, most in sorted(inside.groupBy(at.alias("b")).agg(F.count("*"), F.min(column), F.max(column)).collect(), reverse=True):
            if k <= n:
                low, high = least, most
                break
            k -= n
    return high


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Sampler, DataFrame]:
    """The sampler, and the durable table (doc_id, log_weight, key) of the documents it was made for."""
    good = durable(good_labels(labels))
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, good))
    weights = docs.select("doc_id", _log_weight(ratios, "text").alias("log_weight"), _gumbel("doc_id", "text").alias("noise"))
    weights = durable(weights.select("doc_id", "log_weight", (F.col("log_weight") / TAU + F.col("noise")).alias("key")))
    cutoff = cutoff_of(weights, good)
    k = weights.where(F.col("log_weight") > F.lit(cutoff)).count()
    return Sampler(ratios, cutoff, k, kth_largest(weights, "key", k)), weights
