"""Dropping lines that many documents repeat, found by two Bloom filters.

1. Each task sets the bits of its line keys in a filter of keys seen once, and the
   bits of keys it meets again in one of keys seen twice.  Where filters of tasks
   meet, bits set in both "once" filters are bits seen twice, so no repeated key is
   missed.  Only touched words are sent; segments of the filter are merged in
   streams.
2. The filter of twice-seen keys, of a bounded size, goes to all tasks.  Only keys
   that it holds are shuffled, as 128-bit digests with their doc_id, for exact
   counts and the occurrence to keep.  A full filter costs more shuffle, never a
   wrong result.
3. Each document is rewritten without the lines it has to lose.

Defined cases: null or empty text is one empty line; a null doc_id cannot be
compared, so such a document keeps its lines and counts for no key; rows with one
doc_id are one document to the counts and each is rewritten.  Further columns are
left as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaflow.llm.common import BLANKS, fresh, utf8
from taxaflow.session import durable

#: Bits of a filter for each line, and the most a filter has (32 MB): what bounds the broadcast.
BITS_PER_LINE, MOST_BITS = 16, 1 << 28
#: 64-bit words in a segment.
SEGMENT = 8192
#: Hashes a task gathers before it sends touched words.
GATHERED = 1 << 20


def keys(text: bytes, least: int) -> set[bytes]:
    """Distinct line keys of at least ``least`` code points: stripped, A-Z lower-cased."""
    return {key for key in map(key_of, text.split(b"\n")) if len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least)}


def key_of(line: bytes) -> bytes:
    return line.strip(BLANKS).lower()


def digest(key: bytes) -> bytes:
    return blake2b(key, digest_size=16).digest()


def places(hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of each hash and the four bits it has there."""
    one, mask = np.uint64(1), np.zeros(len(hashes), np.uint64)
    for shift in (0, 6, 12, 18):
        mask |= one << ((hashes >> np.uint64(shift)) & np.uint64(63))
    return ((hashes >> np.uint64(24)) % np.uint64(words)).astype(np.int64), mask


def _hashes(texts: pa.Array, least: int) -> np.ndarray:
    hash_of = xxhash.xxh64_intdigest
    return np.array([hash_of(key) for text in utf8(texts) for key in keys(text, least)], np.uint64)


def _touched(hashes: np.ndarray, words: int) -> Iterator[pa.RecordBatch]:
    """Words of both filters that ``hashes`` touch, by segment."""
    distinct, counts = np.unique(hashes, return_counts=True)
    word, mask = places(distinct, words)
    order = np.argsort(word, kind="stable")
    word, mask, again = word[order], mask[order], np.where(counts[order] > 1, mask[order], np.uint64(0))
    starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    once, twice, word = np.bitwise_or.reduceat(mask, starts), np.bitwise_or.reduceat(again, starts), word[starts]
    cuts = np.flatnonzero(np.r_[True, word[1:] // SEGMENT != word[:-1] // SEGMENT])
    parts = [slice(a, b) for a, b in zip(cuts, [*cuts[1:], len(word)])]
    yield pa.record_batch(
        [
            pa.array([int(word[p.start] // SEGMENT) for p in parts], pa.int32()),
            pa.array([(word[p] % SEGMENT).astype("<u2").tobytes() for p in parts], pa.binary()),
            pa.array([once[p].tobytes() for p in parts], pa.binary()),
            pa.array([twice[p].tobytes() for p in parts], pa.binary()),
        ],
        ["segment", "word", "once", "twice"],
    )


def _partial(words: int, least: int):
    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(_hashes(batch.column(0), least))
            n += len(held[-1])
            if n >= GATHERED:
                yield from _touched(np.concatenate(held), words)
                held, n = [], 0
        if n:
            yield from _touched(np.concatenate(held), words)

    return touched


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by segment to the finished "twice" words of each segment; one segment is held at a time."""
    now, once, twice = None, np.zeros(SEGMENT, np.uint64), np.zeros(SEGMENT, np.uint64)

    def done() -> Iterator[pa.RecordBatch]:
        if now is not None and twice.any():
            yield pa.record_batch([pa.array([now], pa.int32()), pa.array([twice.tobytes()], pa.binary())], ["segment", "twice"])

    for batch in batches:
        for segment, word, seen, again in zip(*(c.to_pylist() for c in batch.columns)):
            if segment != now:
                yield from done()
                now = segment
                once[:] = twice[:] = 0
            at, seen = np.frombuffer(word, "<u2"), np.frombuffer(seen, np.uint64)
            twice[at] |= np.frombuffer(again, np.uint64) | (once[at] & seen)
            once[at] |= seen
    yield from done()


def repeated_filter(docs: DataFrame, text: str, least: int, most_bits: int = MOST_BITS) -> np.ndarray:
    """The filter of keys seen twice, as 64-bit words; at most ``most_bits`` bits on the driver."""
    lines = docs.select(F.sum(F.size(F.split(F.coalesce(text, F.lit("")), "\n")))).first()[0] or 0
    segments = int(min(most_bits // (64 * SEGMENT), lines * BITS_PER_LINE // (64 * SEGMENT) + 1)) or 1
    filled = np.zeros(segments * SEGMENT, np.uint64)
    parts = docs.select(text).mapInArrow(_partial(len(filled), least), "segment int, word binary, once binary, twice binary")
    merged = parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(_merge, "segment int, twice binary")
    for segment, twice in merged.collect():
        filled[segment * SEGMENT : (segment + 1) * SEGMENT] = np.frombuffer(twice, np.uint64)
    return filled


def _suspects(filled, least: int):
    """(digest, doc_id) of the keys that the filter holds."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, hash_of = filled.value, xxhash.xxh64_intdigest
        for batch in batches:
            own, ids = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                found = list(keys(text, least))
                own += found
                ids += [doc_id] * len(found)
            if own:
                word, mask = places(np.array([hash_of(x) for x in own], np.uint64), len(words))
                hits = np.flatnonzero((words[word] & mask) == mask).tolist()
                yield pa.record_batch([pa.array([digest(own[i]) for i in hits], pa.binary()), pa.array([ids[i] for i in hits], pa.int64())], ["key", "doc_id"])

    return held


def _rewrite(least: int):
    def lines(texts: pa.Array, lost: pa.Array) -> pa.Array:
        kept, before, dropped = [], [], []
        for text, gone in zip(utf8(texts), lost.to_pylist()):
            own = text.split(b"\n")
            if gone:
                gone = set(gone)
                stay = [line for line in own if len(key := key_of(line)) < least or digest(key) not in gone]
            else:
                stay = own
            kept.append(b"\n".join(stay).decode() if gone else text.decode())
            before.append(len(own))
            dropped.append(len(own) - len(stay))
        return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(before, pa.int64()), pa.array(dropped, pa.int64())], ["text", "n_lines", "n_dropped"])

    return F.arrow_udf(lines, "struct<text:string,n_lines:long,n_dropped:long>")


def lost_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3, most_bits: int = MOST_BITS) -> DataFrame:
    """Per document that loses lines: ``doc_id`` and the digests ``lost`` of their keys."""
    context: SparkContext = docs.sparkSession.sparkContext
    usable = docs.where(F.col(doc_id).isNotNull())
    filled = context.broadcast(repeated_filter(usable, text, min_chars, most_bits))
    suspects = durable(usable.select(F.col(doc_id).cast("long"), text).mapInArrow(_suspects(filled, min_chars), "key binary, doc_id long"))
    # one row for each key and document, then partial counts: a hot key is spread until it is a few rows
    counts = suspects.distinct().groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)
    # a hot key has many suspects and one count: adaptive execution splits its partition
    lost = suspects.join(counts, "key").where("doc_id < keeper")
    return lost.groupBy("doc_id").agg(F.collect_set("key").alias("lost"))


def drop_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3, most_bits: int = MOST_BITS, into: str = "lines") -> DataFrame:
    """``docs`` and a struct ``into`` (text, n_lines, n_dropped) of what is left.

    Lines whose key has at least ``min_chars`` code points and occurs in at least
    ``min_docs`` documents stay only in the document with the largest id.
    """
    own, gone = fresh(docs, "lost_id"), fresh(docs, "lost")
    lost = lost_lines(docs, doc_id, text, min_chars, min_docs, most_bits).select(F.col("doc_id").alias(own), F.col("lost").alias(gone))
    joined = docs.join(lost, F.col(doc_id) == F.col(own), "left")
    return joined.withColumn(into, _rewrite(min_chars)(F.col(text), F.col(gone))).drop(own, gone)
