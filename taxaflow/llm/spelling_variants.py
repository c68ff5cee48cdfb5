"""Spelling variants of words by an index of variable-length grams.

Words that differ by one inserted, deleted or replaced code point are near.  Grams of
``SHORT`` code points are lengthened, up to ``LONG``, where many words have them; the
dictionary keeps the longer ones that enough words have, and its size is bounded by the
number of grams over the frequency asked for.  A word is cut into the longest gram of
the dictionary (at least ``SHORT``) at each position, without those inside another one.

An edit changes few of these.  For every gram of a word the edits that might change it
are an interval: those on it, those to its left that a longer gram may span together
with it, and those to its right up to where the dictionary could lengthen a gram that
starts no later.  The largest number of intervals on one point bounds the grams that an
edit affects, so near words share at least the others, and each list of a gram needs to
be looked up only for the rarest grams of a word, one more than an edit affects.  Words
in which one edit may affect all grams are in a second index of grams of ``SHORT`` code
points, of which one edit affects that many at most; two such words meet there.

Lists are kept by gram, position and length, since an edit shifts positions by at most
one.  Members of a list are compared by their common prefixes and suffixes, which is the
exact check.  A list over ``LIST`` is not held: its members are dealt once more by what
they have before, or after, the middle of the longer word, one of which an edit leaves
as it is.

Defined cases: null and empty text has no words; a null doc_id is empty in the rule that
changes runs; repeated rows count again; a run of one code point that loses it is no
word; words of any length are taken whole.  No word gives no rows.  Columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaflow.llm.common import utf8
from taxaflow.session import discard, durable

#: Least length of a word, least number of occurrences, how much more frequent the form of a word is.
LETTERS, OCCURRENCES, TIMES = 6, 5, 5
#: One run in so many loses a code point.
CHANGED = 199
#: Lengths of grams; grams of the dictionary, about, at most.
SHORT, LONG, GRAMS = 3, 6, 50_000
#: Longest list that a task holds as it is, pairs compared at once, and pairs of a list that are compared one by one.
LIST, TOGETHER, FEW = 4096, 1 << 18, 48
#: Runs counted in a task before the counts are given to Spark.
COUNTED = 200_000

#: Whole runs of enough code points; shorter ones can't become words.
RUNS = re.compile(f"[a-zÀ-ÿ]{{{LETTERS},}}")


def runs_of(doc_id: int | None, text: bytes) -> Counter:
    """Numbers of the lower-cased runs of a text that are long enough, those changed that the rule says."""
    start = crc32(b"" if doc_id is None else str(doc_id).encode())
    start = crc32(b":", start)
    out = Counter()
    for run, n in Counter(RUNS.findall(text.lower().decode())).items():
        h = crc32(run.encode(), start)
        if h % CHANGED == 0:
            run = run[: h % len(run)] + run[h % len(run) + 1 :]
        out[run] += n
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = Counter()

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    for rows in batches:
        for doc_id, text in zip(rows.column(0).to_pylist(), utf8(rows.column(1))):
            for run, n in runs_of(doc_id, text).items():
                if len(run) >= LETTERS:
                    total[run] += n
            if len(total) >= COUNTED:
                yield batch()
                total.clear()
    if total:
        yield batch()


def vocabulary(docs: DataFrame) -> DataFrame:
    """``(word, n)``: words of ``LETTERS`` code points or more with their occurrences, if these are enough."""
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURRENCES)


class Grams:
    """The dictionary of variable-length grams, with the number of words' positions that have them."""

    def __init__(self, counts: dict[str, int], often: float):
        """Grams are extended where their own count is over ``often``; an extension needs an eighth of it."""
        self.counts = {g: n for g, n in counts.items() if len(g) == SHORT}
        for size in range(SHORT + 1, LONG + 1):
            longer = {g: n for g, n in counts.items() if len(g) == size and n * 8 > often and self.counts.get(g[:-1], 0) > often}
            if not longer:
                break
            self.counts |= longer
        self.kept = {g for g in self.counts if len(g) > SHORT}
        self.inner = {g[:i] for g in self.kept for i in range(1, len(g))}

    def cut(self, word: str) -> list[tuple[int, int]]:
        """Intervals (start, end) of the grams of a word."""
        out, reached = [], 0
        for p in range(len(word) - SHORT + 1):
            end = p + SHORT
            for e in range(min(len(word), p + LONG), end, -1):
                if word[p:e] in self.kept:
                    end = e
                    break
            if end > reached:
                out.append((p, end))
                reached = end
        return out

    def affected(self, word: str, grams: list[tuple[int, int]]) -> int:
        """The most grams of a word that one edit may change.

        The edit of code point i is at 2 i + 1, an insertion before it at 2 i.
        """
        ends, furthest = [], 0
        grams_at, reach = dict(grams), []
        for p in range(len(word)):
            e = p + 1
            while e < len(word) and e - p < LONG - 1 and word[p : e + 1] in self.inner:
                e += 1
            furthest = max(furthest, e if word[p:e] in self.inner else 0)
            reach.append(furthest)
        for p, end in grams_at.items():
            ends.append((2 * (end - LONG) + 1, 0))
            ends.append((max(2 * end - 1, 2 * reach[p] + 1), 1))
        open_now = most = 0
        for _, closes in sorted(ends):
            open_now += -1 if closes else 1
            most = max(most, open_now)
        return most

    def keys(self, word: str) -> list[tuple[str, int]]:
        """(gram, start) under which a word is posted: the rarest, one more than an edit affects; grams of the second index start with a blank."""
        grams = self.cut(word)
        rare = sorted((self.counts.get(word[p:e], 0), word[p:e], p) for p, e in grams)
        least = len(grams) - self.affected(word, grams)
        out = [(g, p) for _, g, p in rare[: len(grams) - max(least, 1) + 1]]
        if least < 1:
            short = sorted((self.counts.get(word[p : p + SHORT], 0), word[p : p + SHORT], p) for p in range(len(word) - SHORT + 1))
            out += [(f" {g}", p) for _, g, p in short[: SHORT + 1]]
        return out


def dictionary(words: DataFrame) -> Grams:
    """The dictionary of a vocabulary; what comes to the driver is bounded by ``GRAMS`` and the letters there are.

    The counts of a length are asked for only where the gram without its last code
    point is frequent, so a length adds few more than eight times ``GRAMS``.
    """
    size = F.length("word")
    total = words.agg(F.sum(size)).first()[0] or 0
    often = max(16.0, total / GRAMS)
    counts: dict[str, int] = {}
    for n in range(SHORT, LONG + 1):
        at = F.explode(F.sequence(F.lit(1), size - n + 1))
        grams = words.where(size >= n).select("word", at.alias("p")).select(F.substring("word", F.col("p"), F.lit(n)).alias("g"))
        seen = grams.groupBy("g").agg(F.count("*").alias("n"))
        # rare short grams need no entry: they count as none, the same for all words
        counts |= dict(seen.where(F.col("n") * 8 > often).toPandas().itertuples(index=False))
    return Grams(counts, often)


def _post(model):
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = model.value
        for rows in batches:
            keys, words, counts, sides = [], [], [], []
            for word, n in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                own = grams.keys(word)
                size = len(word)
                # as a member; as the shorter of two words, under what the longer one has left and right of an edit
                at = {(0, p, size, g) for g, p in own} | {(1, p + d, size + 1, g) for g, p in own for d in (0, 1)}
                for side, p, length, g in at:
                    keys.append(xxhash.xxh64_intdigest(f"{g}|{p}|{length}") >> 1)
                    words.append(word)
                    counts.append(n)
                    sides.append(side)
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(sides, pa.int32()), pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["key", "side", "word", "n"])

    return stream


def is_near(short: str, long: str) -> bool:
    """Whether two different words, of one length or one code point apart, are near."""
    i = next((i for i, (x, y) in enumerate(zip(short, long)) if x != y), len(short))
    return short[i + len(short) + 1 - len(long) :] == long[i + 1 :]


def packed(words: list[str], size: int, right: bool = False) -> np.ndarray:
    """Words of one length as rows of 64-bit numbers, a byte for each letter (all are below 256), filled with zeros at the end (``right``: in front)."""
    width = -(-size // 8) * 8
    fill = bytes(width - size)
    rows = [fill + w.encode("latin-1") if right else w.encode("latin-1") + fill for w in words]
    return np.frombuffer(b"".join(rows), "<u8").reshape(len(words), width // 8)


def equal_first(differ: list[np.ndarray]) -> np.ndarray:
    """Bytes before the first one that is not zero, of numbers that follow each other."""
    out = np.zeros(differ[0].shape, np.int64)
    for x in reversed(differ):
        out = np.where(x == 0, 8 + out, np.bitwise_count((x & -x) - np.uint64(1)) // 8)
    return out


def equal_last(differ: list[np.ndarray]) -> np.ndarray:
    """Bytes after the last one that is not zero."""
    out = np.zeros(differ[0].shape, np.int64)
    for x in differ:
        seen = x.copy()
        for shift in (1, 2, 4, 8, 16, 32):
            seen |= seen >> np.uint64(shift)
        out = np.where(x == 0, 8 + out, (64 - np.bitwise_count(seen).astype(np.int64)) // 8)
    return out


def unequal(differ: list[np.ndarray]) -> np.ndarray:
    """Bytes that are not zero."""
    out = np.zeros(differ[0].shape, np.int64)
    for x in differ:
        seen = x | x >> np.uint64(4)
        seen |= seen >> np.uint64(2)
        seen |= seen >> np.uint64(1)
        out += np.bitwise_count(seen & np.uint64(0x0101010101010101))
    return out


def near_pairs(short: list[str], long: list[str]) -> Iterator[tuple[int, int]]:
    """Index pairs of different words that are near: those of one list, or a shorter and a longer one."""
    same = short is long
    if len(short) * len(long) <= FEW:
        yield from ((i, j) for i, a in enumerate(short) for j, b in enumerate(long) if (i < j or not same) and is_near(a, b))
        return
    size = len(short[0])
    # a shorter word against the longer one without its last letter, and without its first
    x, y = packed(short, size), packed(long if same else [w[:-1] for w in long], size)
    if not same:
        back, other = packed(short, size, True), packed([w[1:] for w in long], size, True)
    words, step = range(x.shape[1]), max(1, int((TOGETHER / x.shape[1]) ** 0.5))
    for i in range(0, len(x), step):
        for j in range(i if same else 0, len(y), step):
            block = lambda a, b: [a[i : i + step, None, w] ^ b[None, j : j + step, w] for w in words]  # noqa: B023, E731
            if same:
                near = unequal(block(x, y)) == 1
            else:
                near = np.minimum(equal_first(block(x, y)), size) + np.minimum(equal_last(block(back, other)), size) >= size
            for p, q in zip(*np.nonzero(near)):
                if not same or i + p < j + q:
                    yield i + int(p), j + int(q)


def _compare(longest: int | None):
    """Rows (key, side, word, n), by key, to near pairs (a, b, n of each); members of a list that is too long as (key, side, a, n)."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides, out = None, ([], []), []

        def batch() -> pa.RecordBatch:
            names = ["key", "side", "a", "n", "b", "m"]
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            made = pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)
            out.clear()
            return made

        def close() -> None:
            own, shorter = sides
            for one in (own, shorter):
                if own and one and (one is shorter or len(own) > 1):
                    words = [[w for w, _ in x] for x in (one, own)]
                    for i, j in near_pairs(words[0] if one is shorter else words[1], words[1]):
                        out.append((None, None, *one[i], *own[j]))
            own.clear()
            shorter.clear()

        long_key = None
        for rows in batches:
            for k, side, word, n in zip(*(c.to_pylist() for c in rows.columns)):
                if k != key:
                    close()
                    key = k
                if k == long_key:
                    out.append((k, side, word, n, None, None))
                    continue
                sides[side].append((word, n))
                if longest and len(sides[0]) + len(sides[1]) > longest:
                    long_key = k
                    for i in (0, 1):
                        out.extend((k, i, w, m, None, None) for w, m in sides[i])
                        sides[i].clear()
            if out:
                yield batch()
        close()
        if out:
            yield batch()

    return stream


def near_words(words: DataFrame, longest: int = LIST) -> DataFrame:
    """Near pairs ``(a, n, b, m)`` of a vocabulary ``(word, n)``, each once."""
    model = words.sparkSession.sparkContext.broadcast(dictionary(words))
    posted = words.select("word", "n").mapInArrow(_post(model), "key long, side int, word string, n long")
    schema = "key long, side int, a string, n long, b string, m long"
    dealt = posted.repartition("key").sortWithinPartitions("key", "side")
    found = durable(dealt.mapInArrow(_compare(longest), schema))
    model.destroy()
    # in a list, the longer word has length + side code points; up to the middle, or from there, both are equal
    middle = F.floor((F.length("a") + F.col("side")) / 2).cast("int")
    halves = F.array(F.struct(F.lit("l").alias("h"), F.substring("a", F.lit(1), middle).alias("x")), F.struct(F.lit("r").alias("h"), F.expr("substring(a, floor((length(a) + side) / 2) + 1 + if(side = 1, 0, 1))").alias("x")))
    long_lists = found.where("b is null").select("key", "side", "a", "n", F.inline(halves))
    again = long_lists.select(F.xxhash64("key", "h", "x").alias("key"), "side", F.col("a").alias("word"), "n")
    rest = again.repartition("key").sortWithinPartitions("key", "side").mapInArrow(_compare(None), schema)
    pairs = found.where("b is not null").unionByName(rest).select(
        F.least("a", "b").alias("a"), F.when(F.col("a") < F.col("b"), F.col("n")).otherwise(F.col("m")).alias("n"),
        F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("m")).otherwise(F.col("n")).alias("m"),
    )
    return pairs.distinct()


def variants(docs: DataFrame, longest: int = LIST) -> DataFrame:
    """Per word of ``docs``: ``n`` occurrences, ``n_near`` near words, its ``form`` with ``form_n``, and ``root``, where forms lead."""
    words = durable(vocabulary(docs))
    pairs = durable(near_words(words, longest))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("m").alias("n"), F.col("a").alias("b"), F.col("n").alias("m")))
    best = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "b")).alias("top"))
    enough = -F.col("top.m") >= TIMES * F.col("n")
    table = durable(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(enough, F.col("top.b")).alias("form"), F.when(enough, -F.col("top.m")).alias("form_n"),
    ))
    # forms are more frequent each time, so a path is short; every round doubles the steps
    root = durable(table.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        after = root.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = durable(root.join(after, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        discard(root)
        root = new.select("word", "root")
        root.durable_folder = new.durable_folder
        if new.where("moved").isEmpty():
            break
    out = durable(table.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
    discard(words, pairs, table, root)
    return out
