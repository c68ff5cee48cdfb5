"""Jaccard self-join of word shingle sets by size-banded tiles and bitmap signatures.

Sets that are alike have like sizes, and differ in few elements: with a similarity of
0.8 or more, sizes x <= y have y <= 1.25 x and at most (x + y) / 9 elements are in one
set only.  Sizes are cut into bands; a band holds the sets of its sizes, and those up to
1.25 times larger than its end.  In a band, the range of hash values is cut into more
parts than a pair can differ in, so two alike sets have equal parts.  Parts are put in
one order for all sets, and the first of a set, one more than it can differ in, are its
keys: the first equal part of two sets is among these of both.  The order puts parts
last that many sets have, such as those within a passage that many documents share.
Which these are is learned from a sample of documents (``SAMPLE``); the order decides how
many pairs are looked at, never which links are found.  A set with too few parts that
are not empty (only small ones) has keys for its smallest elements as well.

Sets that share a key are compared in three steps.

1. Each meets the smallest of its key; the links found make components.
2. Keys with members of several components are cut into tiles: a block of members
   outside the largest component (``BLOCK``), against a slice of all members
   (``SLICE``).  A bitmap signature holds the parity of the elements of each bit, so
   the bits that differ count at least once for each element of one set only, and the
   overlap is at most half of the sizes less these bits.  Pairs with a bound below the
   overlap they need are left out.
3. The rest is verified by an intersection of the whole sorted sets of hashes.

A member first gives its best candidate of each other component only.  If it had more
and is still apart from one of them, steps 2 and 3 are repeated for it with a larger
number, until no such member is left: groups of copies become one component after the
first steps and give no pairs, and no link between different components is lost.  A
pair is verified once; the links of a round unite the components there are, which costs
what the new links cost.

Defined cases: shingles are compared as 64-bit hashes; fewer words than a shingle has
are one shingle; no word gives the empty set, which is linked with nothing; equal sets
are one node from the start; null doc_ids belong to components but name none; repeated
rows are copies.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaflow.llm.common import Memo, claim, lists, portions, remembers, utf8
from taxaflow.llm.components import components
from taxaflow.session import discard, durable

WIDTH = 5
#: Members of a tile on either side, and pairs of a tile that are compared one by one.
BLOCK, SLICE, FEW = 1024, 1 << 16, 64
#: Candidates of a member in each other component in the first round of tiles, and the factor from round to round.
FIRST, MORE = 1, 8
#: Ratio of the sizes of a band.
RATIO = 1.5625
#: Documents, about, that tell frequent parts, and how many of them must have a part.
SAMPLE, FREQUENT = 20_000, 5

_word_hash = Memo(lambda word: xxhash.xxh64_intdigest(word, 11))
remembers("jaccard_join", _word_hash.clear)


def mixed(h: np.ndarray) -> np.ndarray:
    """64 bits, each of which depends on all bits of ``h``."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Hashes of the distinct word shingles of a text, ascending."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    single = np.fromiter(map(_word_hash.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    h = np.full(n, width, np.uint64)
    for i in range(width):
        h = mixed(h + single[i : n + i])
    return np.unique(h)


def band_of(size: int) -> int:
    """The band that holds a size as its own."""
    band = 0
    while edge(band + 1) <= size:
        band += 1
    return band


def edge(band: int) -> int:
    """First size of a band."""
    return ceil(RATIO**band)


def bands(size: int) -> list[tuple[int, int]]:
    """(band, most elements in one set only, of pairs in this band) that a set of ``size`` takes part in."""
    own = band_of(size)
    out = [(own, size // 4)]
    if own and 4 * size <= 5 * (edge(own) - 1):
        out.append((own - 1, (size + edge(own) - 1) // 9))
    return out


def parts_of(band: int) -> int:
    """Parts of the range of hashes in a band: sets of its sizes have, nearly always, more that are not empty than a pair differs in."""
    most = edge(band + 1)
    return ceil(0.3 * most) + isqrt(2 * most) + 4


def parts(elements: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.uint64]]:
    """For each band of a set: keys (48 bits) of its parts that are not empty, the most differences, and a salt."""
    for band, differ in bands(len(elements)):
        part = ((elements >> np.uint64(32)) * np.uint64(parts_of(band))) >> np.uint64(32)
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        salt = np.uint64((band + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        yield mixed(np.add.reduceat(mixed(elements), starts) + part[starts] + salt) >> np.uint64(16), differ, salt


class Frequent:
    """Numbers of sampled sets that have the parts many of them have; none has others."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order].astype(np.uint64), counts[order]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[at], 0)

    def first(self, keys: np.ndarray, n: int) -> np.ndarray:
        """The first ``n`` keys in the order of their numbers, and of themselves where these are equal."""
        if len(keys) <= n:
            return keys
        counts = self(keys)
        rare = keys[counts == 0]
        if len(rare) > n:
            return np.partition(rare, n - 1)[:n]
        return keys[np.lexsort((keys, counts))[:n]]


def keys_of(elements: np.ndarray, frequent: Frequent) -> np.ndarray:
    """The first keys of a set in each of its bands, rare ones before frequent ones."""
    out = []
    for keys, differ, salt in parts(elements):
        out.append(frequent.first(keys, differ + 1))
        if len(keys) <= differ:
            prefix = elements[: len(elements) - ceil(0.8 * len(elements)) + 1]
            out.append(mixed(mixed(prefix) ^ salt) >> np.uint64(16))
    return np.unique(np.concatenate(out)).view(np.int64)


def signature(elements: np.ndarray) -> bytes:
    """Bitmap of parities: a power of two of bits, two or more for each element."""
    bits = 64
    while bits < 2 * len(elements):
        bits *= 2
    at = (mixed(elements + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(1)).astype(np.int64) & (bits - 1)
    return np.packbits(np.bincount(at, minlength=bits) & 1, bitorder="little").tobytes()


def folded(words: np.ndarray, n: int) -> np.ndarray:
    """Signatures (rows of 64-bit words) brought to ``n`` words: parities of longer ones add up."""
    while words.shape[1] > n:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def bits_between(one: bytes, other: bytes) -> int:
    """Bits that differ between two signatures, the longer one brought to the length of the other."""
    if len(one) < len(other):
        one, other = other, one
    x, size = int.from_bytes(one, "little"), 8 * len(one)
    while size > 8 * len(other):
        size //= 2
        x = (x >> size) ^ (x & (1 << size) - 1)
    return (x ^ int.from_bytes(other, "little")).bit_count()


class Signatures:
    """Sizes and bitmaps of sets, by length of the bitmap."""

    def __init__(self, sizes: list[int], bitmaps: list[bytes]):
        self.groups = []
        lengths = np.array([len(b) for b in bitmaps], np.int64)
        for length in np.unique(lengths):
            at = np.flatnonzero(lengths == length)
            words = np.frombuffer(b"".join([bitmaps[i] for i in at]), np.uint64).reshape(len(at), -1)
            self.groups.append((at, np.array(sizes, np.int64)[at], {words.shape[1]: words}))

    def bits(self, size: int, bitmap: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Which of the sets another one may be linked with by sizes and bitmaps, and how many bits differ."""
        own = np.frombuffer(bitmap, np.uint64)[None]
        hits, bits = [], []
        for at, sizes, words in self.groups:
            n = min(own.shape[1], max(words))
            if n not in words:
                words[n] = folded(words[max(words)], n)
            differ = np.bitwise_count(words[n] ^ folded(own, n)).sum(axis=1, dtype=np.int64)
            # the overlap is at most half of the sizes less the bits; a link needs 4/9 of the sizes
            ok = np.flatnonzero((4 * sizes <= 5 * size) & (4 * size <= 5 * sizes) & ((size + sizes - differ) // 2 >= -(-4 * (size + sizes) // 9)))
            hits.append(at[ok])
            bits.append(differ[ok])
        return np.concatenate(hits), np.concatenate(bits)


def _sampled(width: int):
    """Texts to the keys of all their parts."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("jaccard_join")
        for rows in batches:
            texts = utf8(rows.column("text"))
            for part in portions(texts):
                keys = [k for x in texts[part] if len(elements := shingle_set(x, width)) for k, _, _ in parts(elements)]
                if keys:
                    yield pa.record_batch([pa.array(np.concatenate(keys).view(np.int64))], ["key"])

    return stream


def _describe(width: int, model):
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("jaccard_join")
        frequent = model.value
        for rows in batches:
            ids, names = rows.column("doc_id"), rows.column("text_id")
            for part in portions(texts := utf8(rows.column("text"))):
                nodes, sizes, bitmaps, keys, seen = [], [], [], [], set()
                for text in texts[part]:
                    elements = shingle_set(text, width)
                    n = len(elements)
                    node = int(mixed(np.add.reduce(mixed(elements + np.uint64(n)), keepdims=True)).view(np.int64)[0]) if n else None
                    # copies within a batch post their keys once
                    keys.append(keys_of(elements, frequent) if n and node not in seen else np.zeros(0, np.int64))
                    bitmaps.append(signature(elements) if n and node not in seen else None)
                    seen.add(node)
                    nodes.append(node)
                    sizes.append(n)
                yield pa.record_batch(
                    [ids[part.start : part.stop], names[part.start : part.stop], pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()),
                     pa.array(bitmaps, pa.binary()), lists(np.concatenate(keys), np.array([len(k) for k in keys]), pa.int64())],
                    ["doc_id", "text_id", "node", "n", "bitmap", "keys"],
                )

    return stream


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node), ordered, to those whose key has several nodes, each once."""
    held = None
    last = (None, None)  # the last row given out or dropped as a repetition

    def rows_out(keys: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(keys), pa.array(nodes)], ["key", "node"])

    for rows in batches:
        keys, nodes = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        if held is not None:
            keys, nodes = np.r_[held[0], keys], np.r_[held[1], nodes]
        if not len(keys):
            continue
        new = np.r_[True, (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])]
        keys, nodes = keys[new], nodes[new]
        before = np.r_[last[0] == keys[0] if last[0] is not None else False, keys[1:] == keys[:-1]]
        after = np.r_[keys[1:] == keys[:-1], False]
        take = before | after
        take[-1] = False  # it is decided with the next batch
        if len(keys) > 1:
            last = (keys[-2], nodes[-2])
        held = keys[-1:], nodes[-1:]
        if take.any():
            yield rows_out(keys[take], nodes[take])
    if held is not None and last[0] is not None and last[0] == held[0][0]:
        yield rows_out(*held)


def _tiles(quota: int):
    """Rows of tiles (key, block, slice; probes first, which may be targets as well) to candidate pairs (a, b, more)."""

    def candidates(probes: list, targets: list) -> Iterator[tuple[int, int, bool]]:
        if len(probes) * len(targets) <= FEW:
            for node, n, bitmap, label in probes:
                near = {}
                for other, m, its, its_label in targets:
                    if its_label != label and 4 * m <= 5 * n and 4 * n <= 5 * m:
                        differ = bits_between(bitmap, its)
                        if (n + m - differ) // 2 >= -(-4 * (n + m) // 9):
                            near.setdefault(its_label, []).append((differ, other))
                for found in near.values():
                    for _, other in sorted(found)[:quota]:
                        yield node, other, len(found) > quota
            return
        nodes, sizes, bitmaps, labels = zip(*targets)
        nodes, labels, others = np.array(nodes, np.int64), np.array(labels, np.int64), Signatures(sizes, bitmaps)
        for node, n, bitmap, label in probes:
            hits, differ = others.bits(n, bitmap)
            new = labels[hits] != label
            hits, differ = hits[new], differ[new]
            if not len(hits):
                continue
            hits = hits[np.lexsort((nodes[hits], differ, labels[hits]))]
            group = labels[hits]
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            for a, b in zip(starts, np.r_[starts[1:], len(hits)]):
                for i in hits[a : min(b, a + quota)]:
                    yield node, int(nodes[i]), bool(b - a > quota)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, probes, targets, out = None, [], [], []

        def flush() -> None:
            if probes and targets:
                out.extend(candidates(probes, targets))
            targets.clear()

        def batch() -> pa.RecordBatch:
            a, b, more = zip(*out)
            out.clear()
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(more)], ["a", "b", "more"])

        for rows in batches:
            for key, block, part, probe, target, *member in zip(*(c.to_pylist() for c in rows.columns)):
                if (key, block, part) != tile:
                    flush()
                    tile = key, block, part
                    probes.clear()
                if probe:
                    probes.append(member)
                if target:
                    targets.append(member)
                    if len(targets) == 4096 and not probe:
                        flush()
            if len(out) > 10_000:
                yield batch()
        flush()
        if out:
            yield batch()

    return stream


def overlap_reaches(one: bytes, other: bytes) -> bool:
    """Whether 100 times the intersection of two sorted sets is at least 80 times their union."""
    x, y = np.frombuffer(one, np.uint64), np.frombuffer(other, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= 80 * (len(x) + len(y) - both)


def _reaches(one: pa.Array, other: pa.Array) -> pa.Array:
    return pa.array([overlap_reaches(a, b) for a, b in zip(one.to_pylist(), other.to_pylist())], pa.bool_())


def _bounded(n: pa.Array, bitmap: pa.Array, m: pa.Array, other: pa.Array) -> pa.Array:
    rows = zip(n.to_pylist(), bitmap.to_pylist(), m.to_pylist(), other.to_pylist())
    fits = lambda x, a, y, b: 4 * x <= 5 * y and 4 * y <= 5 * x and (x + y - bits_between(a, b)) // 2 >= -(-4 * (x + y) // 9)
    return pa.array([fits(*row) for row in rows], pa.bool_())


def _sets(width: int):
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("jaccard_join")
        for rows in batches:
            texts, nodes = utf8(rows.column("text")), rows.column("node")
            for part in portions(texts):
                found = [shingle_set(x, width).tobytes() for x in texts[part]]
                yield pa.record_batch([nodes[part.start : part.stop], pa.array(found, pa.binary())], ["node", "elements"])

    return stream


class _Join:
    """The tables of one join, and the steps over them."""

    def __init__(self, docs: DataFrame, width: int):
        self.width = width
        text_id = F.xxhash64("text", "doc_id")
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("text_id", text_id)
        frequent = self.docs.sparkSession.sparkContext.broadcast(self.frequent_parts())
        self.own = durable(self.docs.mapInArrow(_describe(width, frequent), "doc_id long, text_id long, node long, n long, bitmap binary, keys array<long>"))
        self.nodes = durable(
            self.own.where("bitmap is not null").groupBy("node").agg(F.min("text_id").alias("text_id"), F.min("n").alias("n"), F.min("bitmap").alias("bitmap"))
        )
        frequent.destroy()
        posted = self.own.select(F.explode("keys").alias("key"), "node").repartition("key").sortWithinPartitions("key", "node")
        self.shared = durable(posted.mapInArrow(_shared, "key long, node long"))

    def frequent_parts(self) -> Frequent:
        """Parts that several of a sample of documents have; their number is bounded by the sample."""
        share = SAMPLE / max(1, self.docs.count())
        sample = self.docs.where(F.pmod("text_id", F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("text")
        counts = sample.mapInArrow(_sampled(self.width), "key long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
        rows = counts.toPandas()
        return Frequent(rows["key"].to_numpy(), rows["n"].to_numpy())

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Links among pairs (a, b): the whole sets are made once for each node, and joined to its pairs."""
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        wanted = durable(wanted.join(self.nodes, "node").select("text_id", "node"))
        texts = self.docs.select("text_id", "text").join(wanted, "text_id")
        sets = durable(texts.mapInArrow(_sets(self.width), "node long, elements binary").dropDuplicates(["node"]))
        one = pairs.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("x")), "a")
        both = one.join(sets.select(F.col("node").alias("b"), F.col("elements").alias("y")), "b")
        links = durable(both.where(F.arrow_udf(_reaches, "boolean")("x", "y")).select("a", "b"))
        discard(wanted, sets)
        return links

    def first_links(self) -> DataFrame:
        """Links of each member with the smallest of its key."""
        heads = durable(self.shared.groupBy("key").agg(F.min("node").alias("head")))
        pairs = self.shared.join(heads, "key").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
        sized = self.nodes.select("node", "n", "bitmap")
        one = pairs.join(sized.withColumnsRenamed({"node": "a", "n": "x", "bitmap": "p"}), "a")
        both = one.join(sized.withColumnsRenamed({"node": "b", "n": "y", "bitmap": "q"}), "b")
        likely = durable(both.where(F.arrow_udf(_bounded, "boolean")("x", "p", "y", "q")).select("a", "b"))
        links = self.verified(likely)
        discard(heads, likely)
        return links

    def candidates(self, labels: DataFrame, apart: DataFrame | None, quota: int, block: int, part: int) -> DataFrame:
        """Candidate pairs (a, b, more) of different components that share a key, one of them in ``apart`` if that is given."""
        named = self.nodes.select("node", "n", "bitmap").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        named = durable(named)
        members = durable(self.shared.join(named.select("node", "label"), "node"))
        crowds = members.groupBy("key", "label").agg(F.count("*").alias("size"))
        split = durable(
            crowds.groupBy("key").agg(F.max(F.struct("size", "label")).alias("top"), F.sum("size").alias("all"), F.count("*").alias("labels"))
            .where("labels > 1").select("key", F.col("top.label").alias("largest"), "all", (F.col("all") - F.col("top.size")).alias("others"))
        )
        at, asked = members.join(split, "key"), None
        if apart is None:
            at = at.withColumn("probe", F.col("label") != F.col("largest"))
        else:
            at = at.join(apart.withColumn("probe", F.lit(True)), "node", "left").withColumn("probe", F.coalesce("probe", F.lit(False)))
            asked = durable(at.where("probe").groupBy("key").agg(F.count("*").alias("asked")))
            at = at.join(asked, "key").withColumn("others", F.col("asked"))
        number = lambda size, most: F.greatest(F.lit(1), F.ceil(F.col(size) / most)).cast("long")
        at = at.withColumns({"blocks": number("others", block), "parts": number("all", part), "hash": F.xxhash64("node")})
        one = (F.col("blocks") == 1) & (F.col("parts") == 1)
        zero = F.lit(0).cast("long")
        # one row is a member on both sides of its only tile; larger keys give probes and targets of their own
        alone = at.where(one).select("key", zero.alias("block"), zero.alias("part"), "probe", F.lit(True).alias("target"), "node")
        large = at.where(~one)
        each = lambda size: F.explode(F.sequence(zero, F.col(size) - 1))
        probes = large.where("probe").select("key", F.pmod("hash", "blocks").alias("block"), each("parts").alias("part"), "probe", F.lit(False).alias("target"), "node")
        targets = large.select("key", each("blocks").alias("block"), F.pmod(F.shiftright("hash", 20), F.col("parts")).alias("part"), F.lit(False).alias("probe"), F.lit(True).alias("target"), "node")
        rows = alone.unionByName(probes).unionByName(targets).join(named, "node")
        dealt = rows.select("key", "block", "part", "probe", "target", "node", "n", "bitmap", "label").repartition("key", "block", "part")
        dealt = dealt.sortWithinPartitions("key", "block", "part", F.desc("probe"))
        pairs = dealt.mapInArrow(_tiles(quota), "a long, b long, more boolean")
        pairs = pairs.groupBy("a", "b").agg(F.max("more").alias("more"))
        found = durable(pairs)
        discard(named, members, split, asked)
        return found

    def united(self, labels: DataFrame, links: DataFrame) -> DataFrame:
        """``(node, label)`` with the components that ``links`` connect made one."""
        if links.isEmpty():
            return labels
        ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
        named = durable(labels.join(ends, "node", "full_outer").select("node", F.coalesce("label", "node").alias("label")))
        a, b = (named.withColumnsRenamed({"node": x, "label": f"label_{x}"}) for x in "ab")
        groups = components(links.join(a, "a").join(b, "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")))
        groups = groups.select(F.col("label").alias("least"), F.col("node").alias("label"))
        new = durable(named.join(groups, "label", "left").select("node", F.coalesce("least", "label").alias("label")))
        discard(labels, named)
        return new

    def components(self, block: int, part: int) -> DataFrame:
        """``(node, label)`` of linked nodes."""
        links = self.first_links()
        labels, apart, quota, tried = durable(components(links)), None, FIRST, None
        discard(links)
        while True:
            pairs = self.candidates(labels, apart, quota, block, part)
            once = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            once = durable(once if tried is None else once.join(tried, ["a", "b"], "left_anti"))
            if not once.isEmpty():
                links = self.verified(once)
                labels = self.united(labels, links)
                discard(links)
            a, b = (labels.withColumnsRenamed({"node": x, "label": f"label_{x}"}) for x in "ab")
            open_pairs = pairs.where("more").join(a, "a", "left").join(b, "b", "left")
            left = open_pairs.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select(F.col("a").alias("node")).distinct()
            before, apart = apart, durable(left)
            discard(pairs, before)
            if apart.isEmpty():
                discard(once, tried, apart)
                return labels
            # what was verified comes again among more candidates, unless it was a link
            both = once if tried is None else durable(tried.union(once))
            if both is not once:
                discard(tried, once)
            tried = both
            quota *= MORE


def similar_sets(docs: DataFrame, width: int = WIDTH, block: int = BLOCK, part: int = SLICE) -> DataFrame:
    """Per row of ``docs``: doc_id, ``n_shingles`` and ``component_id``, the smallest doc_id it reaches by links."""
    join = _Join(docs, width)
    labels = join.components(block, part)
    least = durable(join.own.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least")))
    labelled = least.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    groups = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    of = durable(labelled.join(groups, "label").select("node", "component_id"))
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    out = durable(join.own.select("doc_id", "node", "n").join(of, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), own))
    discard(join.own, join.nodes, join.shared, least, labels, of)
    return out
