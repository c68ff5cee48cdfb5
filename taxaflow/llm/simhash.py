"""SimHash near-duplicates by an inverted index of byte positions.

Two 64-bit fingerprints at no more than four differing bits share at least four of
their eight bytes at the same position.  The index holds each distinct fingerprint
under bytes of three positions: 20 triples of positions are enough for any four
shared positions to contain one of them.  Within a posting list the positional bytes
that two fingerprints share are tallied, pairs below four are left out, and the rest
is verified by their differing bits.  A list gives a spanning forest of its links,
not all its pairs, so a group of copies gives no more rows than it has members.

Lists too long to hold go another exact way: two fingerprints are at no more than
four bits if some fingerprint lies within two bits of both, so each member is joined
to all fingerprints within two bits of it.

``similar_documents`` finds documents whose shingle sets have a Jaccard similarity of
0.8 or more.  Its fingerprints have 256 bits; candidates share three or more of 32
positional bytes and differ in at most ``WIDE_BITS`` bits (at a similarity of 0.8 they
differ in 38 on average).  Of any three positions two are even or two are odd, so the
pairs of equal parity (240) find all candidates.  Documents are posted under single
bytes; tasks cut these lists by each further byte.  A candidate is given by the first
list that holds it only, and not if its bitmaps tell that the sets are too different:
these hold the parity of the hashes of each bit, so the bits that differ count at least
once for each hash in one set only.  Candidates are verified on their whole sets of
shingle hashes.

A list of two bytes gives all its candidates at any length, unless they are over
``CROWD`` for each member, as in large groups of copies.  Such a list first gives a
spanning forest of the closest; when its links are verified, members that are not
connected yet are compared with all others on their sets, in parts of bounded size,
and only true links connect.  Lists too long to hold are taken in pieces, and pairs
of different pieces in the same way.

Defined cases: no word gives fingerprint zero; null text has no word; fewer words
than a shingle has are one shingle; null doc_ids belong to groups but name none (a
group of nothing else has a null component); repeated rows link as any copies do.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaflow.llm.common import utf8
from taxaflow.llm.components import components
from taxaflow.session import discard, durable

#: Longest posting list that a task holds.
LIST = 1 << 15
#: 64-bit words of a wide fingerprint, the most bits and the least positional bytes of two similar ones.
WIDE, WIDE_BITS, WIDE_SHARED = 4, 60, 3
#: Bits of the parities of a set of shingle hashes.
MARKS = 512
#: Candidates for each member that a list gives at most, bits that link the members of one with more at first, members of a list compared all together.
CROWD, CLOSE_BITS, TOGETHER = 32, 36, 2048
#: Members of a list of one byte that a task holds, members of a part of a crowded list.
WIDE_LIST, PART = 1 << 17, 1 << 11


def triples() -> list[tuple[int, int, int]]:
    """Twenty triples of 8 positions; any 4 positions contain one.

    Positions lie in three classes in a ring; a triple has its three positions in
    one class, or two in one and the third in the next.
    """
    inside = lambda t: [p % 3 for p in t]
    return [t for t in combinations(range(8), 3) if len(set(c := inside(t))) == 1 or len(set(c)) == 2 and (next(x for x in c if c.count(x) == 1) - next(x for x in c if c.count(x) == 2)) % 3 == 1]


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles of a text, repeats included."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, hash_of = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([hash_of(joined, 42)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.r_[0, ends[:-1]][: len(words) - width + 1].tolist()
    return np.array([hash_of(joined[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())], np.uint64)


def majority(hashes: np.ndarray) -> np.ndarray:
    """Per column of hashes (n x words), the bits that over half of them have; zero for no hash."""
    if not len(hashes):
        return np.zeros(hashes.shape[1], np.uint64)
    set_bits = np.zeros(64 * hashes.shape[1], np.int64)
    for i in range(0, len(hashes), 4096):
        bits = np.unpackbits(np.ascontiguousarray(hashes[i : i + 4096]).view(np.uint8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * set_bits > len(hashes), bitorder="little").view(np.uint64)


def fingerprint_of(text: bytes, width: int) -> int:
    """Bits that are set in over half of the hashes of the word shingles."""
    return int(majority(shingle_hashes(text, width)[:, None])[0])


def wide_of(hashes: np.ndarray) -> np.ndarray:
    """The same over 256 bits, which each hash is spread to."""
    spread = []
    with np.errstate(over="ignore"):
        for j in range(WIDE):
            h = hashes + np.uint64(0x9E3779B97F4A7C15 * (j + 1) & (1 << 64) - 1)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            spread.append(h ^ (h >> np.uint64(31)))
    return majority(np.stack(spread, axis=1))


def set_of(hashes: np.ndarray) -> bytes:
    """The distinct hashes in order, 32 bits of each."""
    return np.unique((hashes >> np.uint64(32)).astype("<u4")).tobytes()


def marks_of(hashes: bytes) -> bytes:
    """Bitmap of the parities of a set of hashes."""
    at = np.frombuffer(hashes, "<u4") % MARKS
    return np.packbits(np.bincount(at, minlength=MARKS) & 1, bitorder="little").tobytes()


def similarities(one: bytes, others: list[bytes]) -> np.ndarray:
    """Jaccard similarity of a set to others; empty sets are equal."""
    x, flat = np.frombuffer(one, "<u4"), np.frombuffer(b"".join(others), "<u4")
    sizes = np.array([len(y) // 4 for y in others], np.int64)
    if not len(x):
        return (sizes == 0).astype(float)
    same = x[np.minimum(np.searchsorted(x, flat), len(x) - 1)] == flat
    common = np.bincount(np.repeat(np.arange(len(others)), sizes), same, minlength=len(others))
    return common / (len(x) + sizes - common)


def fingerprint(text: str | Column, width: int = 5) -> Column:
    """64-bit SimHash of the word shingles of a text, as a long."""

    def of(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint_of(x, width) for x in utf8(texts)], np.uint64).view(np.int64))

    return F.arrow_udf(of, "long")(text)


def wide_fingerprint(text: str | Column, width: int = 5) -> Column:
    """256-bit SimHash as longs ``f0`` to ``f3``, ``hashes``, the set of shingle hashes, and ``marks``, the bitmap of this set, in a struct."""
    names = [f"f{j}" for j in range(WIDE)]

    def of(texts: pa.Array) -> pa.Array:
        hashes = [shingle_hashes(x, width) for x in utf8(texts)]
        rows = np.array([wide_of(x) for x in hashes], np.uint64).reshape(-1, WIDE).view(np.int64)
        columns = [pa.array(np.ascontiguousarray(rows[:, j])) for j in range(WIDE)]
        sets = [set_of(x) for x in hashes]
        return pa.StructArray.from_arrays([*columns, pa.array(sets, pa.binary()), pa.array(map(marks_of, sets), pa.binary())], [*names, "hashes", "marks"])

    return F.arrow_udf(of, f"struct<{','.join(f'{x}:long' for x in names)},hashes:binary,marks:binary>")(text)


def near(one: np.ndarray, others: np.ndarray, bits: int, shared: int) -> np.ndarray:
    """Which rows of ``others`` share enough positional bytes with ``one`` and differ in few enough bits."""
    differ = np.ascontiguousarray(others ^ one)
    tally = (differ.view(np.uint8) == 0).sum(axis=1)
    hits = np.flatnonzero(tally >= shared)
    return hits[np.bitwise_count(differ[hits]).sum(axis=1) <= bits]


def spanning(nodes: np.ndarray, prints: np.ndarray, bits: int, shared: int) -> Iterator[tuple[int, np.ndarray]]:
    """Links of a spanning forest: a node and those that were first reached from it."""
    while len(nodes) > 1:
        queue, nodes, prints = [(nodes[0], prints[0])], nodes[1:], prints[1:]
        while queue and len(nodes):
            node, one = queue.pop()
            hits = near(one, prints, bits, shared)
            if len(hits):
                yield node, nodes[hits]
                queue.extend(zip(nodes[hits], prints[hits]))
                nodes, prints = np.delete(nodes, hits), np.delete(prints, hits, axis=0)


def _links(bits: int, shared: int, longest: int, short: int = 9):
    """Rows (key, node, fingerprint words), ordered by key, to links (a, b), or (a, null, key) for members of a list that is too long.

    With one word the node is the fingerprint.
    """
    names = ["a", "b", "key"]

    def batch(a: list, b: list) -> pa.RecordBatch:
        a, b = (np.concatenate([np.asarray(x, np.int64) for x in y]) if y else np.zeros(0, np.int64) for y in (a, b))
        return pa.record_batch([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], names)

    def members(key: int, nodes: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(nodes), pa.nulls(len(nodes), pa.int64()), pa.array(np.full(len(nodes), key, np.int64))], names)

    def links(keys: np.ndarray, nodes: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        a, b = [], []
        size, end, at = np.repeat(sizes, sizes), np.repeat(starts + sizes, sizes), np.arange(len(keys))
        for step in range(1, short):  # short lists all together: each member and the one ``step`` further
            first = np.flatnonzero((size <= short) & (at + step < end))
            if not len(first):
                break
            differ = np.ascontiguousarray(prints[first] ^ prints[first + step])
            hits = np.flatnonzero((differ.view(np.uint8) == 0).sum(axis=1) >= shared)
            first = first[hits[np.bitwise_count(differ[hits]).sum(axis=1) <= bits]]
            a.append(nodes[first])
            b.append(nodes[first + step])
        for start, n in zip(starts[sizes > short].tolist(), sizes[sizes > short].tolist()):
            for one, found in spanning(nodes[start : start + n], prints[start : start + n], bits, shared):
                a.append(np.full(len(found), one))
                b.append(found)
        return batch(a, b)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, long_key = None, None
        for rows in batches:
            columns = [c.to_numpy() for c in rows.columns]
            new = columns[0], columns[1], np.stack(columns[2:] or columns[1:], axis=1).view(np.uint64)
            if long_key is not None:
                over = new[0] == long_key
                yield members(long_key, new[1][over])
                new = tuple(x[~over] for x in new)
            held = new if held is None else tuple(np.concatenate(x) for x in zip(held, new))
            if not len(held[0]):
                continue
            last = int(np.searchsorted(held[0], held[0][-1], "left"))  # this list may go on
            if last:
                yield links(*(x[:last] for x in held))
                held = tuple(x[last:] for x in held)
            if len(held[0]) > longest:
                long_key = int(held[0][0])
                yield members(long_key, held[1])
                held = tuple(x[:0] for x in held)
        if held is not None and len(held[0]):
            yield links(*held)

    return stream


def links(prints: DataFrame, bits: int = 4, longest: int = LIST) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that connect whatever lies within ``bits`` (at most 4) bits."""
    if not 0 <= bits <= 4:
        raise ValueError("four shared positions are guaranteed up to four bits only")
    byte = [F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)) for p in range(8)]
    keys = [F.shiftleft(F.lit(n).cast("long"), 24) + F.shiftleft(byte[x], 16) + F.shiftleft(byte[y], 8) + byte[z] for n, (x, y, z) in enumerate(triples())]
    posted = prints.select(F.explode(F.array(*keys)).alias("key"), "fp").repartition("key").sortWithinPartitions("key", "fp")
    found = durable(posted.mapInArrow(_links(bits, 8 - bits, longest), "a long, b long, key long"))
    masks = [0, *(1 << i for i in range(64)), *((1 << i) | (1 << j) for i, j in combinations(range(64), 2))]
    within = np.array([m for m in masks if m.bit_count() <= bits / 2], np.uint64).view(np.int64).tolist()
    hot = found.where("b is null").select("a").distinct()
    if bits == 4 or hot.isEmpty():
        between = hot.select("a", F.explode(F.array(*map(F.lit, within))).alias("mask")).select("a", F.col("a").bitwiseXOR(F.col("mask")).alias("middle"))
        met = between.groupBy("middle").agg(F.min("a").alias("b"), F.collect_set("a").alias("members")).where(F.size("members") > 1)
        across = met.select(F.explode("members").alias("a"), "b").where("a <> b")
    else:
        raise ValueError("a list is too long for this number of bits")
    return found.where("b is not null").select("a", "b").unionByName(across).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, bits: int = 4, longest: int = LIST) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, ``fp`` and ``component_id``, the smallest doc_id it reaches by links."""
    own = durable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint("text", width).alias("fp")))
    least = durable(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = components(links(least.select("fp"), bits, longest))
    labelled = least.join(labels, least["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    groups = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    of = labelled.join(groups, "label").select("fp", "component_id")
    return own.join(of, "fp").select("doc_id", "fp", "component_id")


def _byte(place: int) -> Column:
    return F.shiftrightunsigned(f"f{place // 8}", 8 * (place % 8)).bitwiseAND(F.lit(255))


def _grouped(batches: Iterator[pa.RecordBatch], longest: int | None = None) -> Iterator[tuple[pa.Table, bool]]:
    """Rows ordered by their first column, in tables of whole keys, or (true) pieces of a key of more than ``longest`` rows."""
    held, key, long = [], None, False
    for rows in batches:
        if not rows.num_rows:
            continue
        keys = rows.column(0).to_numpy()
        last = int(np.searchsorted(keys, keys[-1], "left"))  # this key may go on
        if keys[-1] != key:
            if long:
                ended = int(np.searchsorted(keys, key, "right"))
                yield pa.Table.from_batches([*held, rows.slice(0, ended)]), True
                held, rows, last = [], rows.slice(ended), last - ended
            if held or last:
                yield pa.Table.from_batches([*held, rows.slice(0, last)]), False
            held, key, long, rows = [], int(keys[-1]), False, rows.slice(last)
        held.append(rows)
        if longest is not None and sum(x.num_rows for x in held) > longest:
            yield pa.Table.from_batches(held), True
            held, long = [], True
    if held:
        yield pa.Table.from_batches(held), long


def _words(rows: pa.Table, first: int) -> np.ndarray:
    return np.stack([rows.column(first + j).to_numpy() for j in range(WIDE)], axis=1).view(np.uint64)


def first_list(same: np.ndarray, place: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Whether the list of the bytes at ``place`` and ``place + step`` is the first one that holds a pair; ``same`` tells its shared bytes."""
    at = np.arange(same.shape[1])
    alike = (at & 1) == (place & 1)[:, None]
    own, other = same & alike & (at < (place + step)[:, None]), same & ~alike
    return (own.sum(axis=1) == 1) & ((other.argmax(axis=1) > place) | (other.sum(axis=1) < 2))


def _candidates(bits: int, shared: int, longest: int, crowd: int, least: float):
    """Rows (key, node, f0 to f3, n, marks), ordered by key (position and byte), to candidates (a, b), or (a, null, key) for members of a crowded list of two bytes.

    All members of a list that comes in pieces count as crowded.
    """

    def batch(a: np.ndarray, b: np.ndarray | None, key: np.ndarray | None) -> pa.RecordBatch:
        return pa.record_batch([pa.array(a), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b), pa.nulls(len(a), pa.int64()) if key is None else pa.array(key)], ["a", "b", "key"])

    def lists(keys: np.ndarray, nodes: np.ndarray, prints: np.ndarray, counts: np.ndarray, marks: np.ndarray, piece: bool) -> Iterator[pa.RecordBatch]:
        order = np.argsort(keys, kind="stable")
        keys, nodes, prints, counts, marks = keys[order], nodes[order], prints[order], counts[order], marks[order]

        def likely(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """Which candidates are given by this list, and may have sets that are similar enough."""
            same = np.ascontiguousarray(prints[a] ^ prints[b]).view(np.uint8) == 0
            differ = np.bitwise_count(marks[a] ^ marks[b]).sum(axis=1, dtype=np.int64)
            fits = (1 + least) * differ <= (1 - least) * (counts[a] + counts[b]) + 1e-6
            return fits & first_list(same, keys[a] >> 24, keys[a] >> 8 & 255)

        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        number, end = np.repeat(np.arange(len(sizes)), sizes), np.repeat(starts + sizes, sizes)
        found, crowded, firsts, steps = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), bool), [], []
        open_ = np.flatnonzero((sizes <= TOGETHER)[number])
        step = 1
        while len(open_ := open_[(open_ + step < end[open_]) & ~crowded[number[open_]]]):  # each member and the one ``step`` further
            for i in range(0, len(open_), 1 << 16):
                first = open_[i : i + (1 << 16)]
                differ = prints[first] ^ prints[first + step]
                hits = np.flatnonzero(np.bitwise_count(differ).sum(axis=1) <= bits)
                first = first[hits[(np.ascontiguousarray(differ[hits]).view(np.uint8) == 0).sum(axis=1) >= shared]]
                first = first[likely(first, first + step)]
                firsts.append(first)
                steps.append(np.full(len(first), step))
                found += np.bincount(number[first], minlength=len(sizes))
            crowded |= found > crowd * sizes
            step += 1
        first, step = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (firsts, steps))
        stay = ~crowded[number[first]]
        yield batch(nodes[first[stay]], nodes[first[stay] + step[stay]], None)
        firsts, seconds = [], []
        for n in np.flatnonzero(sizes > TOGETHER).tolist():
            own, their = nodes[starts[n] : starts[n] + sizes[n]], prints[starts[n] : starts[n] + sizes[n]]
            total, a, b = 0, [], []
            for i in range(len(own) - 1):
                hits = i + 1 + near(their[i], their[i + 1 :], bits, shared)
                hits = hits[likely(np.full(len(hits), starts[n] + i), starts[n] + hits)]
                total += len(hits)
                a.append(np.full(len(hits), own[i]))
                b.append(own[hits])
                if total > crowd * len(own):
                    crowded[n] = True
                    break
            else:
                firsts += a
                seconds += b
        for n in np.flatnonzero(crowded).tolist():
            own, their = nodes[starts[n] : starts[n] + sizes[n]], prints[starts[n] : starts[n] + sizes[n]]
            for one, linked in spanning(own, their, CLOSE_BITS, shared):
                firsts.append(np.full(len(linked), one))
                seconds.append(linked)
        yield batch(*(np.concatenate([np.zeros(0, np.int64), *x]) for x in (firsts, seconds)), None)
        marked = np.ones(len(keys), bool) if piece else crowded[number]
        yield batch(nodes[marked], None, keys[marked])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, piece in _grouped(batches, longest):
            keys, nodes, prints = rows.column(0).to_numpy(), rows.column(1).to_numpy(), _words(rows, 2)
            sizes, marks = rows.column(6).to_numpy(), np.frombuffer(b"".join(rows.column(7).to_pylist()), np.uint64).reshape(len(keys), -1)
            octets = prints.view(np.uint8)
            for step in range(2, 8 * WIDE, 2):  # each further position of the same parity
                at = np.flatnonzero((keys >> 8) + step < 8 * WIDE)
                if len(at):
                    yield from lists(keys[at] << 16 | step << 8 | octets[at, (keys[at] >> 8) + step], nodes[at], prints[at], sizes[at], marks[at], piece)

    return stream


def _verify(least: float):
    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            hits = [i for i in range(len(a)) if similarities(x[i], [y[i]])[0] >= least]
            yield pa.record_batch([pa.array([a[i] for i in hits], pa.int64()), pa.array([b[i] for i in hits], pa.int64())], ["a", "b"])

    return verified


def _across(bits: int, shared: int, least: float):
    """Rows (part, node, label, lead, f0 to f3, hashes), ordered by part, to true links of leads and members of other labels that connect these."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _ in _grouped(batches):
            keys = rows.column(0).to_numpy()
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            a, b = [], []
            for start, n in zip(starts.tolist(), np.diff(np.r_[starts, len(keys)]).tolist()):
                part = rows.slice(start, n)
                nodes, label, prints, hashes = part.column(1).to_numpy(), part.column(2).to_numpy().copy(), _words(part, 4), part.column(8)
                for i in np.flatnonzero(part.column(3).to_numpy()).tolist():
                    hits = near(prints[i], prints, bits, shared)
                    hits = hits[label[hits] != label[i]]
                    hits = hits[similarities(hashes[i].as_py(), hashes.take(hits).to_pylist()) >= least] if len(hits) else hits
                    for hit in hits.tolist():
                        if label[hit] != label[i]:
                            a.append(nodes[i])
                            b.append(nodes[hit])
                            label[label == label[hit]] = label[i]
            if a:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return stream


def wide_links(prints: DataFrame, least: float = 0.8, bits: int = WIDE_BITS, shared: int = WIDE_SHARED, longest: int = WIDE_LIST, crowd: int = CROWD, size: int = PART) -> DataFrame:
    """True links (a, b) between rows (node, f0 to f3, hashes, marks) that connect all candidates with a similarity of ``least`` or more."""
    places, words = 8 * WIDE, [f"f{j}" for j in range(WIDE)]
    keys = [F.lit(p << 8).cast("long") + _byte(p) for p in range(places - 2)]
    posted = prints.select(F.explode(F.array(*keys)).alias("key"), "node", *words, F.expr("length(hashes) div 4").alias("n"), "marks")
    posted = posted.repartition("key").sortWithinPartitions("key", "node")
    found = durable(posted.mapInArrow(_candidates(bits, shared, longest, crowd, least), "a long, b long, key long"))
    links = found.where("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sets = prints.select(F.col("node"), "hashes")  # both joins read one shuffle of it
    with_a = links.join(sets, F.col("a") == F.col("node")).select("a", "b", F.col("hashes").alias("x"))
    with_b = with_a.join(sets, F.col("b") == F.col("node")).select("a", "b", "x", F.col("hashes").alias("y"))
    true = durable(with_b.mapInArrow(_verify(least), "a long, b long"))
    crowded = found.where("b is null").select(F.col("a").alias("node"), "key")
    if crowded.isEmpty():
        return true
    told = crowded.join(components(true), "node", "left").select("node", "key", F.coalesce("label", "node").alias("label"))
    # lists whose members are not all connected: those outside the largest label meet all others
    labels = told.groupBy("key", "label").agg(F.count("*").alias("n"))
    mixed = labels.groupBy("key").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("label", F.struct("n", "label")).alias("major"), F.count("*").alias("kinds")).where("kinds > 1")
    mixed = mixed.select("key", "major", F.ceil(F.col("n") / size).alias("parts"), F.ceil((F.col("n") - F.col("most")) / size).alias("chunks"))
    rows = told.join(mixed, "key").withColumn("part", F.pmod(F.xxhash64("node"), "parts")).withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(1)), "chunks")).withColumn("lead", F.col("label") != F.col("major"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    met = rows.select("node", "label", "key", "part", upto("chunks").alias("chunk"), F.lit(False).alias("lead"))
    met = met.unionByName(rows.where("lead").select("node", "label", "key", upto("parts").alias("part"), "chunk", "lead"))
    met = met.groupBy(F.xxhash64("key", "part", "chunk").alias("part"), "node", "label").agg(F.max("lead").alias("lead"))
    rows = met.join(prints, "node").select("part", "node", "label", "lead", *words, "hashes").repartition("part").sortWithinPartitions("part")
    return true.unionByName(rows.mapInArrow(_across(bits, shared, least), "a long, b long"))


def similar_documents(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id and ``component_id``, the smallest doc_id it reaches by similar documents."""
    words = [f"f{j}" for j in range(WIDE)]
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), wide_fingerprint("text", width).alias("fp")).select("doc_id", "fp.*")
    # documents with the same shingles are one node
    full = durable(own.withColumn("node", F.xxhash64(*words, "hashes")))
    nodes = durable(full.dropDuplicates(["node"]).select("node", *words, "hashes", "marks"))
    own = durable(full.select("doc_id", "node"))
    discard(full)
    labels = components(wide_links(nodes, least))
    discard(nodes)
    firsts = own.groupBy("node").agg(F.min("doc_id").alias("least"))
    names = firsts.join(labels.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("node", "least", F.coalesce("label", "node").alias("label"))
    groups = names.groupBy("label").agg(F.min("least").alias("component_id"))
    return own.join(names.join(groups, "label").select("node", "component_id"), "node").select("doc_id", "component_id")
