"""Finding benchmark passages in documents by latent semantic retrieval.

1. Texts become word codes once, stored with the distinct buckets of their blocks of
   words.  TF-IDF weights over hashed words: frequencies of all blocks of all documents.
2. A randomised singular value decomposition of the TF-IDF matrix of all these blocks:
   products with the matrix and its transpose are made by the tasks and added by parts;
   only a tall thin matrix of fixed size meets on the driver.  The latent space is
   whitened.
3. Every document is cut into overlapping windows of several lengths; an item is
   compared, by cosine in the latent space, with the windows of the length next to
   its own.
4. Candidates are verified on the words: longest common subsequence with the item,
   and its answer, the last words of the item.  Windows with too few words that may be
   the item's, a bound of any common subsequence, are left out before.

An item is found where its longest common subsequence has ``SURE`` of its words, or
``LIKELY`` of them and the whole answer in order (a paraphrase that keeps the
answer).  Words are compared in lower case without ASCII punctuation around them.

Defined cases: null or empty texts and items have no words and match nothing; rows
with equal doc_id or item_id are looked at one by one and give one row each pair of
ids, with the best match; an empty benchmark finds nothing.  Benchmarks of more than
``ITEMS`` items are searched in blocks of about that many.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaflow.llm.common import BLANKS, batches_of, claim, portions, utf8
from taxaflow.session import durable

#: Hashed words, latent dimensions, and leading ones left out, which tell languages apart but not passages.
BUCKETS, RANK, SHARED = 1 << 15, 96, 8
#: Spare dimensions and rounds of the decomposition; the last round gives the values as well.
SPARE, ROUNDS = 8, 2
#: Words in a block; a bucket is common if more than one of ``DENSE`` blocks holds it; rows summed at once; blocks of a product.
BLOCK, DENSE, SIDE, BLOCKS = 48, 32, 512, 1 << 14
#: Lengths of windows; they start every quarter of their length.
LENGTHS = (12, 18, 27, 40, 60, 90, 135, 200)
#: Least cosine of a candidate: low enough for nearly all that ``LIKELY`` accepts.
COSINE = 0.33
SURE, LIKELY, ANSWER = 0.8, 0.6, 5
#: Words projected at once, words of a piece of a long text, items in a block.
TOGETHER, PIECE, ITEMS = 1 << 14, 1 << 14, 4096
#: Words of a stretch of running sums.
RUN = 32
#: Slots that an item's words are marked in, and windows whose words are looked up there at once.
SLOTS, FEW = 1 << 12, 1 << 13
#: Buckets in a part of a matrix that tasks add to.
PART = 1 << 12
#: Bytes hashed at once.
TEXT = 1 << 16
_AROUND = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_BLANK = ord(" ")
#: Lower case, one kind of blank; bytes that are neither blank nor punctuation.
_LOWERED = bytes(_BLANK if i in BLANKS else i for i in range(256)).lower()
_KEPT = np.array([i != _BLANK and i not in _AROUND for i in range(256)])
#: Factors of xxHash, by their numbers.
_PRIMES = dict(enumerate(map(np.uint32, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)), 1))


def _code(word: bytes) -> int:
    """32-bit code of a word, 0 for punctuation alone."""
    word = word.lower().strip(_AROUND)
    return (xxhash.xxh32_intdigest(word) or 1) if word else 0


def _turned(h: np.ndarray, bits: int) -> np.ndarray:
    return h << np.uint32(bits) | h >> np.uint32(32 - bits)


def _hashes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the words of a lowered text that ends with a blank, and their codes as in ``_code``.

    Words of less than 16 bytes, nearly all, are hashed at once: four bytes of each word a step, then those left over.
    """
    edges = np.flatnonzero(np.diff(text != _BLANK, prepend=False))
    starts, ends = edges[::2], edges[1::2]
    kept = _KEPT[text]
    lo, hi = starts.copy(), ends.copy()
    bare = np.flatnonzero(~(kept[starts] & kept[ends - 1]))
    if len(bare):
        places = np.flatnonzero(kept)
        first, last = np.searchsorted(places, starts[bare]), np.searchsorted(places, ends[bare])
        lo[bare] = hi[bare] = 0
        real = first < last
        lo[bare[real]], hi[bare[real]] = places[first[real]], places[last[real] - 1] + 1
    size = hi - lo
    one = np.r_[text, np.zeros(3, np.uint8)].astype(np.uint32)
    four = one[:-3] | one[1:-2] << np.uint32(8) | one[2:-1] << np.uint32(16) | one[3:] << np.uint32(24)
    h = size.astype(np.uint32) + _PRIMES[5]
    for values, begin, steps, step, factors, bits in ((four, lo, size // 4, 4, (3, 4), 17), (one, lo + size // 4 * 4, size % 4, 1, (5, 1), 11)):
        for i in range(3):
            rows = np.flatnonzero(steps > i)
            h[rows] = _turned(h[rows] + values[begin[rows] + i * step] * _PRIMES[factors[0]], bits) * _PRIMES[factors[1]]
    for bits, factor in ((15, 2), (13, 3)):
        h = (h ^ h >> np.uint32(bits)) * _PRIMES[factor]
    h = np.where(size > 0, np.maximum(h ^ h >> np.uint32(16), 1), 0).astype(np.uint32)
    for i in np.flatnonzero(size >= 16).tolist():
        h[i] = _code(text[lo[i] : hi[i]].tobytes())
    return ends, h


def coded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words of all texts, and the number of words of each."""
    parts = [_coded(texts[rows]) for rows in portions(texts)]
    return np.concatenate([np.zeros(0, np.uint32), *(x for x, _ in parts)]), np.concatenate([np.zeros(0, np.int64), *(n for _, n in parts)])


def _coded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    claim("decontaminate")
    whole = b" ".join([*texts, b""]).translate(_LOWERED)
    data, at, ends, codes = np.frombuffer(whole, np.uint8), 0, [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    while at < len(whole):  # cut at blanks: long texts take no more memory than many short ones
        stop = whole.find(b" ", at + TEXT - 1) + 1 if len(whole) - at > TEXT else len(whole)
        own, found = _hashes(data[at:stop])
        some = found > 0
        ends.append(own[some] + at)
        codes.append(found[some])
        at = stop
    until = np.cumsum(np.array([len(x) + 1 for x in texts], np.int64))
    return np.concatenate(codes), np.diff(np.searchsorted(np.concatenate(ends), until), prepend=0)


def _blocks(sizes: np.ndarray) -> np.ndarray:
    """The number of the block of each word; blocks lie within a text."""
    ends = np.cumsum(sizes)
    within = np.arange(int(sizes.sum())) - np.repeat(ends - sizes, sizes)
    starts = np.r_[0, np.cumsum((sizes + BLOCK - 1) // BLOCK)][:-1]
    return np.repeat(starts, sizes) + within // BLOCK


def block_buckets(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct buckets of each block, in order; their number for each block; buckets and blocks of each text.

    A word counts once in a block: repetitions don't make directions of their own.
    """
    blocks = (sizes + BLOCK - 1) // BLOCK
    kind = np.uint32 if blocks.sum() < (1 << 32) // BUCKETS else np.uint64
    own = _blocks(sizes).astype(kind) * kind(BUCKETS) + (codes % BUCKETS).astype(kind)
    own.sort()
    own = own[np.r_[True, own[1:] != own[:-1]][: len(own)]]
    counts = np.bincount((own // BUCKETS).astype(np.int64), minlength=int(blocks.sum()))
    ends = np.r_[0, np.cumsum(counts)][np.r_[0, np.cumsum(blocks)]]
    return (own % BUCKETS).astype("<u2"), counts.astype(np.uint8), np.diff(ends), blocks


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) to (doc_id, codes of the words, buckets, counts), as in ``block_buckets``."""
    cut = lambda values, sizes: pa.BinaryArray.from_buffers(
        pa.binary(), len(sizes), [None, pa.py_buffer((values.itemsize * np.cumsum(np.r_[0, sizes])).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))]
    )
    for batch in batches:
        texts = utf8(batch.column(1))
        for rows in portions(texts):
            codes, sizes = coded(texts[rows])
            buckets, counts, n_buckets, n_blocks = block_buckets(codes, sizes)
            yield pa.record_batch(
                [batch.column(0)[rows.start : rows.stop], cut(codes.astype("<u4"), sizes), cut(buckets, n_buckets), cut(counts, n_blocks)],
                ["doc_id", "codes", "buckets", "counts"],
            )


def _joined(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks that hold each bucket; the last value is the number of blocks."""
    found = np.zeros(BUCKETS + 1, np.int64)
    for batch in batches:
        found[:-1] += np.bincount(_joined(batch.column(0), "<u2"), minlength=BUCKETS)
        found[-1] += len(_joined(batch.column(1), np.uint8))
    if found[-1]:
        yield from _parts(found.astype(np.float64))


def _parts(values: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(values), PART):
        yield pa.record_batch([pa.array([i // PART], pa.int32()), pa.array([values[i : i + PART].tobytes()], pa.binary())], ["part", "data"])


def _added(kind: str):
    """Rows ordered by part to one sum each."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        out = lambda: pa.record_batch([pa.array([now], pa.int32()), pa.array([total.astype(kind).tobytes()], pa.binary())], ["part", "data"])
        for batch in batches:
            for part, data in zip(*(c.to_pylist() for c in batch.columns)):
                if part != now:
                    if now is not None:
                        yield out()
                    now, total = part, 0.0
                total = total + np.frombuffer(data, kind).astype(np.float64)
        if now is not None:
            yield out()

    return stream


def _summed(rows: DataFrame, make, size: int, width: int, kind: str) -> np.ndarray:
    """The sum of what tasks made, a matrix of fixed size; there is one task for each core, and parts are added by different tasks."""
    partial = rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism).mapInArrow(make, "part int, data binary")
    out = np.zeros((size, width), kind)
    for part, data in partial.repartition("part").sortWithinPartitions("part").mapInArrow(_added(kind), "part int, data binary").toLocalIterator():
        out[part * PART : (part + 1) * PART] = np.frombuffer(data, kind).reshape(-1, width)
    return out


def _sum_rows(x: np.ndarray, entries: np.ndarray, first: np.ndarray, sizes: np.ndarray, out: np.ndarray, taken: np.ndarray) -> None:
    """Sums of rows of ``x``, one for each list of entries; longer lists come first.  All lists take a step at once."""
    out[...] = 0
    for step, n in enumerate(np.cumsum(np.bincount(sizes)[::-1])[::-1][1:].tolist()):
        rows = np.take(x, entries[first[:n] + step], axis=0, out=taken[:n], mode="clip")
        np.add(out[:n], rows, out=out[:n])


def _by_size(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of consecutive lists, longest first, with their first entries and sizes."""
    order = np.argsort(-sizes, kind="stable")
    return order, (np.cumsum(sizes) - sizes)[order], sizes[order]


def add_gram(out: np.ndarray, buckets: np.ndarray, counts: np.ndarray, idf: np.ndarray, x: np.ndarray) -> None:
    """Adds the product of the transposed TF-IDF matrix of blocks (of length one), the matrix, and ``x``."""
    total = np.zeros(x.shape, out.dtype)
    _add_gram(total, buckets, counts, idf, idf[:, None] * x)
    out += idf[:, None] * total


def _add_gram(out: np.ndarray, buckets: np.ndarray, counts: np.ndarray, idf: np.ndarray, scaled: np.ndarray) -> None:
    """As ``add_gram``, but ``scaled`` is already multiplied by the weights, and what is added is not yet.

    So the matrix holds ones, divided by the lengths of its rows.  Buckets that many blocks hold are multiplied as a
    dense matrix; the others are summed by block, and the blocks by bucket.
    """
    if not len(buckets):
        return
    buckets, number = buckets.astype(np.intp), np.repeat(np.arange(len(counts)), counts)
    squares = np.maximum(np.bincount(number, (idf * idf)[buckets], len(counts)), 1e-12)
    holders = np.bincount(buckets, minlength=len(idf))
    common = np.flatnonzero(holders * DENSE > len(counts))
    column = np.full(len(idf), -1)
    column[common] = np.arange(len(common))
    column = column[buckets]
    rare = column < 0
    few, column = buckets[rare], column[~rare]
    # blocks are numbered anew, those with most rare buckets first
    order, first, sizes = _by_size(np.bincount(number[rare], minlength=len(counts)))
    squares, renamed = squares[order, None].astype(np.float32), np.empty_like(order)
    renamed[order] = np.arange(len(order))
    number = renamed[number]
    dense, number = number[~rare], number[rare]
    turn = np.argsort(dense, kind="stable")
    dense, column = dense[turn], column[turn]
    ends = np.searchsorted(dense, np.arange(0, len(counts) + SIDE, SIDE))
    places, taken = np.empty((len(counts), scaled.shape[1]), scaled.dtype), np.empty((SIDE, scaled.shape[1]), scaled.dtype)
    top = scaled[common]
    sums = np.zeros_like(top)
    for k, i in enumerate(range(0, len(counts), SIDE)):
        rows, place, words = slice(i, i + SIDE), places[i : i + SIDE], slice(ends[k], ends[k + 1])
        _sum_rows(scaled, few, first[rows], sizes[rows], place, taken)
        block = np.zeros((len(place), len(common)), np.float32)
        block[dense[words] - i, column[words]] = 1
        place += block @ top
        place /= squares[rows]
        sums += block.T @ place
    out[common] += sums
    number = number[np.argsort(few.astype(np.uint16), kind="stable")]
    holders[common] = 0
    order, first, sizes = _by_size(holders)
    total = np.empty_like(taken)
    for i in range(0, int(np.count_nonzero(sizes)), SIDE):
        rows = order[i : i + SIDE][sizes[i : i + SIDE] > 0]
        n = slice(i, i + len(rows))
        _sum_rows(places, number, first[n], sizes[n], total[: len(rows)], taken)
        out[rows] += total[: len(rows)]


def _gram(shared: Broadcast):
    """Rows (buckets, counts) to the parts of the product of ``add_gram`` with ``shared`` (idf, x)."""

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, x = shared.value
        out, scaled, some = np.zeros(x.shape), idf[:, None] * x, False
        for batch in batches:
            counts = _joined(batch.column(1), np.uint8)
            buckets, ends = _joined(batch.column(0), "<u2"), np.r_[0, np.cumsum(counts, dtype=np.int64)]
            for i in range(0, len(counts), BLOCKS):
                n = counts[i : i + BLOCKS]
                _add_gram(out, buckets[ends[i] : ends[i + len(n)]], n, idf, scaled)
                some = True
        if some:
            yield from _parts((idf[:, None] * out).astype("<f4"))

    return product


def encoded(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text) as (doc_id, codes, buckets, counts), stored."""
    return durable(docs.select("doc_id", "text").mapInArrow(_encoded, "doc_id long, codes binary, buckets binary, counts binary"))


def latent_space(rows: DataFrame, seed: int = 5) -> np.ndarray:
    """Weights (buckets x RANK) whose sum over words is a block's place in the whitened latent space of all blocks of ``encoded`` rows."""
    context = rows.sparkSession.sparkContext
    rows = rows.select("buckets", "counts")
    found = _summed(rows, _frequencies, BUCKETS + 1, 1, "<f8")[:, 0]
    idf = np.log((1 + found[-1]) / (1 + found[:-1])).astype(np.float32)
    x = np.random.default_rng(seed).standard_normal((BUCKETS, SHARED + RANK + SPARE)).astype(np.float32)
    for _ in range(ROUNDS):
        shared = context.broadcast((idf, x))
        x, r = np.linalg.qr(_summed(rows, _gram(shared), BUCKETS, x.shape[1], "<f4"))
        shared.destroy()
    # the last product is of an orthonormal basis: its singular values are those of the whole matrix there, squared
    vectors, values, _ = np.linalg.svd(r.astype(np.float64))
    top = max(values[0], 1e-12)
    keep = np.arange(len(values))[SHARED : SHARED + RANK]
    keep = keep[values[keep] > 1e-6 * top]
    if len(keep) < RANK // 2:  # too few documents for latent directions: random ones keep distances as well
        return (idf[:, None] * np.random.default_rng(seed).standard_normal((BUCKETS, RANK))).astype(np.float32)
    return (idf[:, None] * (x @ (vectors[:, keep] * np.sqrt(top / values[keep])).astype(np.float32))).astype(np.float32)


@dataclass
class Items:
    """Items of a block of the benchmark: ids, codes, unit vectors by window length, the space (buckets x dimensions), marks of the words (items x slots), and places of the words, in items and answers."""

    ids: list[int]
    codes: list[list[int]]
    vectors: dict[int, tuple[np.ndarray, np.ndarray]]
    space: np.ndarray
    marks: np.ndarray
    places: list[dict[int, int]]
    answers: list[dict[int, int]]


def length_for(words: int) -> int:
    return next((n for n in LENGTHS if n >= words), words)


def items_of(rows: list[tuple[int, str | None]], space: np.ndarray) -> Items:
    own = [(i, coded([(t or "").encode()])[0]) for i, t in rows]
    own = [(i, c) for i, c in own if len(c)]
    by_length: dict[int, list[int]] = {}
    for n, (_, codes) in enumerate(own):
        by_length.setdefault(length_for(len(codes)), []).append(n)
    vectors = {}
    for length, numbers in by_length.items():
        places = np.stack([space[own[n][1] % BUCKETS].sum(axis=0) for n in numbers])
        norm = np.linalg.norm(places, axis=1, keepdims=True)
        vectors[length] = np.array(numbers), (places / np.where(norm > 0, norm, 1)).astype(np.float32)
    marks = np.zeros((len(own), SLOTS), bool)
    for n, (_, codes) in enumerate(own):
        marks[n, codes % SLOTS] = True
    return Items([i for i, _ in own], [c.tolist() for _, c in own], vectors, space, marks, [places_of(c.tolist()) for _, c in own], [places_of(c[-ANSWER:].tolist()) for _, c in own])


def places_of(words: list[int]) -> dict[int, int]:
    """The places of each word, as bits."""
    places: dict[int, int] = {}
    for i, code in enumerate(words):
        places[code] = places.get(code, 0) | 1 << i
    return places


def _common(places: dict[int, int], n: int, window: list[int]) -> int:
    """Length of the longest common subsequence with the ``n`` words of ``places`` (bit-parallel)."""
    v = full = (1 << n) - 1
    for m in map(places.get, window):
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def common_subsequence(item: list[int], window: list[int]) -> tuple[int, int]:
    """Length of the longest common subsequence, of the whole item and of its answer."""
    return tuple(_common(places_of(part), len(part), window) for part in (item, item[-ANSWER:]))


def _windows(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the windows of consecutive pieces; the last one of a piece ends with it."""
    step = max(1, length // 4)
    last = np.maximum(sizes - length, 0)
    counts = np.where(sizes > 0, (last + step - 1) // step + 1, 0)
    piece = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = (np.cumsum(sizes) - sizes)[piece]
    starts = begin + np.minimum(number * step, last[piece])
    return starts, np.minimum(starts + length, begin + sizes[piece])


def running_sums(buckets: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, Callable[[np.ndarray], np.ndarray]]:
    """Sums of the places of the first 0, 1, ... words, and the rows they are in.

    Stretches of ``RUN`` words are summed side by side, each step a whole matrix; then what was before each is added.
    """
    many = len(buckets) // RUN + 1
    own = np.zeros(many * RUN, np.int64)
    own[1 : len(buckets) + 1] = buckets
    sums = np.empty((RUN, many, space.shape[1]), np.float32)
    for i, now in enumerate(np.ascontiguousarray(own.reshape(many, RUN).T)):
        np.take(space, now, axis=0, out=sums[i], mode="clip")
        if i:
            sums[i] += sums[i - 1]
        else:
            sums[0, 0] = 0
    before = (np.cumsum(sums[-1], axis=0, dtype=np.float64) - sums[-1]).astype(np.float32)
    for row in sums:
        row += before
    return sums.reshape(many * RUN, -1), lambda n: n % RUN * many + n // RUN


def near_windows(codes: np.ndarray, sizes: np.ndarray, items: Items, cosine: float = COSINE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Item numbers, window starts and ends of windows of the pieces near an item, for each length.

    A window is the difference of two running sums.
    """
    sums, at = running_sums(codes % BUCKETS, items.space)
    for length, (numbers, vectors) in items.vectors.items():
        starts, ends = _windows(sizes, length)
        place = sums.take(at(ends), axis=0)
        place -= sums.take(at(starts), axis=0)
        bound = cosine * np.sqrt(np.einsum("ij,ij->i", place, place))
        rows, columns = np.divmod(np.flatnonzero(place @ vectors.T >= np.maximum(bound, 1e-6)[:, None]), len(numbers))
        yield numbers[columns], starts[rows], ends[rows]


def candidates(codes: np.ndarray, sizes: np.ndarray, items: Items, cosine: float = COSINE) -> Iterator[tuple[int, int, int]]:
    """(item number, window start, window end) of windows of the pieces near an item."""
    for found in near_windows(codes, sizes, items, cosine):
        yield from zip(*(x.tolist() for x in found))


def wide_enough(codes: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, items: Items) -> np.ndarray:
    """Which stretches (lo to hi) have as many words that may be of their item as the least common subsequence that counts."""
    slots, reach = (codes % SLOTS).astype(np.int64), np.arange(int((hi - lo).max(initial=0)))
    marks, first = items.marks.ravel(), item * SLOTS
    least = LIKELY * np.array([len(x) for x in items.codes])[item]
    out = np.zeros(len(item), bool)
    for i in range(0, len(item), FEW):
        rows = slice(i, i + FEW)
        at = lo[rows, None] + reach
        there = marks.take(slots.take(at, mode="clip") + first[rows, None]) & (at < hi[rows, None])
        out[rows] = there.sum(axis=1, dtype=np.int32) >= least[rows]
    return out


def _find(shared: Broadcast):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("common", pa.int64()), ("n_item_words", pa.int64()), ("answer", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        reach = max(items.vectors, default=0)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data = batch.column(1).to_pylist()
            codes, sizes = np.frombuffer(b"".join(data), "<u4"), np.array([len(x) // 4 for x in data], np.int64)
            best: dict[tuple, tuple] = {}
            for owner, start, n in _pieces(sizes, reach):
                own = codes[start : start + int(n.sum())]
                ends = np.cumsum(n)
                for item, a, b in near_windows(own, n, items):
                    piece, margin = np.searchsorted(ends, a, "right"), (b - a) // 4
                    lo, hi = np.maximum((ends - n)[piece], a - margin), np.minimum(ends[piece], b + margin)
                    rows = np.flatnonzero(wide_enough(own, item, lo, hi, items))
                    for number, i, j, k in zip(*(x[rows].tolist() for x in (item, lo, hi, piece))):
                        words, window = len(items.codes[number]), own[i:j].tolist()
                        common = _common(items.places[number], words, window)
                        if common < LIKELY * words:
                            continue
                        answer = _common(items.answers[number], min(ANSWER, words), window)
                        if common >= SURE * words or answer == min(ANSWER, words):
                            key = ids[owner[k]], items.ids[number]
                            best[key] = max(best.get(key, (0,)), (common, words, answer))
            if best:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*key, *value))) for key, value in best.items()], schema=schema)

    return find


def _pieces(sizes: np.ndarray, reach: int) -> Iterator[tuple[list[int], int, np.ndarray]]:
    """Consecutive texts to be projected together: their numbers, the first word, the sizes.  A very long text comes in overlapping pieces."""
    begins = np.cumsum(sizes) - sizes
    for rows in batches_of(sizes, TOGETHER):
        numbers = list(range(rows.start, rows.stop))
        if len(numbers) == 1 and sizes[numbers[0]] > PIECE + 2 * reach:
            first, n = int(begins[numbers[0]]), int(sizes[numbers[0]])
            for at in range(0, n, PIECE):
                yield numbers, first + at, np.array([min(PIECE + 2 * reach, n - at)])
        elif sizes[rows].sum():
            yield numbers, int(begins[rows.start]), sizes[rows]


def leaks(docs: DataFrame, benchmark: DataFrame, space: np.ndarray | None = None, block: int = ITEMS) -> DataFrame:
    """(doc_id, item_id, common, n_item_words, answer) for each benchmark item found in a document.

    ``common`` and ``answer`` are the words in common subsequences with the item and its answer.
    """
    context = docs.sparkSession.sparkContext
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = encoded(own)
    space = latent_space(rows) if space is None else space
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    blocks = max(1, -(-items.count() // block))
    found = None
    for n in range(blocks):
        wanted = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == n).collect()
        part = rows.select("doc_id", "codes").mapInArrow(_find(context.broadcast(items_of(wanted, space))), "doc_id long, item_id long, common long, n_item_words long, answer long")
        found = part if found is None else found.unionByName(part)
    best = F.max(F.struct("common", "n_item_words", "answer"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")
