"""Hidden Markov language model over words.

Latent states emit symbols: each of the ``SYMBOLS`` most frequent training words is
a symbol of its own, all other words share ``CLASSES`` symbols by their endings, and
the end of a text is a symbol.  A word of a class has the share of its count plus one
within the class, where one more stands for any unseen word, so every text has a
probability.  Baum-Welch counts are made by each task over all training tokens, in
segments of ``SEGMENT`` tokens, and added by parts of the symbol table; scoring is the
exact scaled forward recursion over whole texts.

The dictionary that goes to the tasks has ``DICTIONARY`` words at most.  All other
words meet their counts in a join, so counts are exact for every word.

Defined cases: null or empty text is the end token alone; a null doc_id is in the
training part; rows are scored one by one, so repeated rows get equal scores (and
count repeatedly in training); without training text all words are unseen.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaflow.llm.common import batches_of, utf8
from taxaflow.session import discard, durable

STATES, ROUNDS = 8, 5
SYMBOLS, CLASSES, DICTIONARY = 1 << 15, 1 << 10, 1 << 18
#: Tokens in a training segment, segments worked on at once, tokens scored at once.
SEGMENT, TOGETHER, SCORED = 64, 4096, 1 << 19
#: Emission counts that each state takes from the overall distribution.
PRIOR = 50.0
#: Symbols in a part of the table of counts; words a task counts before it sends them.
PART, COUNTED = 1 << 11, 400_000


def word_class(word: bytes) -> int:
    """The class of a word, by its last three bytes."""
    return zlib.crc32(word[-3:]) % CLASSES


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def rows() -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        texts = utf8(batch.column(0))
        for i in range(0, len(texts), 500):
            counts.update(chain.from_iterable(x.lower().split() for x in texts[i : i + 500]))
            if len(counts) > COUNTED:
                yield rows()
                counts.clear()
    if counts:
        yield rows()


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) of all texts; tasks add up before the shuffle."""
    return docs.select(text).mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Counts that all tasks know: of the dictionary, the end token, the classes, and overall."""

    words: dict[bytes, int]
    counts: np.ndarray
    ends: int
    tokens: int
    distinct: int
    class_mass: np.ndarray

    @property
    def base_norm(self) -> float:
        return math.log10(self.tokens + self.distinct + 1)

    @property
    def symbols(self) -> int:
        return min(SYMBOLS, len(self.words))

    @property
    def size(self) -> int:
        return self.symbols + CLASSES + 1


def vocabulary(counts: DataFrame, ends: int, most: int = DICTIONARY) -> Vocabulary:
    """The most frequent words, ``most`` at most: cut between two counts, so that it is the same on every run."""
    level = F.floor(F.log2("n") * 16)
    sizes = sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True)
    total, least = 0, None
    for row in sizes:
        if total + row["count"] > most:
            break
        total, least = total + row["count"], row["level"]
    rows = counts.where(level >= least).collect() if least is not None else []
    rows = sorted(((n, bytes(word)) for word, n in rows), key=lambda x: (-x[0], x[1]))
    ending = F.crc32(F.substring("word", -3, 3)) % CLASSES
    mass = np.ones(CLASSES)
    for c, n in counts.groupBy(ending).agg(F.sum(F.col("n") + 1)).collect():
        mass[int(c)] += n
    tokens, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    for n, word in rows[:SYMBOLS]:
        mass[word_class(word)] -= n + 1
    words = {word: i for i, (_, word) in enumerate(rows)}
    return Vocabulary(words, np.array([n for n, _ in rows], np.int64), ends, (tokens or 0) + ends, distinct + (ends > 0), mass)


class _Ranks(dict):
    """Rank of a word, -1 for words that the dictionary does not hold."""

    def __missing__(self, key):
        return -1


def _encode(shared: Broadcast):
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("logs", pa.float64()), ("tail", pa.float64()), ("symbols", pa.binary()), ("rare", pa.list_(pa.binary()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc: Vocabulary = shared.value
        ranks, n_symbols = _Ranks(voc.words), voc.symbols
        classes = np.array([word_class(w) for w in voc.words], np.int64)
        logs, norms = np.log10(voc.counts + 1.0), np.log10(voc.class_mass)
        symbol = np.where(np.arange(len(classes)) < n_symbols, np.arange(len(classes)), n_symbols + classes)
        tails = np.where(np.arange(len(classes)) < n_symbols, 0.0, logs - norms[classes])
        end, end_log = voc.size - 1, math.log10(voc.ends + 1)
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = utf8(batch.column(2))
            for i in range(0, len(texts), 1000):
                words = [x.lower().split() for x in texts[i : i + 1000]]
                sizes = np.array([len(x) for x in words], np.int64)
                flat = list(chain.from_iterable(words))
                rank = np.fromiter(map(ranks.__getitem__, flat), np.int64, len(flat))
                text = np.repeat(np.arange(len(words)), sizes)
                out = rank < 0
                where = np.flatnonzero(out)
                rare = [flat[j] for j in where.tolist()]
                rare_class = np.array([word_class(w) for w in rare], np.int64)
                known = np.where(out, 0, rank)
                coded = symbol[known] if len(symbol) else np.zeros(len(flat), np.int64)
                coded[where] = n_symbols + rare_class
                log = np.where(out, 0.0, logs[known]) if len(logs) else np.zeros(len(flat))
                tail = np.where(out, 0.0, tails[known]) if len(tails) else np.zeros(len(flat))
                tail[where] = -norms[rare_class]
                coded = coded.astype("<u2")
                stops = np.cumsum(sizes)
                last = np.array([end], "<u2").tobytes()
                rare_sizes = np.bincount(text[where], minlength=len(words))
                columns = [
                    key + np.arange(len(words)),
                    batch.column(0).slice(i, len(words)),
                    batch.column(1).slice(i, len(words)),
                    sizes + 1,
                    np.bincount(text[~out], minlength=len(words)) + (voc.ends > 0),
                    np.bincount(text, log, len(words)) + end_log,
                    np.bincount(text, tail, len(words)),
                    pa.array([coded[b - n : b].tobytes() + last for b, n in zip(stops, sizes)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(rare_sizes)].astype(np.int32)), pa.array(rare, pa.binary())),
                ]
                key += len(words)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], schema=schema)

    return encode


@dataclass
class Hmm:
    """Initial, transition and emission (symbols x states) probabilities; ``inner`` starts a segment within a text."""

    start: np.ndarray
    inner: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def first_guess(overall: np.ndarray, states: int = STATES, seed: int = 11) -> Hmm:
    """States that like random words, and stay."""
    emit = overall[:, None] * np.exp(1.5 * np.random.default_rng(seed).standard_normal((len(overall), states)))
    even = np.full(states, 1 / states)
    return Hmm(even, even, 0.6 * np.eye(states) + 0.4 / states, emit / emit.sum(axis=0))


def expected_counts(model: Hmm, texts: list[np.ndarray], counts: dict[str, np.ndarray]) -> None:
    """Add the Baum-Welch counts of the texts' segments."""
    k, pad = len(model.start), len(model.emit)
    emit = np.concatenate([model.emit, np.ones((1, k))]).astype(np.float32)
    move = model.move.astype(np.float32)
    sizes = np.array([len(x) for x in texts], np.int64)
    segments = (sizes + SEGMENT - 1) // SEGMENT
    padded = np.full(int(segments.sum()) * SEGMENT, pad, np.int64)
    begins = np.r_[0, np.cumsum(segments)[:-1]]
    flat = np.concatenate(texts)
    padded[np.repeat(begins * SEGMENT - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))] = flat
    padded = padded.reshape(-1, SEGMENT)
    opening = np.zeros(len(padded), bool)
    opening[begins] = True
    for i in range(0, len(padded), TOGETHER):
        own, opens = padded[i : i + TOGETHER], opening[i : i + TOGETHER]
        real = own < pad
        e = np.ascontiguousarray(emit[own].transpose(1, 0, 2))
        ahead, scale = np.empty_like(e), np.empty((SEGMENT, len(own), 1), np.float32)
        now = np.where(opens[:, None], model.start, model.inner).astype(np.float32)
        for t in range(SEGMENT):
            now = (now @ move if t else now) * e[t]
            scale[t] = now.sum(axis=1, keepdims=True)
            now = now / scale[t]
            ahead[t] = now
        behind = np.ones((len(own), k), np.float32)
        for t in range(SEGMENT - 1, -1, -1):
            state = ahead[t] * behind
            if t:
                weighed = e[t] * behind / scale[t]
                counts["move"] += (ahead[t - 1] * real[:, t, None]).T @ weighed * move
                behind = weighed @ move.T
            ahead[t] = state
        counts["start"] += ahead[0][opens].sum(axis=0)
        counts["inner"] += ahead[0][~opens].sum(axis=0)
        symbols = own.T.ravel()
        for s in range(k):
            counts["emit"][:, s] += np.bincount(symbols, ahead[:, :, s].ravel(), pad + 1)[:pad]


def _expect(shared: Broadcast):
    """Segments' counts by part of the symbol table; part -1 holds start, inner and transitions."""

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Hmm = shared.value
        n, k = model.emit.shape
        counts = {"start": np.zeros(k), "inner": np.zeros(k), "move": np.zeros((k, k)), "emit": np.zeros((n, k))}
        some = False
        for batch in batches:
            texts = [np.frombuffer(x, "<u2").astype(np.int64) for x in batch.column(0).to_pylist()]
            for rows in batches_of(np.array([len(x) for x in texts]), 1 << 19):
                expected_counts(model, texts[rows], counts)
                some = True
        if some:
            parts = [(-1, np.concatenate([counts["start"], counts["inner"], counts["move"].ravel()]))]
            parts += [(i // PART, counts["emit"][i : i + PART].ravel()) for i in range(0, n, PART)]
            yield pa.record_batch([pa.array([p for p, _ in parts], pa.int32()), pa.array([x.astype(np.float32).tobytes() if p >= 0 else x.astype(np.float64).tobytes() for p, x in parts], pa.binary())], ["part", "counts"])

    return expect


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by part to one sum each."""

    def row(part: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "counts"])

    now, total = None, None
    for batch in batches:
        for part, data in zip(*(c.to_pylist() for c in batch.columns)):
            own = np.frombuffer(data, np.float64 if part < 0 else np.float32).astype(np.float64)
            if part == now:
                total += own
            else:
                if now is not None:
                    yield row(now, total)
                now, total = part, own
    if now is not None:
        yield row(now, total)


def train(symbols: DataFrame, overall: np.ndarray, rounds: int = ROUNDS, states: int = STATES) -> Hmm:
    """Baum-Welch over all rows of ``symbols`` (little-endian 16-bit symbols of a text); ``overall``: probability of each symbol."""
    context, model = symbols.sparkSession.sparkContext, first_guess(overall, states)
    for _ in range(rounds):
        shared = context.broadcast(model)
        parts = symbols.mapInArrow(_expect(shared), "part int, counts binary")
        rows = parts.repartition("part").sortWithinPartitions("part").mapInArrow(_add, "part int, counts binary").collect()
        shared.destroy()
        if not rows:
            break
        emit = np.zeros_like(model.emit)
        for part, data in rows:
            own = np.frombuffer(data, np.float64)
            if part < 0:
                start, inner, move = own[:states], own[states : 2 * states], own[2 * states :].reshape(states, states)
            else:
                emit[part * PART : (part + 1) * PART] = own.reshape(-1, states)
        emit += PRIOR * overall[:, None]
        share = lambda x: (x + 0.1) / (x + 0.1).sum(axis=-1, keepdims=True)
        model = Hmm(share(start), share(inner), share(move), emit / emit.sum(axis=0))
    return model


def log_likelihood(model: Hmm, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each text by the scaled forward recursion."""
    sizes = np.array([len(x) for x in texts], np.int64)
    order, out = np.argsort(-sizes, kind="stable"), np.zeros(len(texts))
    for rows in batches_of(sizes[order], SCORED):
        own = order[rows]
        n = sizes[own]
        flat = np.concatenate([texts[i] for i in own])
        starts = np.cumsum(n) - n
        active = len(n) - np.searchsorted(n[::-1], np.arange(n[0]), "right")
        now, logs = None, np.zeros(len(n))
        for t in range(int(n[0])):
            a = active[t]
            emitted = model.emit[flat[starts[:a] + t]]
            now = emitted * (model.start if now is None else now[:a] @ model.move)
            scale = now.sum(axis=1)
            now /= scale[:, None]
            logs[:a] += np.log(scale)
        out[own] = logs
    return out


def _score(shared: Broadcast):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [np.frombuffer(x, "<u2") for x in batch.column("symbols").to_pylist()]
            own = log_likelihood(shared.value, texts) / math.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(own)], names=[*batch.schema.names[:-1], "hmm"])

    return score


def score_documents(docs: DataFrame, rounds: int = ROUNDS, states: int = STATES, dictionary: int = DICTIONARY) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, held_out): token counts, unigram base score and model score, all in log10."""
    context = docs.sparkSession.sparkContext
    own = docs.select(F.col("doc_id").cast("long"), "held_out", "text")
    counts = durable(word_counts(own.where("not held_out")))
    voc = vocabulary(counts, own.where("not held_out").count(), dictionary)
    shared = context.broadcast(voc)
    encoded = durable(own.mapInArrow(_encode(shared), "key long, doc_id long, held_out boolean, n_tokens long, known long, logs double, tail double, symbols binary, rare array<binary>"))
    overall = np.r_[voc.counts[: voc.symbols] + 1.0, voc.class_mass, voc.ends + 1.0]
    model = train(encoded.where("not held_out").select("symbols"), overall / overall.sum(), rounds, states)
    scored = encoded.drop("rare").mapInArrow(_score(context.broadcast(model)), "key long, doc_id long, held_out boolean, n_tokens long, known long, logs double, tail double, hmm double")
    rare = encoded.select("key", F.explode("rare").alias("word")).groupBy("key", "word").agg(F.count("*").alias("times"))
    met = rare.join(counts, "word", "left").groupBy(F.col("key").alias("__key")).agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("rare_logs"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known")
    )
    rare_logs, rare_known = F.coalesce("rare_logs", F.lit(0.0)), F.coalesce("rare_known", F.lit(0))
    return scored.join(met, F.col("key") == F.col("__key"), "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + rare_known).alias("n_known"),
        F.lit(voc.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + rare_logs - F.col("n_tokens") * F.lit(voc.base_norm)).alias("base_score"),
        (F.col("hmm") + F.col("tail") + rare_logs).alias("score"),
    )
