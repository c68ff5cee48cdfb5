"""Language of words and documents by a linear-chain conditional random field.

A word's features are its beginnings and endings, its letter n-grams and itself (the
lexicon), hashed; a sequence has learned transitions between the labels of
neighbours.  The model is fitted on sequences that switch language, made of windows
of labelled documents, by the gradient of the exact log likelihood.  Documents of any
length are labelled by scaled forward-backward; the document's language has the
largest mean marginal over its words.

The sample that fits the model is bounded by ``DOCS_PER_LANG``, ``WINDOWS`` and
``WINDOW``; labelling covers every word of every document.

Defined cases: null text or a text without a letter is ``und`` with score 0; words
without a letter say nothing by themselves; of equal marginals the alphabetically
first language is taken; without labelled documents everything is ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaflow.llm.common import batches_of, claim, portions, remembers, utf8

#: Documents of each language in the sample, windows of each document, words of each window.
DOCS_PER_LANG, WINDOWS, WINDOW = 400, 4, 32
#: Hashed features; passes over the sample, sequences in a step, step size, weight decay.
FEATURES, PASSES, STEP, RATE, DECAY = 1 << 17, 4, 64, 0.2, 1e-6
#: Words whose scores a worker remembers, and words labelled at once.
REMEMBERED, TOGETHER = 600_000, 1 << 19

_AROUND = ".,;:!?\"'()[]{}#*$%&|<>-_"
_letter = regex.compile(r"\p{L}").search


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words: word number and feature, for all words with a letter.

    Features are the n-grams of two to four bytes of the word between marks of its
    ends, which makes the outer ones its affixes, longer affixes, and the word itself.
    """
    own, numbers = [], []
    for i, word in enumerate(words):
        text = word.decode().lower().strip(_AROUND)
        if _letter(text):
            own.append(f"^{text}$".encode())
            numbers.append(i)
    if not own:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes, number = np.array([len(x) for x in own]), np.array(numbers)
    letters = np.frombuffer(b"".join(own), np.uint8).astype(np.uint64)
    begins, word = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(own)), sizes)
    owner, found = [number], [np.array([xxhash.xxh32_intdigest(x) for x in own], np.uint64)]
    for k in (2, 3, 4, 5):
        if len(letters) < k:
            break
        n = len(letters) - k + 1
        at = np.flatnonzero(word[:n] == word[k - 1 :])
        if k == 5:  # only at the ends
            at = at[(at == begins[word[at]]) | (at + k == (begins + sizes)[word[at]])]
        code = np.full(len(at), k, np.uint64)
        for j in range(k):
            code = code << np.uint64(8) | letters[at + j]
        owner.append(number[word[at]])
        found.append(code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24))
    return np.concatenate(owner), (np.concatenate(found) % np.uint64(FEATURES)).astype(np.int64)


@dataclass
class Crf:
    """Labels, feature weights (features x labels) and transition scores."""

    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray

    def emissions(self, words: list[bytes]) -> np.ndarray:
        owner, found = features(words)
        return np.stack([np.bincount(owner, self.weights[found, c], len(words)) for c in range(len(self.labels))], axis=1).astype(np.float32).reshape(len(words), -1)


def forward_backward(scores: np.ndarray, sizes: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Marginals of all words; ``scores`` holds the sequences one after another, ``sizes`` (each at least 1) descending."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    potential = np.exp(scores - scores.max(axis=1, keepdims=True))
    step = np.exp(transitions - transitions.max()).astype(np.float32)
    forward, longest = np.empty_like(potential), int(sizes[0])
    active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(longest), "right")  # sequences longer than t
    now = None
    for t in range(longest):
        at = starts[: active[t]] + t
        now = potential[at] if now is None else (now[: active[t]] @ step) * potential[at]
        now /= now.sum(axis=1, keepdims=True)
        forward[at] = now
    back = np.ones((0, scores.shape[1]), np.float32)
    for t in range(longest - 1, -1, -1):
        at = starts[: active[t]] + t
        if t + 1 < longest and active[t + 1]:
            after = starts[: active[t + 1]] + t + 1
            back = (potential[after] * back) @ step.T
        back = np.concatenate([back, np.ones((active[t] - len(back), scores.shape[1]), np.float32)])
        back /= back.sum(axis=1, keepdims=True)
        forward[at] *= back
    return forward / forward.sum(axis=1, keepdims=True)


def fit(sequences: list[tuple[list[bytes], list[int]]], labels: list[str], seed: int = 7) -> Crf:
    """Weights by stochastic gradients of the log likelihood (adaptive steps) over sequences of equal length."""
    k, rng = len(labels), np.random.default_rng(seed)
    crf = Crf(labels, np.zeros((FEATURES, k), np.float32), np.zeros((k, k), np.float32))
    if not sequences or k == 1:
        return crf
    index: dict[bytes, int] = {}
    words = np.array([[index.setdefault(x, len(index)) for x in own] for own, _ in sequences])
    tags = np.array([own for _, own in sequences])
    owned, hashed = features(list(index))
    order = np.argsort(owned, kind="stable")
    hashed, firsts = hashed[order], np.searchsorted(owned[order], np.arange(len(index) + 1))
    squares, jumps = np.full_like(crf.weights, 1e-6), np.full((k, k), 1e-6, np.float32)
    length, one = words.shape[1], np.eye(k, dtype=np.float32)
    for _ in range(PASSES):
        order = rng.permutation(len(words))
        for start in range(0, len(order), STEP):
            rows = order[start : start + STEP]
            own, tag = words[rows], tags[rows]
            first, sizes = firsts[own.ravel()], np.diff(firsts)[own.ravel()]
            owner = np.repeat(np.arange(own.size), sizes)
            ids = hashed[np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(owner))]
            scores = np.stack([np.bincount(owner, crf.weights[ids, c], own.size) for c in range(k)], axis=1).reshape(*own.shape, k)
            potential, step = np.exp(scores - scores.max(axis=2, keepdims=True)), np.exp(crf.transitions)
            ahead, behind = np.empty_like(potential), np.ones_like(potential)
            for t in range(length):
                ahead[:, t] = potential[:, t] * (ahead[:, t - 1] @ step if t else 1)
                ahead[:, t] /= ahead[:, t].sum(axis=1, keepdims=True)
            for t in range(length - 2, -1, -1):
                behind[:, t] = (potential[:, t + 1] * behind[:, t + 1]) @ step.T
                behind[:, t] /= behind[:, t].sum(axis=1, keepdims=True)
            marginal = ahead * behind
            marginal /= marginal.sum(axis=2, keepdims=True)
            both = ahead[:, :-1, :, None] * step * (potential * behind)[:, 1:, None, :]
            both /= both.sum(axis=(2, 3), keepdims=True)
            slope = (one[tag] - marginal).reshape(-1, k)
            touched, where = np.unique(ids, return_inverse=True)
            down = np.stack([np.bincount(where, slope[owner, c], len(touched)) for c in range(k)], axis=1).astype(np.float32) / len(rows) - DECAY * crf.weights[touched]
            squares[touched] += down**2
            crf.weights[touched] += RATE * down / np.sqrt(squares[touched])
            turn = ((one[tag[:, :-1], :, None] * one[tag[:, 1:], None, :]) - both).sum(axis=(0, 1)).astype(np.float32) / len(rows)
            jumps += turn**2
            crf.transitions += RATE * turn / np.sqrt(jumps)
    return crf


def sample(docs: DataFrame, text: str, lang: str, doc_id: str, per_lang: int = DOCS_PER_LANG) -> list[tuple[str, list[list[str]]]]:
    """(language, windows) of about ``per_lang`` documents of each language, chosen by a hash; windows lie evenly over the whole text."""
    usable = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).withColumn("u", F.pmod(F.xxhash64(doc_id, F.lit("crf")), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    share = usable.groupBy(F.col(lang).alias("__lang")).agg((F.lit(float(per_lang)) / F.count("*")).alias("share"))
    drawn = usable.join(F.broadcast(share) if share.count() <= 10_000 else share, F.col(lang) == F.col("__lang")).where("u < share")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    size = F.size("words")
    begin = lambda i: (F.greatest(size - WINDOW, F.lit(0)) * i / max(WINDOWS - 1, 1)).cast("int") + 1
    windows = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS - 1)), lambda i: F.slice("words", begin(i), F.lit(WINDOW)))
    rows = drawn.withColumn("words", words).where("size(words) > 0").select(lang, F.array_distinct(windows).alias("windows"), "u").orderBy("u", lang)
    return [(x[0], x[1]) for x in rows.collect()]


def switching(rows: list[tuple[str, list[list[str]]]], labels: list[str], seed: int = 7) -> list[tuple[list[bytes], list[int]]]:
    """Sequences of two windows' length: most go on in one language, every fourth switches within."""
    rng, index = np.random.default_rng(seed), {x: i for i, x in enumerate(labels)}
    windows = [([w.encode() for w in words], index[lang]) for lang, own in rows for words in own]
    order, out, words, tags = rng.permutation(len(windows)), [], [], []
    for n, i in enumerate(order):
        own, tag = windows[i]
        part = own if n % 4 else own[: len(own) // 2 + 1]
        words += part
        tags += [tag] * len(part)
        while len(words) >= WINDOW:
            out.append((words[:WINDOW], tags[:WINDOW]))
            words, tags = words[WINDOW:], tags[WINDOW:]
    if words:
        out.append(((words * WINDOW)[:WINDOW], (tags * WINDOW)[:WINDOW]))
    return out


class Labeller:
    """Word scores of one worker and the documents labelled with them."""

    def __init__(self, crf: Crf):
        self.crf, self.index, self.scores = crf, {}, np.zeros((0, len(crf.labels)), np.float32)

    def _ids(self, words: list[list[bytes]]) -> np.ndarray:
        own = set().union(*words)
        new = list(own - self.index.keys())
        if len(self.index) + len(new) > REMEMBERED:  # the present words are the likeliest to come back
            kept = list(own & self.index.keys())
            self.scores = self.scores[[self.index[w] for w in kept]]
            self.index = dict(zip(kept, range(len(kept))))
        if new:
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            self.scores = np.concatenate([self.scores, self.crf.emissions(new)])
        return np.fromiter(map(self.index.__getitem__, chain.from_iterable(words)), np.int64)

    def mean_marginals(self, texts: list[bytes]) -> np.ndarray:
        """Mean marginals over the words with a letter; zeros without any."""
        words = [x.split() for x in texts]
        sizes = np.array([len(x) for x in words], np.int64)
        out = np.zeros((len(texts), len(self.crf.labels)))
        order = np.argsort(-sizes, kind="stable")
        order = order[: int((sizes > 0).sum())]
        for rows in batches_of(sizes[order], TOGETHER):
            own = order[rows]
            scores = self.scores_of([words[i] for i in own])
            marginal = forward_backward(scores, sizes[own], self.crf.transitions)
            telling = scores.any(axis=1)
            starts = np.r_[0, np.cumsum(sizes[own])[:-1]]
            counts = np.add.reduceat(telling.astype(np.int64), starts)
            sums = np.add.reduceat(marginal * telling[:, None], starts, axis=0)
            out[own] = sums / np.maximum(counts, 1)[:, None]
        return out

    def scores_of(self, words: list[list[bytes]]) -> np.ndarray:
        ids = self._ids(words)
        return self.scores[ids]


_labellers: dict[int, Labeller] = {}
remembers("crf", _labellers.clear)


def _labeller(model: Broadcast) -> Labeller:
    claim("crf")
    crf = model.value
    if id(crf) not in _labellers:
        _labellers.clear()
        _labellers[id(crf)] = Labeller(crf)
    return _labellers[id(crf)]


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Crf:
    """The model of the labelled documents ``docs``."""
    rows = sample(docs, text, lang, doc_id)
    labels = sorted({x for x, _ in rows})
    return fit(switching(rows, labels), labels)


def predict(model: Broadcast, text: str | Column) -> Column:
    """Struct ``lang`` and ``score`` of a text."""

    def of(texts: pa.Array) -> pa.Array:
        labeller, data = _labeller(model), utf8(texts)
        labels = labeller.crf.labels
        if not labels:
            return pa.StructArray.from_arrays([pa.array(["und"] * len(data)), pa.array(np.zeros(len(data)))], ["lang", "score"])
        means = np.concatenate([np.zeros((0, len(labels))), *(labeller.mean_marginals(data[rows]) for rows in portions(data, 16 << 20))])
        best = means.argmax(axis=1)
        some = np.array([bool(_letter(x.decode())) for x in data], bool)
        names = [labels[i] if s else "und" for i, s in zip(best, some)]
        scores = np.where(some, np.clip(means[np.arange(len(data)), best], 0, 1), 0.0)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], ["lang", "score"])

    return F.arrow_udf(of, "struct<lang:string,score:double>")(text)
