import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from taxaflow.llm import queries
from taxaflow.llm import spelling_variants as sv

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def edits(word, alphabet):
    for i in range(len(word) + 1):
        for c in alphabet:
            yield word[:i] + c + word[i:]
            if i < len(word):
                yield word[:i] + c + word[i + 1 :]
        if i < len(word):
            yield word[:i] + word[i + 1 :]


def brute(rows):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    alphabet = sorted(set("".join(words)))
    near = {w: {x for x in edits(w, alphabet) if x in words and x != w} for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted([(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()], key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def typed():
    """Words over few letters with many variants, frequent stems, upper case, accents, blanks of all kinds, and nulls."""
    rng = random.Random(6)
    stems = ["".join(rng.choice("abcé") for _ in range(rng.choice([6, 6, 7, 8, 9, 11, 14]))) for _ in range(40)] + ["z" * 7, "q" * 40]
    out = []
    for i in range(500):
        words = []
        for _ in range(80):
            w = rng.choice(stems[: rng.choice([3, 10, 42])])
            if rng.random() < 0.35:
                w = rng.choice(list(edits(w, "ab")))
            words.append(w.upper() if rng.random() < 0.1 else w)
        out.append((i, rng.choice([" ", "\n", "3", "_"]).join(words)))
    return [*out, (None, None), (501, ""), (None, "zzzzzzz " * 9), out[0], (502, "À×÷ÿ " * 7 + "naïveté " * 6 + "日本語日本語日本語 " * 6)]


def test_op11(spark, folder, rows):
    assert rows_of(queries.op11_variants(spark, folder)) == brute(rows)


@pytest.mark.parametrize("longest", [sv.LIST, 4])
def test_all_near_words_are_found_also_in_long_lists(spark, typed, longest):
    docs = spark.createDataFrame(typed, "doc_id long, text string").repartition(3)
    clash = docs.withColumns({n: F.lit("x") for n in ("word", "n", "key", "a", "root")})
    want = brute(typed)
    assert len(want) > 300 and any(r[1] for r in want)
    assert rows_of(sv.variants(clash, longest)) == want


def test_no_words(spark, empty):
    assert sv.variants(empty).collect() == []
    assert sv.variants(spark.createDataFrame([(1, "short words only")], "doc_id long, text string")).collect() == []


def test_near_words_share_the_grams_that_an_edit_cannot_affect():
    rng = random.Random(7)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(6, 14))) for _ in range(400)]
    counts = Counter(w[p : p + n] for w in words for n in range(sv.SHORT, sv.LONG + 1) for p in range(len(w) - n + 1))
    kept_some = 0
    for often in (4, 30, 100):
        grams = sv.Grams(dict(counts), often)
        for word in words[:120]:
            own = grams.cut(word)
            least = len(own) - grams.affected(word, own)
            kept_some += least > 0
            keys = set(grams.keys(word))
            for other in rng.sample(sorted(set(edits(word, "abd")) - {word}), 25):
                theirs = grams.cut(other)
                shared = sum(any(other[p:e] == word[s:t] and abs(p - s) <= 1 for p, e in theirs) for s, t in own)
                assert shared >= least, (word, other, often)
                assert any(g == h and abs(p - q) <= 1 for g, p in keys for h, q in grams.keys(other)), (word, other, often)
    assert kept_some


def test_near_pairs_of_all_lengths(monkeypatch):
    rng = random.Random(9)
    for few in (0, 10**9):
        monkeypatch.setattr(sv, "FEW", few)
        for size in (6, 7, 8, 9, 15, 16, 17, 30):
            base = "".join(rng.choice("abÿ") for _ in range(size))
            around = sorted(set(edits(base, "abc")) | {base} | {"".join(rng.choice("abÿ") for _ in range(size)) for _ in range(9)})
            own, longer = [w for w in around if len(w) == size], [w for w in around if len(w) == size + 1]
            near = lambda a, b: b in set(edits(a, "abcÿ"))
            assert sorted(sv.near_pairs(own, own)) == [(i, j) for i, a in enumerate(own) for j, b in enumerate(own) if i < j and near(a, b)]
            assert sorted(sv.near_pairs(own, longer)) == [(i, j) for i, a in enumerate(own) for j, b in enumerate(longer) if near(a, b)]
