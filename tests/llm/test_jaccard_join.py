import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxaflow.llm import jaccard_join as jac
from taxaflow.llm import queries

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(rows, width=5):
    import re

    out = []
    for _, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
        out.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    return out


def brute(rows, sets=None):
    sets = sets or sets_of(rows)
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                label[root(i)] = root(j)
    least = {}
    for i, (doc_id, *_) in enumerate(rows):
        if doc_id is not None:
            r = root(i)
            least[r] = min(least.get(r, doc_id), doc_id)
    return sorted([(r[0], len(s), least.get(root(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))], key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def changed(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), min(n, len(words))):
        words[i] = f"x{rng.randrange(10**6)}"
    return words


@pytest.fixture(scope="module")
def near_copies():
    """Families of short and long texts with all numbers of edits, chains of edits, and a passage that many share."""
    rng = random.Random(8)
    word = lambda: "w" + str(rng.randrange(5000))
    out, doc = [], 0
    passage = [word() for _ in range(40)]
    for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 17, 20, 26, 34, 45, 60, 90, 140, 230, 400):
        base = [word() for _ in range(n)]
        for edits in range(7):
            out.append((doc := doc + 1, " ".join(changed(rng, base, edits if n > 20 else edits // 3))))
        out.append((doc := doc + 1, " ".join([*base, *[word() for _ in range(n // 5)]])))
        out.append((doc := doc + 1, " ".join(base[n // 6 :])))
        drift = base
        for _ in range(5):
            drift = changed(rng, drift, 1 + n // 60)
            out.append((doc := doc + 1, " ".join(drift)))
    out += [(doc := doc + 1, " ".join([*[word() for _ in range(rng.randint(0, 25))], *passage, *[word() for _ in range(rng.randint(0, 25))]])) for _ in range(60)]
    rng.shuffle(out)
    return out


def test_op13(spark, folder, rows):
    assert rows_of(queries.op13_jaccard(spark, folder)) == brute(rows)


@pytest.mark.parametrize("sizes", [(jac.BLOCK, jac.SLICE), (3, 5)])
def test_all_links_are_found_also_in_small_tiles(spark, near_copies, sizes):
    docs = spark.createDataFrame(near_copies, "doc_id long, text string").repartition(5)
    clash = docs.withColumns({n: F.lit("x") for n in ("node", "key", "n", "text_id", "label", "bitmap")})
    assert rows_of(jac.similar_sets(clash, block=sizes[0], part=sizes[1])) == brute(near_copies)


def test_no_pair_is_verified_again_in_later_rounds(spark, near_copies, monkeypatch):
    rounds, verified = [], jac._Join.verified
    monkeypatch.setattr(jac, "MORE", 2)
    monkeypatch.setattr(jac._Join, "verified", lambda self, pairs: rounds.append([tuple(r) for r in pairs.collect()]) or verified(self, pairs))
    docs = spark.createDataFrame(near_copies, "doc_id long, text string").repartition(5)
    assert rows_of(jac.similar_sets(docs)) == brute(near_copies)
    later = [pair for pairs in rounds[1:] for pair in pairs]  # the first round is that of the smallest members
    assert len(rounds) > 2 and len(later) == len(set(later))


def test_no_documents(spark, empty):
    assert jac.similar_sets(empty).collect() == []


def test_linked_sets_share_a_key_and_pass_their_bitmaps():
    rng = np.random.default_rng(2)
    for _ in range(3000):
        both = int(rng.integers(1, rng.choice([12, 40, 150, 600])))
        extra = int(rng.integers(0, both // 4 + 1))
        x_only = int(rng.integers(0, extra + 1))
        pool = rng.integers(0, 1 << 63, both + extra, dtype=np.int64).astype(np.uint64) * np.uint64(2)
        x, y = np.unique(pool[: both + x_only]), np.unique(np.r_[pool[:both], pool[both + x_only :]])
        if 100 * len(np.intersect1d(x, y)) < 80 * len(np.union1d(x, y)):
            continue
        known = np.concatenate([k for k, _, _ in jac.parts(x)])[::2]
        frequent = jac.Frequent(known, np.full(len(known), 9))
        assert len(np.intersect1d(jac.keys_of(x, frequent), jac.keys_of(y, frequent)))
        hits, differ = jac.Signatures([len(y)], [jac.signature(y)]).bits(len(x), jac.signature(x))
        assert len(hits) == 1 and differ[0] == jac.bits_between(jac.signature(x), jac.signature(y))
        keys = np.unique(known) >> np.uint64(3)
        for n in (1, 3, len(keys) // 2 + 1):
            want = keys[np.lexsort((keys, frequent(keys)))[:n]]
            assert set(frequent.first(keys, n)) == set(want)
        assert jac.overlap_reaches(x.tobytes(), y.tobytes())


def test_the_bound_of_the_exact_check():
    x = np.arange(10, dtype=np.uint64)
    assert jac.overlap_reaches(x[:8].tobytes(), x.tobytes()) and not jac.overlap_reaches(x[:7].tobytes(), x.tobytes())
    assert jac.overlap_reaches(x[:9].tobytes(), x[1:].tobytes()) and not jac.overlap_reaches(x[:9].tobytes(), (x + 1).tobytes())
