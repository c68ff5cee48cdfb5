import hashlib
import random
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from taxaflow.llm import conversation_trie as trie
from taxaflow.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, opening=lambda c: crc32(str(c).encode()) % 9):
    """Nodes by the definition: lists of turns, prefixes, sums over all pairs of nodes."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    built = {c: own.get(c - c % 5, [])[: opening(c)] + t[opening(c):] if opening else t for c, t in own.items()}
    members = {}
    for c, turns in sorted(built.items()):
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, own_members in members.items():
        inside = [p for p in members if p[: len(path)] == path]
        childless = lambda p: not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members)
        ends = ",".join(str(c) for c in own_members if len(built[c]) == len(path))
        out.append((
            own_members[0], len(path), members[path[:-1]][0] if path else None, len(own_members),
            sum(1 for q in members if len(q) == len(path) + 1 and q[: len(path)] == path), sum(map(childless, inside)),
            sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in inside if p), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def talks():
    """Families with common openings, copies, nulls, repeated rows, a long conversation and one without turns of its own."""
    rng = random.Random(5)
    said = [(r, "".join(rng.choice("abé 🙂") for _ in range(rng.randint(0, 9)))) for r in ("user", "assistant", None) for _ in range(3)]
    out = [(c, t, *rng.choice(said)) for c in range(60) for t in range(rng.randint(1, 7)) if c not in (10, 25)]
    out += [(200 + c, t, "user", f"the same {t}") for c in range(30) for t in range(3)]
    out += [(300, t, "user", "x") for t in range(150)]
    out += [(None, 0, "user", "nobody"), (301, None, "user", "last said first"), (301, 0, None, None), (302, None, None, ""), out[0], out[0]]
    rng.shuffle(out)
    return out


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_op12(spark, talks, tmp_path):
    spark.createDataFrame(talks, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    assert rows_of(queries.op12_trie(spark, str(tmp_path))) == brute(talks)


def test_small_shards_and_many_tasks_give_the_same_trie(spark, talks):
    clash = spark.createDataFrame(talks, SCHEMA).withColumns({n: F.lit("x") for n in ("family", "path", "a", "shard", "n_bytes")})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert rows_of(trie.prefix_trie(clash, shard=3)) == brute(talks)
        assert rows_of(trie.prefix_trie(clash, trie.as_they_are, shard=7)) == brute(talks, None)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_conversation_gives_no_node(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).collect() == []


def test_a_conversation_without_turns_is_a_member_of_the_root(spark):
    lonely = next(c for c in range(1, 100) if c % 5 and crc32(str(c).encode()) % 9 > 1)
    got = rows_of(trie.prefix_trie(spark.createDataFrame([(lonely, 0, "user", "x")], SCHEMA)))
    assert got == [(lonely, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lonely).encode()).hexdigest())]
