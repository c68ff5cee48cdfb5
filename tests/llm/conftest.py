import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"en": "th ing er on at en re st an he", "fr": "eau oux que ment elle ai ou re le é", "de": "sch ung keit ver ein er ch ß ü be"}


def prose(rng: random.Random, lang: str, n: int) -> str:
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, repeated lines, nulls, empties, a very long text and a repeated row."""
    rng = random.Random(3)
    out = [(i, "\n".join(prose(rng, lang, rng.randint(8, 40)) for _ in range(rng.randint(1, 5))), lang, f"s{i % 2}") for i in range(60) for lang in [("en", "fr", "de")[i % 3]]]
    line = "This License line is Repeated in many documents"
    out += [(100 + i, f"{prose(rng, 'en', 30)}\n  {line.upper() if i % 2 else line}\t\n{prose(rng, 'en', 20)}", "en", "s1") for i in range(5)]
    base = prose(rng, "en", 120)
    words = base.split()
    out += [(200 + i, " ".join([*words[: 20 * i + 3], "changed", *words[20 * i + 4 :]]), "en", "hot") for i in range(5)]
    out += [(210 + i, base, "en", "hot") for i in range(4)]
    out += [(300, None, None, None), (301, "", "en", None), (302, " \n\t\n", None, "s1"), (None, prose(rng, "de", 30), "de", "s0"), (303, "12 34 !!", "en", "s0"), (304, prose(rng, "fr", 9000), "fr", "s0")]
    out += [out[5], (305, "ää 日本 🙂🙂 don't stop'll " + "a" * 3000, "de", "s1")]
    return [(*r, len(r[1] or "")) for r in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def folder(spark, rows, docs, tmp_path_factory):
    """The documents, labels and a benchmark as a folder of tables."""
    path = str(tmp_path_factory.mktemp("tables"))
    docs.coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in rows[:40]] + [(None, 1, 0), (41, None, None), (301, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    items = [(1, " ".join(rows[0][1].split()[3:40])), (2, prose(random.Random(9), "fr", 30)), (3, None), (4, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path
