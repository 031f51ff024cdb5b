"""Small tables with every awkward case, and plain Python versions of shared rules."""

import random

import pytest

SEP = " \t\n\x0b\x0c\r"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text, fold=False):
    raw = (text or "").encode()
    return (raw.translate(LOWER) if fold else raw).split()


def prose(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def documents():
    """(doc_id, text, lang, source, extra): nulls, empties, ties, repeated rows, copies, a long text, a hot source."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    passage = prose(rng, 60, vocabulary)
    rows = []
    for i in range(60):
        text = "\n".join(prose(rng, rng.randint(3, 30), vocabulary) for _ in range(rng.randint(1, 6)))
        if i % 9 == 0:
            text += "\nA Line that\tmany documents share \n" + prose(rng, 4, vocabulary)
        if i % 7 == 0:
            text = prose(rng, 5, vocabulary) + " " + passage + " " + prose(rng, 5, vocabulary)
        rows.append([i, text, ("en", "de")[i % 2], "hot" if i % 3 else f"s{i % 4}"])
    base = prose(rng, 120, vocabulary).split(" ")
    for i in range(60, 90):  # near copies, copies
        copy = list(base)
        if i % 3:
            copy[rng.randrange(120)] = rng.choice(vocabulary)
        rows.append([i, " ".join(copy).upper() if i % 5 == 0 else " ".join(copy), "en", "hot"])
    rows += [
        [100, None, None, None], [101, "", "en", ""], [102, " \n\t ", "de", "hot"], [103, "one", "en", "hot"], [104, "one", "en", "hot"],
        [105, "word " * 3000, "en", "hot"], [106, prose(rng, 4000, vocabulary), "de", "s1"], [107, "a\n\nb\n", "en", None], [108, "x" * 5000 + " tail", "en", "s1"],
        [109, "123 !!! 456", "en", "s1"], [110, "ÄÖÜ straße ünïcode 中文 текст", None, "s2"],
    ]
    rows.append(list(rows[0]))  # a repeated row
    return [(*r, 7) for r in rows]


SCHEMA = "doc_id long, text string, lang string, source string, tk int"  # tk clashes with a name that the operators use


@pytest.fixture(scope="session")
def rows():
    return documents()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame([*rows, (None, rows[3][1], "en", "hot", 1)], SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
