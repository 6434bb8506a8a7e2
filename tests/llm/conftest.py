import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], COLUMNS)


@pytest.fixture(scope="session")
def corpus():
    """Texts with exact and near copies, shared passages, short, empty and null ones, repeated rows and null ids."""
    rng = random.Random(7)
    letters = "abcdefghij"
    words = ["".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(300)]

    def prose(n):
        return " ".join(rng.choices(words, k=n))

    rows = [(i, prose(rng.randint(1, 160))) for i in range(40)]
    passage = prose(70)
    for i in range(40, 48):
        rows.append((i, f"{prose(30)} {passage} {prose(20)}"))
    base = prose(120).split()
    for i in range(48, 62):
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((i, " ".join(own)))
    rows += [(62 + k, rows[3][1]) for k in range(3)] + [(65, rows[41][1].upper()), (66, rows[41][1])]
    rows += [(67, None), (68, ""), (69, " \t\n"), (70, "one two"), (71, "one two"), (72, "ONE two"), (73, None)]
    rows += [(74, "ñandú 漢字 🙂 it's don't   x\r\n\r\n" * 3), (75, prose(20000)), (None, rows[5][1]), (None, None), (76, "same row"), (76, "same row")]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return documents(spark, corpus).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return documents(spark, [])


@pytest.fixture(scope="session")
def clashing(spark, docs):
    """The documents with extra columns named as operators name theirs."""
    from pyspark.sql import functions as F

    names = ("key", "row", "node", "bucket", "kept", "ranges", "size", "position", "ids", "packed", "digest", "label", "_gone", "component", "length")
    return docs.select("*", *(F.lit("x").alias(n) for n in names))
