import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHING = "key string, n long, t long, h long, slice long, comp string, taken long, w string, kind string, span string, place int, value string"


def prose(rng: random.Random, n: int, stem: str = "abcdefgh") -> str:
    return " ".join("".join(rng.choice(stem) for _ in range(rng.randint(2, 7))) for _ in range(n))


def sample_rows(seed: int = 1, n: int = 60) -> list[tuple]:
    """Prose, exact and near copies, shared passages, repeated lines, nulls, empty and long texts."""
    rng = random.Random(seed)
    passage = prose(rng, 90)
    rows = []
    texts: list[str] = []
    for i in range(n):
        kind = i % 8
        words = prose(rng, rng.randint(12, 160)).split(" ")
        if kind == 1 and texts:
            words = rng.choice(texts).split(" ")
        elif kind == 2 and texts:
            words = rng.choice(texts).split(" ")
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(len(words))] = "edit" + str(i)
        elif kind == 3:
            words = words[:9] + [passage] + words[9:]
        elif kind == 4:
            words = words[: rng.randint(0, 8)]
        elif kind == 5:
            words = words + ["\n" + " ".join(words[:10])] * 3
        text = " ".join(words)
        if kind != 3:
            texts.append(text or "x")
        rows.append((i, text, ("en", "de", None)[i % 3], ("s1", "s0", None, "hot", "hot")[i % 5], len(text)))
    rows += [(n, None, None, None, None), (None, "no id here at all", "en", "s1", 17), (n + 1, "", "de", "hot", 0), (n + 2, "日本語 テキスト !?", "de", "s1", 10), rows[0], (n + 3, prose(rng, 6000), "en", "hot", 1), (n + 4, "\t \n ", "en", "s0", 4), (n + 5, rows[0][1].upper(), "en", "s0", 4)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return sample_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The sample with further columns whose names clash."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import StructType

    df = spark.createDataFrame(rows, COLUMNS).repartition(3)
    for f in StructType.fromDDL(CLASHING):
        df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
