import random

import pytest

WORDS = "the of and river stone cloud amber field onere tionheth erandisth wherelan nderly ingthat".split()


def words(r, n):
    return " ".join(r.choice(WORDS) + str(r.randint(0, 40)) * r.randint(0, 1) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """doc_id, text, lang, source, n_chars and columns whose names the operators use themselves:
    nulls everywhere, empty and blank texts, repeats, ties, a very long text, a hot source."""
    r = random.Random(4)
    out = [(i, words(r, r.randint(1, 60)), r.choice(["en", "fr", None]), "hot" if i % 3 else f"s{i % 7}") for i in range(60)]
    long = words(r, 9000)
    out += [(60, None, "en", "a"), (61, "", "en", None), (62, " \t\n ", None, None), (63, long, "en", "hot"), (64, long, "en", "hot"), (None, "no id here", "fr", "a"), (None, None, None, None), (65, "12345 678", "en", "b"), (66, "Ünïcödé 漢字 😀\x00\x01 x", "fr", "b")]
    out += [(70 + i, out[5][1], "en", "hot") for i in range(12)] + [(7, out[7][1], out[7][2], out[7][3])]
    return [(*x, len(x[1]) if x[1] is not None else None, 1, "h", 2) for x in out]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, h string, cls int"


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def tables(docs, tmp_path_factory):
    """A folder of tables made of the fixture."""
    at = tmp_path_factory.mktemp("tables")
    docs.write.parquet(f"{at}/documents.parquet")
    return str(at)
