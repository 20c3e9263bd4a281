import pytest

WORDS = "the of and river stone light under carried morning slowly window garden letter winter answer silver mountain paper quiet thread".split()


def prose(n, seed):
    return " ".join(WORDS[(i * i * 7 + i * seed * 3 + seed) % len(WORDS)] + str((i * seed) % 17) for i in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """Ordinary, null, empty, blank, long, equal and repeated rows, and a column with a clashing name."""
    rows = [(i, prose(60 + i, i + 1), "en", f"src{i % 3}", 1) for i in range(24)]
    rows += [(24, None, "en", None, None), (25, "", None, "src1", 0), (26, " \n\t ", "en", "src0", 3), (27, prose(9000, 5), "en", "src2", 9)]
    rows += [(28, prose(70, 11), "en", "src0", 9), (29, prose(70, 11), "en", "src1", 9), (3, prose(63, 4), "en", "src0", 1), (None, prose(80, 77), "en", "src0", 1)]
    return spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, size int, fp int")


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
