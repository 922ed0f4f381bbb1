import random

import pytest
from samples import SCHEMA, words

@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows, ties, clashing extra columns."""
    rng = random.Random(5)
    base = words(rng, 80)
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "b", 1), (2, base, "en", "b", 1), (3, base.replace("ing", "ING", 1), None, None, None), (4, None, "en", "a", None), (5, "", None, "b", 0),
        (6, " \n\t ", "en", None, 3), (7, "one", "en", "c", 3), (8, "two words", "de", "c", 9), (9, words(rng, 30_000), "en", "a", None), (None, "no id here", "en", "a", 1),
        (10, "É ü 漢字 token = 'abcdefgh12345678' x", "fr", "é", 5), (11, "AKIA" + "A1" * 8 + " " + "0123456789abcdef" * 3, "fr", "é", 5), (12, "a" * 500, "en", "z", 500), (13, "1234 !!! 5678", "en", "z", 13),
    ]
    rows += [(20 + i, words(rng, rng.randint(5, 120)), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), 7) for i in range(60)]
    extra = [(*r, "x", 1.0, True, "y") for r in rows]
    return spark.createDataFrame(extra, SCHEMA + ", fingerprint string, score double, held_out boolean, size string").repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
