import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from evalspark.llm.frames import prepare  # noqa: E402


@pytest.fixture(scope="session")
def sql(spark):
    """The session with the operators' settings."""
    return prepare(spark)


@pytest.fixture
def odd(sql):
    """Nulls in any column, empty and blank texts, repeated rows and ids, and columns with clashing names."""
    long = " ".join(f"w{i}" for i in range(70))
    rows = [
        (1, None, "x", 1), (2, "", None, None), (3, " \n\t", "x", 2), (4, long, "x", 3), (4, long, "x", 3), (None, long, None, 4), (None, None, None, None),
        (5, "One line.\nOne line.\n 你好 \U0001f600 it's 12² \x00 end", "x", 5), (6, "single", "x", 6),
    ]
    extra = ", ".join(f"{c} string" for c in ("id", "n", "set", "key", "score", "path", "k0", "length", "rank", "body"))
    values = ["clash"] * 10
    return sql.createDataFrame([(*r, *values) for r in rows], f"doc_id long, text string, lang string, n_chars long, {extra}").repartition(3)
