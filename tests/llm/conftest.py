from __future__ import annotations

import random

import pytest
from brute import prose

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = "key string, n long, h long, kept boolean, base string, cell long, copies long, _kept int, _id int"

def texts() -> list[str | None]:
    """Awkward texts: null, empty, blank, short, copies, near copies, shared passages, very long ones."""
    rng = random.Random(3)
    base, passage = prose(rng, 120), prose(rng, 45)
    words = base.split()
    near = [" ".join([*words[:i], "changed", *words[i + 1 :]]) for i in (10, 11, 60)]
    shared = [f"{prose(rng, 30)}\n{passage} {prose(rng, 30)}" for _ in range(4)]
    lines = "\n".join(["the same line again", "", "another one"] * 6)
    return [
        None, "", " \t\n\x0b ", "one", "four words are here", "exactly five words are here",
        base, base, base.upper(), *near, *shared, passage, f"{passage} {passage}", lines,
        "word " * 50, "a b " * 3000, "x" * 30_000, prose(rng, 5000), "#$% " * 40, "éè ü ß 😀 " * 30,
    ]


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with awkward texts, null ids, a repeated row and columns whose names clash."""
    rows = [(i, t, "en", None if i % 7 == 0 else f"src{i % 5}", None) for i, t in enumerate(texts())]
    rows += [(None, prose(random.Random(9), 40), None, None, 1), (6, texts()[6], "en", "src1", None)]
    extra = (None, 1, 2, True, "b", 3, 4, 5, 6)
    return spark.createDataFrame([(*row, *extra) for row in rows], f"{COLUMNS}, {CLASHES}").repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], f"{COLUMNS}, {CLASHES}")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
