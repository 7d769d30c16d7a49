from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, fp long, tag string, k int, n_lines int, sequence_id string, score string, _hit int"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from ranktab.llm.shipping import ship

    ship(spark)


def base_texts() -> list[tuple[int | None, str | None]]:
    """Ids and texts with every odd case: nulls, blanks, copies, near copies, rows given twice, long ones."""
    rng = random.Random(5)
    stems = ["river", "stone", "lamp", "été", "strasse", "moon", "Glass", "harbour", "violet", "north", "paper", "engine"]
    text = lambda n: " ".join(rng.choice(stems) + rng.choice(["", "s", ",", ".\n", "!"]) + str(rng.randint(0, 60)) for _ in range(n))
    rows: list[tuple[int | None, str | None]] = [(i, text(rng.randint(1, 90))) for i in range(40)]
    rows += [(100 + i, rows[i][1]) for i in range(6)]  # exact copies
    rows += [(200 + i, rows[i][1].replace("moon", "noon", 1) + " end") for i in range(20)]  # near copies
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, "word"), (304, "a\n\nb\n"), (305, "!!! ??? ...")]
    rows += [(None, rows[3][1]), (None, "no id here"), (7, rows[7][1]), (7, rows[7][1])]  # no ids; a row given twice
    rows += [(400, text(9000)), (401, "ha " * 4000), (402, "Ünïcode 日本語 😀 " * 30)]
    shared = text(60)
    rows += [(500 + i, text(20) + "\n" + shared + "\n" + text(20)) for i in range(12)]  # a shared passage
    return rows


@pytest.fixture(scope="session")
def texts():
    return base_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3, "s", "q", 4) for i, t in texts], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
