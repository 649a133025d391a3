import random

import pytest

#: Names that operators use inside or return: inputs may have them too.
CLASHING = ["fp", "id", "tie", "text_", "key", "score", "candidates", "ids", "n_tokens", "leaks", "row", "query", "toxicity_score", "pii_spans", "held_out"]
WORDS = "river stone market garden window letter summer winter yellow silver number people morning evening mountain valley bridge castle forest island".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ly", "."]) for _ in range(n))


def rows() -> list[tuple]:
    texts = [(1, prose(1, 40)), (2, prose(1, 40)), (3, prose(3, 60) + "\n\n  Écrire à ñandú 12,5 %\t ok"), (4, ""), (5, None), (None, prose(6, 30)), (None, None),
             (7, "x" * 30_000), (8, ("ab1" * 9000) + " " + "é" * 3000 + "  \n" * 40 + "end"), (9, prose(9, 5000)), (10, prose(3, 60)), (10, prose(3, 60)), (10, prose(11, 20))]
    return [(i, t, "en", None, *["kept"] * len(CLASHING)) for i, t in texts]


@pytest.fixture(scope="session")
def docs(spark):
    """Null, empty, long, equal and repeated rows, and columns with names that operators use."""
    schema = "doc_id bigint, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame(rows(), schema)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture
def make_prose():
    return prose
