import random

import pytest

WORDS = "time people way water words number part sound work place year live back most sentence know little house world school never city tree cross farm story draft run press close night real few north".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture
def docs(spark):
    """docs([(id, text)...]) makes documents with columns that operators also use inside."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, part int, rank long, kind int, node long, score_ double, own int, n long, ids binary, hi long, mix_epoch int"
        return spark.createDataFrame([(d, t, None if k % 3 == 0 else "en", f"src{k % 4}" if k % 5 else None, len(t or ""), 1, 2, 3, 4, 0.5, 6, 7, b"x", 8, 9) for k, (d, t) in enumerate(rows)], schema)

    return make


@pytest.fixture
def edges():
    """Nulls, empty and blank texts, a long text, ties and repeated rows."""
    return [(1, None), (2, ""), (3, " \t\n "), (4, prose(4, 3000)), (5, prose(5, 40)), (5, prose(5, 40)), (5, prose(6, 40)), (None, prose(7, 20)), (None, None), (6, "é ß 漢字 \U0001f600 a"), (7, "one"), (8, prose(5, 40)), (-9, "'''x''' 12 $$$")]
