import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega the of and to in is".split()
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, spans string, node string, keep string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    out = []
    for i in range(n):
        out.append("".join(r.choices(["ba", "ke", "li", "mo", "nu", "ra", "se", "ti"], k=r.randint(2, 4))) if r.random() < 0.6 else r.choice(WORDS))
        if i % 11 == 10:
            out[-1] += "."
    return " ".join(out)


@pytest.fixture(scope="session")
def rows():
    """Ids and texts with all that may go wrong: nulls, empty and long texts, copies, repeated rows and ids, odd characters."""
    shared = prose(1, 60)
    long_text = " ".join(prose(s, 900) for s in range(40, 52))
    out = [
        (1, None), (2, ""), (3, "   \t\n "), (4, "one"), (5, "été ñandú 漢字 🙂 " * 9), (6, prose(2, 120)), (7, prose(2, 120)),
        (8, prose(3, 30) + " " + shared + " " + prose(4, 30)), (9, prose(5, 20) + "\n" + shared), (9, prose(5, 20) + "\n" + shared),
        (10, "spam " * 300), (11, long_text), (12, long_text[:9000] + prose(6, 50)), (13, prose(7, 200)), (13, prose(8, 200)),
        (None, prose(9, 80)), (None, prose(2, 120)), (14, "a" * 500), (15, prose(10, 150)), (16, prose(10, 149) + " changed"),
        (-5, prose(11, 70)), (10**12, prose(11, 70)), (17, "x\x0by\x0cz\rw " + prose(12, 40)), (18, "'\"\\ | $$$ ### !!! <|endoftext|> don't"),
    ]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en" if k % 3 else None, "s", len(t or ""), "x", "y", "z") for k, (i, t) in enumerate(rows)], COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)
