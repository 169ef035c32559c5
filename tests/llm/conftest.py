import random

import pytest

WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "pe", "ra", "su", "ti", "vo", "ze") for b in ("ban", "dor", "fel", "gim", "hul", "jar", "kos", "lun", "mev", "nix")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Copies, near copies, shared passages and lines, nulls, blanks, one-worders, a long text, a repeated row."""
    rng = random.Random(5)
    base = prose(rng, 120)
    words = base.split()
    passage, line = prose(rng, 55), "This LINE is shared by all documents"
    rows = [(0, base), (1, base), (2, base.upper()), (3, None), (4, ""), (5, " \t\n"), (6, "one"), (7, "one two"), (8, "One TWO")]
    for k in range(9, 30):
        own = list(words)
        for _ in range(k - 8):
            own[rng.randrange(len(own))] = rng.choice(WORDS) + "x"
        rows.append((k, " ".join(own)))
    for k in range(30, 44):
        rows.append((k, f"{prose(rng, 40)}\n{line if k % 2 else ' ' + line.lower()} \n{prose(rng, 9)} {passage} {prose(rng, 11)}\nshort"))
    rows.append((44, "na " * 90))
    rows.append((45, "\n".join(prose(rng, 30) for _ in range(200))))
    rows += [(46, prose(rng, 30)), (46, prose(rng, 30)), (30, rows[30][1]), (None, base), (None, prose(rng, 25)), (47, "é ÀÉ " * 12), (-3, passage)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """With columns whose names the operators use themselves."""
    rows = [(i, t, ("xx", "yy", None)[n % 3], ("b", None, "a", "b")[n % 4], n, n) for n, (i, t) in enumerate(odd_rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long").repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
