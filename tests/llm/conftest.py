import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed: int, n: int) -> str:
    """``n`` words of invented prose with sentences."""
    out, x = [], seed * 7919 + 17
    for i in range(n):
        x = (x * 1103515245 + 12345) % 2 ** 31
        word = WORDS[x >> 8 & 15] + WORDS[x >> 16 & 15]
        out.append(word + ("." if x % 9 == 0 else ""))
    return " ".join(out)


# Null id, null, empty and blank texts, one word, a very long text, repeated rows, one id with two texts, ties.
EDGES = [(None, prose(1, 80)), (None, None), (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, prose(2, 40_000)),
         (6, prose(3, 90)), (6, prose(3, 90)), (7, prose(4, 70)), (7, prose(5, 70)), (8, prose(3, 90)),
         (9, prose(3, 89) + " changed"), (10, "é" * 5000), (11, prose(6, 120)), (12, "* | $ # " * 40)]
# Columns named like those the operators make or use inside.
CLASHES = ["key", "node", "label", "kept", "score", "at", "copy", "mix_key", "found", "window", "held_out", "gone"]


@pytest.fixture(scope="session")
def edges(spark):
    rows = [(i, t, "en", f"src{(i or 0) % 3}" if i != 4 else None, len(t) if t else 0, *range(len(CLASHES)))
            for i, t in EDGES]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
        f"{c} long" for c in CLASHES)
    return spark.createDataFrame(rows, schema).repartition(3, "doc_id")


@pytest.fixture(scope="session")
def empty(edges):
    return edges.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame(
        [(6, 1, 0), (7, 1, 0), (8, 1, 0), (9, 0, 1), (11, 0, 1), (12, 0, None), (12, None, 1), (None, 1, 1),
         (99, 0, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def tables(spark, sf_dir):
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
