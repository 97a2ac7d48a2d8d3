import pytest

WORDS = "the and of to in is that for with on by this are was be from or at it an".split()


def sentence(rng, n):
    return " ".join("".join(rng.choice(["an", "er", "in", "th", "on", "re", "st", "ou"]) for _ in range(rng.randint(1, 3))) if rng.random() < 0.6 else rng.choice(WORDS) for _ in range(n))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus(spark):
    """(DataFrame, rows): prose with copies, near copies, shared passages, repeated lines, empty, null and long texts."""
    import random

    rng = random.Random(11)
    passage, line = sentence(rng, 60), sentence(rng, 12) + "."
    rows = []
    for k in range(160):
        lines = [sentence(rng, rng.randint(3, 30)) + "." for _ in range(rng.randint(1, 8))]
        if k % 7 == 0:
            lines.insert(rng.randint(0, len(lines)), passage)
        if k % 5 == 0:
            lines = [line, *lines]
        rows.append("\n".join(lines))
    for k in range(30):
        rows.append(rows[k])  # exact copies
        words = rows[40 + k].split(" ")
        words[rng.randrange(len(words))] = "edited"
        rows.append(" ".join(words))
    base = sentence(rng, 170).split(" ")
    for _ in range(60):  # one large group of near copies
        own = list(base)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(len(own))] = sentence(rng, 1)
        rows.append(" ".join(own))
    rows += ["", None, " ", "\n\n", "a", "a b", "A B", "ab " * 3000, "x" * 5000, "é𝄞中文 " * 50, "  two  spaces\t\ttabs \n", "▁mark ▁", "0"]
    rng.shuffle(rows)
    data = [(k * 3, t, "en", None if k % 31 == 0 else f"s{k % 4 if k % 3 else 0}", None if t is None else len(t)) for k, t in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA).repartition(3).cache(), data


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Rows that are equal, ids that repeat or are null, nulls in every column, and columns of clashing names."""
    same = "one line of text here that is long enough to count as a text of some length, and then a little more of it.\nand another"
    data = [(1, same, "en", "a", 5), (1, same, "en", "a", 5), (1, "another text under the same id", None, None, None), (None, same, None, None, None), (None, None, None, None, None), (2, "", "", "", 0), (2, None, "en", "a", 1)]
    df = spark.createDataFrame(data, SCHEMA)
    from pyspark.sql import functions as F

    clash = "part key class label size n component_id fingerprint bucket guest score predicted held_out n_removed n_lines copies taken target rank id v kind data removed same h c s a b u node".split()
    return df.withColumns({c: F.lit("x") for c in clash}), data
