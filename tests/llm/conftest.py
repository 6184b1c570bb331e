import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, lines int, a int, number int, `odd.name` string"


def prose(seed, n):
    draw = random.Random(seed)
    return [f"w{draw.randrange(400)}" for _ in range(n)]


@pytest.fixture(scope="session")
def texts():
    """{doc_id: text} with empty, missing, long, copied and nearly copied texts, shared lines and shared passages."""
    passage, line = " ".join(prose(1, 70)), "A line that stands in a number of documents, word for word."
    out = {1: None, 2: "", 3: " \n\t ", 4: "One two three", 5: "ünïcödé é\n" + passage, 6: passage + "\n" + passage}
    for i in range(10, 40):
        words = prose(i % 12, 120 + i % 12)
        if i > 24:
            words[60] = f"other{i}"
        out[i] = " ".join(words[:50]) + "\n" + " ".join(words[50:])
        if i % 3 == 0:
            out[i] += "\n  " + line.upper() + "\n" + line
        if i % 5 == 0:
            out[i] += "\n" + passage + " end"
    out[50] = " ".join(prose(99, 30_000))
    out[51] = "x" * 20_000
    out[52] = "ab " * 3_000
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as a table with columns whose names clash with those that operators make."""
    return spark.createDataFrame([(i, t, None if i % 2 else "en", "s", i, None, 1, "o") for i, t in texts.items()], SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def strange(spark):
    """Rows without an id, repeated rows, and one id with several texts."""
    long = " ".join(prose(7, 80))
    rows = [(None, long), (None, long), (None, None), (5, long), (5, long), (5, "x"), (-3, ""), (7, None)]
    return spark.createDataFrame([(i, t, None, None, None, None, None, None) for i, t in rows], SCHEMA)
