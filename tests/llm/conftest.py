import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "é", "ß"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus(spark):
    """Copies, near copies, shared passages, repeated lines, empty, null and long texts, ties and null ids."""
    rng = random.Random(5)
    passage, line = words(rng, 110), words(rng, 30)
    rows = []
    for k in range(60):
        text = words(rng, rng.choice([1, 3, 40, 200, 600]))
        if k % 5 == 0:
            text = words(rng, 20) + passage + " " + words(rng, 30)
        if k % 7 == 0:
            text += "\n" + "\n".join([line] * rng.randint(1, 5))
        rows.append(text)
    base = rows[3] + " " + words(rng, 150)
    rows += [rows[0]] * 4 + [base, base, base.replace("th", "TH", 3), base + " end", base.replace(" ", "  ", 5)]
    rows += [None, "", None, "", " ", "a", "x" * 900, "ab" * 700, words(rng, 9000), rows[8][:450], rows[8][20:]]
    data = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(rows)]
    data += [(5, rows[5], "en", "s", 1), (5, "other", None, None, None), (None, rows[10], None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(data, COLUMNS).repartition(5).persist()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
