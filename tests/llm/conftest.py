import datetime as dt
import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, digest int, fp string, length string, score string"


def words(rng, n, letters="abcdefghijklmnop"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def odd_rows():
    """Nulls everywhere, empty and very long texts, ties and repeated rows."""
    rng = random.Random(11)
    base = words(rng, 120)
    long_ = words(rng, 30_000)
    texts = [None, "", " \n\t ", "a", base, base.upper(), base, base + " tail", long_, long_ + " end", "x" * 300_000, "é" * 5000, "ß ß ß", "***" * 100, "\n".join(["same line"] * 40), "x" * 199, "x" * 200, words(rng, 900)]
    rows = [(i, t, ["en", "de", None][i % 3], ["a", None][i % 2], len(t) if t and i % 4 else None) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, base, None, None, None), (None, None, "en", "a", 1), (None, words(rng, 60), None, None, None), (None, "only once", "en", None, 3)]
    return [(*r, "k", 1, "f", "l", "s") for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def pages(spark):
    rng = random.Random(5)
    big, other = words(rng, 400), words(rng, 500)
    rows = [(1, "http://a.b.example.com/x/y?q#f", big), (2, None, big), (3, "https://u@Example.com:80", big), (3, "https://u@Example.com:80", big), (None, "http://n.com/", big), (4, "", None), (5, "x", ""), (6, "bad\r\nurl", "small"), (7, "http://q.de/é", "small"), (None, None, None), (9, "http://z.de/", other), (8, "http://z.de/", other)]
    return spark.createDataFrame([(*r, "k", dt.date(2024, 1, 1)) for r in rows], "page_id long, url string, html string, kind string, digest date")
