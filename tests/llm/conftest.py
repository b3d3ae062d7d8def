import random
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent.parent)

#: Names that operators use inside, as extra columns.
EXTRA = "key string, node long, kept boolean, rate double, host string, _salt int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


@pytest.fixture(autouse=True)
def package_on_workers(spark):
    """Workers find the package wherever the tests are started."""
    known = spark.sparkContext.environment
    if ROOT not in known.get("PYTHONPATH", "").split(":"):
        known["PYTHONPATH"] = f"{ROOT}:{known.get('PYTHONPATH', '')}".rstrip(":")


def words(rng, n, size=300):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def lines_of(items, rng):
    out, at = [], 0
    while at < len(items):
        step = rng.randrange(5, 20)
        out.append(" ".join(items[at : at + step]))
        at += step
    return "\n".join(out)


def build_rows():
    """Texts with copies, near copies, shared passages and lines, and all odd cases."""
    rng = random.Random(7)
    rows = []

    def add(text, source="a"):
        rows.append((len(rows), text, source))

    base = [words(rng, rng.randrange(60, 160)) for _ in range(30)]
    for k, text in enumerate(base):
        add(lines_of(text, rng), "ab"[k % 2])
    for k in range(8):  # copies, with other line breaks, that are equal word by word
        add(" ".join(base[0]) if k % 2 else " ".join(base[0]).upper(), "a")
    for k in range(10):  # near copies of one text, each with changes of its own
        text = list(base[1])
        for _ in range(1 + k % 4):
            text[rng.randrange(len(text))] = f"x{rng.randrange(99)}"
        add(" ".join(text), "b")
    shared = " ".join(words(rng, 120))
    for k in range(6):  # a long passage in different surroundings
        add(" ".join(words(rng, 30)) + " " + shared + " " + " ".join(words(rng, 25)), "c")
    for k in range(12):  # a boilerplate line
        add(f"{' '.join(words(rng, 60))}\nshare  this page with friends \n{' '.join(words(rng, 15))}", "c")
    add(None, "a")
    add("", "a")
    add(" \n\t ", "b")
    add("single", "b")
    add("single", "b")
    add("two words", None)
    add("éèß #*$%&|<> 東京 " * 40, None)
    add("again and again " * 100, "a")
    add(" ".join(words(rng, 20_000, 5000)), "c")
    add("a" * 1500, "c")
    add("x y z\n" * 90, "b")
    return rows


@pytest.fixture(scope="session")
def corpus_rows():
    return build_rows()


@pytest.fixture(scope="session")
def corpus(spark, corpus_rows):
    """``documents`` with odd cases, repeated rows and clashing extra columns."""
    rows = [
        (i, t, "en", s, None if t is None else len(t), "k", 1, False, 0.5, "h", 3)
        for i, t, s in corpus_rows
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
