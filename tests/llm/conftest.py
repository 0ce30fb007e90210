import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, c0 long, text_key string, batch string, m string, id string, d string, k string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def rows():
    """Nulls in each column, empty, blank and very long texts, copies, repeated rows, shared passages."""
    rng = random.Random(7)
    passage, out = words(rng, 70), []
    add = lambda i, t, lang="en", source="a": out.append((i, t, lang, source, len(t or ""), i, "x", "y", "z", "w", "v", "u"))
    for i in range(40):
        add(i, words(rng, rng.randint(60, 200)), "en" if i % 2 else "fr", "ab"[i % 2])
    base = words(rng, 150)
    for i in range(40, 60):  # near copies
        w = base.split(" ")
        w[rng.randrange(len(w))] = f"x{i}"
        add(i, " ".join(w))
    for i in range(60, 70):  # exact copies
        add(i, base)
    for i in range(70, 80):  # a common passage
        add(i, words(rng, 30) + "\n" + passage + "\n" + words(rng, 30), source=None)
    for i, t in enumerate((None, "", "   ", "\n\n\t", "one", "One", "a b c", "é" * 300, "é" * 301, "ab" * 400, "same same same " * 60, "  lead\x0b trail  ", "<|endoftext|> a  b<|endoftext|>", "日本語のテキスト。 " * 30), 80):
        add(i, t, None, None)
    add(100, words(rng, 60_000), "en", "c")  # very long
    add(None, "a text of a row without an id that is long enough to have shingles", "en", "a")
    add(None, None, None, None)
    add(101, out[0][1])  # a copy of a row with another id
    out.append(out[3])
    out.append(out[3])  # repeated rows
    add(3, words(rng, 80))  # an id again with another text
    return out


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def duck(docs):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{docs.inputFiles()[0].removeprefix('file://').rsplit('/', 1)[0]}/*.parquet'")
    return c


def plain(frame):
    """Rows of a pandas frame as sorted tuples with None for nulls, columns by name."""
    frame = frame[sorted(frame.columns)]
    import pandas as pd

    def clean(x):
        if x is None or pd.isna(x):
            return None
        x = x.item() if hasattr(x, "item") else x
        return int(x) if isinstance(x, float) and x.is_integer() else x

    return sorted((tuple(map(clean, r)) for r in frame.astype(object).itertuples(index=False)), key=repr)
