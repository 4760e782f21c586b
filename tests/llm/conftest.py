import re
from collections import Counter

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="session")
def words():
    return lambda t: WORD.findall(t or "")


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


LONG = " ".join(f"w{i % 977}x{i // 3}" for i in range(30_000))
ROWS = [
    (1, "one two three four five six seven " * 12, "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, " \n\t ", "de", "b"),
    (5, "short text", "en", None),
    (6, LONG, "en", "a"),
    (7, LONG, "en", "a"),
    (None, "a document without an id, of some length, that nobody else has, and that says little else", "fr", "c"),
    (8, "tie " * 60, "en", "a"),
    (8, "tie " * 60, "en", "a"),
    (9, "tie " * 60, "en", "a"),
    (10, "été ʃ 日本 <|endoftext|> İ x\x1cy é", "fr", "c"),
    (11, "x" * 70_000, "en", "a"),
]
#: columns whose names clash with the operators' own
CLASH = {"n_chars": 7, "n_words": 1, "n_tokens": 2, "kept": 3, "kept_text": 4, "size": 5, "shard": 6, "slot": 8, "leaks": 9, "distance": 10, "cid": 11, "path": 12, "length": 13, "spans": 14}


@pytest.fixture(scope="session")
def odd(spark):
    names = ["doc_id", "text", "lang", "source", *CLASH]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} int" for c in CLASH)
    return spark.createDataFrame([(*r, *CLASH.values()) for r in ROWS], schema).select(*names)


@pytest.fixture(scope="session")
def counted():
    return Counter(r[0] for r in ROWS)
