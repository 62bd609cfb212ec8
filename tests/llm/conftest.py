import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos int, doc string, size string, block int, kept boolean, key string"


def corpus(seed=7, n=60):
    """Documents with copies, near copies, shared lines and passages, nulls, empties, odd characters, repeated rows and clashing columns."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["the", "ea", "ti", "on", "er", "É", "ß", "x9", "qu", ","]) for _ in range(r.randint(1, 4)))
    passage = " ".join(word() for _ in range(60))
    texts: list = [None, "", " ", "\n\n", "one", "one two\tTHREE four", "a" * 500, "ab " * 400, "\x1c\x85\xa0 \x0bx", "<|endoftext|> x<|startoftext|>", "日本語 текст"]
    for _ in range(n):
        kind = r.random()
        lines = [" ".join(word() for _ in range(r.randint(1, 25))) for _ in range(r.randint(1, 12))]
        if kind < 0.2 and len(texts) > 15:
            texts.append(r.choice(texts[11:]))
            continue
        if kind < 0.4 and len(texts) > 15:
            words = (r.choice(texts[11:]) or "x").split(" ")
            words[r.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
            continue
        if kind < 0.6:
            lines.insert(r.randrange(len(lines) + 1), passage)
        if r.random() < 0.5:
            lines.append(" Shared LINE é ")
        texts.append("\n".join(lines))
    texts.append(" ".join(word() for _ in range(20_000)))
    rows = [(i * 3, t, r.choice(["en", "de", None]), r.choice(["a", "b", "é", None]), len(t or ""), i, "d", "s", i, True, "k") for i, t in enumerate(texts)]
    rows.append((None, "no id here at all", "en", "a", 5, 0, "d", "s", 0, None, None))
    return rows + [rows[20], rows[0]]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
