import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, score array<int>"


def row(i, text):
    return (i, text, None, "s", None, "extra", [1, 2])


@pytest.fixture(scope="session")
def corpus(spark):
    """Copies, near copies, shared lines and passages, and every odd row: null
    and empty texts, a null id, a repeated row, a long text, odd white space."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(900)]

    def words(n):
        return [r.choice(vocabulary) for _ in range(n)]

    base, passage = words(200), words(60)
    texts = [" ".join(words(r.randint(1, 120))) for _ in range(25)]
    texts += [" ".join(base)] * 4
    for k in range(8):
        near = list(base)
        for _ in range(k):
            near[r.randrange(200)] = "changed"
        texts.append(" ".join(near))
    texts += [" ".join(words(40) + passage + words(30)) for _ in range(6)]
    texts += ["same line of text\n" + " ".join(words(9)) + "\n  SAME line of text\t" for _ in range(5)]
    texts += [None, "", "   \n\t ", "a", "A b\x0b c\x0cd", "x y " * 3000, "é ß z", "\n\n", "one\ntwo\n",
              " ".join(words(5000))]
    rows = [row(i, t) for i, t in enumerate(texts)]
    rows += [row(None, " ".join(base)), row(None, None), rows[3], rows[3]]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], SCHEMA)
