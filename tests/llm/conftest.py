import random

import pytest

TABLES = "doc_id long, text string, lang string, source string, n_chars long, tie string, node string, kept boolean, _n int, score string"


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def make_texts(seed=1):
    """Texts with copies, near copies, shared passages, nulls, blanks, one very
    long text and odd characters."""
    rng = random.Random(seed)
    base = [words(rng, rng.randrange(20, 120)) for _ in range(25)]
    passage = "\n".join(words(rng, 20) for _ in range(3))
    texts = list(base)
    texts += [base[0]] * 4 + [base[1].upper(), base[2].upper()]
    for k in range(8):  # near copies: one word of a hundred changed
        w = base[3].split() * 3
        w[5 * k + 2] = f"new{k}"
        texts.append(" ".join(w))
    texts += [f"{words(rng, 30)}\n{passage}\n{words(rng, 30)}" for _ in range(6)]
    texts += [None, "", " \n\t ", "one", "two words", "one", "a b c d e", "x" * 3000, words(rng, 4000, 50)]
    texts += ["  leading 's and it's don't\n\n<|endoftext|> after", "naïve café – 😀 ½Ⅷ \u3000 中文字", "a.b!c?d\ne\r\nf", "!!! ### ***\n!!! ### ***"]
    return texts


@pytest.fixture(scope="session")
def texts():
    return make_texts()


def frame(spark, texts, ids=None):
    """Documents with further columns whose names clash with the operators' own."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", "s", len(t or ""), "t", "n", True, 1, "x") for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, TABLES).repartition(3)


@pytest.fixture(scope="session")
def docs(spark, texts):
    return frame(spark, texts)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], TABLES)
