import random

import pytest

LONG = 120_000


def words(rng, n):
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()) + rng.choice(["", "s", "ed", "er"]) for _ in range(n)]


@pytest.fixture(scope="session")
def hard_texts():
    """Texts with copies, near copies, shared passages, repeats inside a text, and odd ones; by id."""
    rng = random.Random(5)
    base = words(rng, 120)
    passage = words(rng, 30)
    docs = {i: " ".join(words(rng, rng.choice([5, 25, 60, 200]))) for i in range(40)}
    for i in range(40, 52):
        near = list(base)
        for _ in range(i - 40):
            near[rng.randrange(len(near))] = f"x{rng.randrange(99)}"
        docs[i] = " ".join(near)
    docs |= {52: docs[40], 53: docs[41], 54: docs[40].upper(), 55: " ".join(base + passage), 56: " ".join(passage + base[:30]), 57: "\n".join(passage), 58: " ".join(["same"] * 70), 59: " ".join(["same"] * 45)}
    docs |= {60: "", 61: "   \n\t ", 62: None, 63: "word", 64: "Word", 65: "two words", 66: "éà ñ 漢字 🙂 ı İ", 67: "a@b.co 10.0.0.1 +1 (555) 123-4567 4111 1111 1111 1111", 68: "tab\tvt\x0bff\x0ccr\r\x1c\x1d nbsp x", 69: "a <|endoftext|> b  c , d .. e."}
    docs[70] = " ".join(words(rng, LONG))
    return docs


@pytest.fixture(scope="session")
def hard_docs(spark, hard_texts):
    """``hard_texts`` as a table with extra columns whose names operators use themselves."""
    rows = [(i, t, "en", "s", len(t or ""), 1, "t", 0.5, [1], True) for i, t in hard_texts.items()]
    schema = "doc_id long, text string, lang string, source string, n_chars long, tag int, doc string, score double, starts array<int>, kept boolean"
    return spark.createDataFrame(rows, schema).repartition(5)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Rows without id, rows that repeat an id with the same and with another text."""
    a = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twentyone"
    rows = [(None, a), (None, None), (1, a), (1, a), (1, "other text here"), (2, a + " more"), (3, ""), (3, None)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
