import pytest

WORDS = [f"w{k}" for k in range(400)]


def text_of(rng, n, words=WORDS):
    return " ".join(rng.choices(words, k=n))


@pytest.fixture(scope="session")
def documents(spark):
    """A small fixture with exact and near copies, shared passages, repeated lines, empty, null and long texts."""
    import random

    rng = random.Random(7)
    passage = text_of(rng, 70)
    texts = [text_of(rng, rng.randint(20, 160)) for _ in range(40)]
    texts += [texts[3], texts[3], texts[5] + " tail", "lead " + texts[6], texts[7].replace("w1", "W1", 1)]
    texts += [text_of(rng, 30) + "  " + passage + "\n" + text_of(rng, 40) for _ in range(6)]
    texts += ["short text", "", None, " \n\t ", "a b c d e " * 30, "***" * 20, text_of(rng, 6000), "x\ny\nx\nz", passage]
    texts += [f"{text_of(rng, 12)}\nAll rights reserved by nobody\n{text_of(rng, 15)}" for _ in range(14)]
    rows = [(k, t, "en", f"src{k % 13}", len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, repeated rows and ids, and extra columns whose names clash."""
    rows = [
        (1, "one two three four five six", "s", 1, "x", "k"),
        (1, "one two three four five six", "s", 1, "x", "k"),
        (1, "another text under the same id", None, 2, None, "k"),
        (None, "one two three four five six", "s", None, "x", None),
        (None, None, None, None, None, None),
        (2, None, "s", 3, "x", "k"),
        (3, "", "s", 4, "x", "k"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int, fingerprint string, key string")
