import random

import pytest

WORDS = [a + b for a in ("th", "an", "er", "on", "ti", "sh", "lo", "mi") for b in ("e", "da", "ing", "or", "us", "el")]


def prose(rng, n, per_line=12):
    words = [rng.choice(WORDS) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + per_line]) for i in range(0, n, per_line))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source): prose, exact and near copies, shared passages, junk, nulls and repeated rows."""
    rng = random.Random(11)
    texts = [prose(rng, rng.choice([30, 60, 150, 400])) for _ in range(60)]
    passage = prose(rng, 90)
    out = list(texts)
    out += [texts[0]] * 5 + [texts[1] + " tail", "Lead " + texts[1]]
    for t in texts[2:12]:  # near copies with a few words changed
        w = t.split(" ")
        for _ in range(max(1, len(w) // 60)):
            w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    out += [f"{prose(rng, 40)}\n{passage}\n{prose(rng, 40)}" for _ in range(6)]
    out += ["", None, " \n\t ", "one", "one two three", "ONE two three", "a b c d e", "é ß 日本 ü", "ha " * 900, "\n\n".join(["same line here again"] * 9), "x" * 3000, "###$$$ %%% " * 30]
    rows = [(i, t, rng.choice(["en", "de"]), rng.choice(["s0", "s0", "s1"])) for i, t in enumerate(out)]
    return [*rows, rows[3], rows[3]]  # repeated rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string").repartition(5).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")
