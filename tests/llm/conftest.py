import random

import pytest

WORDS = [a + b + c for a in "bcdfglmnprst" for b in "aeiou" for c in ("", "n", "r", "s", "tion", "ing")]


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """(id, text): prose, exact and near copies, shared passages, short, empty, blank and null texts, one long text."""
    r = random.Random(11)
    passage = prose(r, 60)
    out = [prose(r, r.randint(30, 200)) for _ in range(60)]
    out += [out[3], out[3].replace(" ", "  "), out[3] + "\n", out[5]]  # equal but for white space
    for k in range(25):  # near copies of one text, by more and more edits
        w = out[7].split()
        for _ in range(k // 2):
            w[r.randrange(len(w))] = r.choice(WORDS)
        out.append(" ".join(w))
    out += [f"{prose(r, 20)} {passage} {prose(r, 20)}" for _ in range(8)]
    out += ["", "   ", None, "one", "one", "one two three", "One TWO three", "café ÉTÉ 中文 \U0001f600", "x" * 300, "ab" * 200, prose(r, 20_000)]
    return list(enumerate(out))


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With extra columns whose names the operators use themselves."""
    extra = [(i, t, "en", "s", len(t or ""), 1.0, 2, b"x", [1]) for i, t in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, norm binary, bands array<long>").repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, and rows that repeat."""
    return spark.createDataFrame([(None, "same text here for all of us to see again"), (1, "same text here for all of us to see again"), (1, "same text here for all of us to see again"), (2, None), (None, None), (3, "another")], "doc_id long, text string")


BIG = (1 << 62) + 1


@pytest.fixture(scope="session")
def big_ids(spark):
    """Ids that a float cannot hold, beside a null one."""
    return spark.createDataFrame([(None, "a b"), (BIG, "a b c"), (-BIG, None)], "doc_id long, text string").coalesce(1)
