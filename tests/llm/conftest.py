import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, kept string, shard string"


@pytest.fixture(scope="session")
def texts():
    """Null, empty, tiny and very long texts, exact and near copies, ties, odd white space."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuw") for _ in range(r.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    passage = prose(120)
    out = [None, "", " ", "\n\n", "one", "One two three.", "tie tie tie tie", passage, passage, "À la é\x1c\x85 b  c  d　e", "a" * 900, "ab" * 700]
    base = prose(200)
    words = base.split(" ")
    for k in (1, 3, 40):
        near = list(words)
        for i in r.sample(range(len(near)), k):
            near[i] = word()
        out.append(" ".join(near))
    out += [base, base, base.upper()]
    out += [f"{prose(30)}\n{passage}\n{prose(20)}" for _ in range(3)]
    out += [prose(4000), "\n".join([prose(8)] * 6 + [prose(70)]), " | ".join(word() for _ in range(80)), " ".join(word() + "***" for _ in range(90))]
    out += [prose(r.randint(3, 150)) for _ in range(25)]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", None if i % 7 == 3 else f"src{i % 4}", None if t is None else len(t), 1, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[7]], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
