import random

import pytest

#: Rows that every operator must stand: nulls, empty and odd texts, ties, repeated rows.
ODD = [
    (1, "", "a"), (1, "", "a"), (2, None, None), (None, "x@y.org and 1.2.3.4", "a"), (None, None, None),
    (3, " \t\n", "b"), (4, "one", "b"), (5, "one two", "b"), (5, "one two", "b"), (6, "\x00é😀 ▁▁ <s>", "c"),
    (7, "a" * 5000, "c"), (8, "4111 1111 1111 1111\ncall +1 (743) 555-3824", "c"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(*r, 7, 7, "z", True) for r in ODD]
    names = "doc_id bigint, text string, source string, n_tokens int, bin int, `_key` string, kept boolean"
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="session")
def documents(spark):
    """Prose with exact and near copies, repeated lines, personal data and a hot source."""
    pick = random.Random(8)
    words = ["".join(pick.choice("abcdefghij") for _ in range(pick.randint(2, 7))) for _ in range(400)]

    def line():
        return " ".join(pick.choice(words) for _ in range(pick.randint(6, 40))).capitalize() + "."

    common, rows = line(), []
    for i in range(300):
        lines = [line() for _ in range(pick.randint(2, 9))]
        if i % 3 == 0:
            lines.insert(1, common)
        if i % 7 == 0:
            lines.append("mail joe.d@web.example.org or 10.20.30.40, card 4111-1111-1111-1111, +1 (743) 555-3824")
        rows.append((i, "\n".join(lines), f"s{0 if i % 3 else i % 20}"))
    rows += [(1000 + i, rows[5][1], f"s{i % 15}") for i in range(40)]
    rows += [(2000 + i, rows[9][1] + " " + pick.choice(words), "s1") for i in range(10)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
