import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    """Words that hardly repeat."""
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghijklmnop", k=r.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """Usual and odd documents: nulls, empty and long texts, ties and repeated rows."""
    base = prose(1, 300)
    words = base.split()
    near = " ".join([*words[:150], "changed", *words[151:]])
    passage = prose(2, 60)
    lines = "\n".join(prose(100 + k, 8) for k in range(12))
    texts = [
        base, base, near, None, "", "   ", "two words", "two  words", prose(3, 40) + " " + passage + " " + prose(4, 40), prose(5, 90) + " " + passage,
        lines, "a new first line\n" + lines + "\nand a last one", "x" * 20_000, " ".join(["same"] * 5000), "Ünïcødé 😀 “text” with ▁ and \t tabs\r\n", prose(6, 3000), "one\ntwo\none\ntwo\none\ntwo",
    ]
    rows = [(i, t, "en" if i % 2 else None, "src" if i % 3 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[0], (5, "another text under a used id", "en", "src", 28), (None, "no id", "en", "src", 5), (-7, prose(7, 20), "de", "src", None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
