import random

import pytest

SYLLABLES = "an be con de er fi ga hi in jo ka lo mi no or pa qu ri so ta un ve wo ya zu".split()
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
EXTRA = ", id long, bits long, key long, size long, number long, place long, block long, runs long, length long, __n long, "
EXTRA += "__id long, __n_lines long, __text_hash long, __spans long, `a.b` long, row long, text_hash long, n_lines long, n_removed long"


def prose(seed: int, words: int) -> str:
    draw = random.Random(seed)
    out = ["".join(draw.choices(SYLLABLES, k=draw.randint(1, 4))) for _ in range(words)]
    return "".join(w + ("\n" if i % 9 == 8 else " ") for i, w in enumerate(out)).strip()


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from ``(doc_id, text)`` pairs, with the other columns."""

    def make(pairs, extra=False):
        rows = [(i, t, "xx", "s", None if t is None else len(t)) + (None,) * (EXTRA.count(" long") * extra) for i, t in pairs]
        return spark.createDataFrame(rows, COLUMNS + EXTRA * extra)

    return make


@pytest.fixture(scope="session")
def odd(frame):
    """Null ids, null, empty, blank and very long texts, repeated rows and ids, clashing columns."""
    long_ = prose(1, 60_000)
    pairs = [
        (None, prose(2, 40)), (1, None), (2, ""), (3, " \n\t"), (4, "!!"), (5, "word"), (6, long_), (7, prose(3, 60)),
        (7, prose(3, 60)), (8, prose(3, 60)), (9, prose(4, 60)), (9, prose(5, 60)), (None, None), (10, "é€𝄞 " * 80),
        (11, "be " * 500), (12, "\0a\0b" * 40), (13, prose(1, 60_000) + " end"),
    ]
    return pairs, frame(pairs, extra=True)


@pytest.fixture(scope="session")
def none(frame):
    return frame([], extra=True)
