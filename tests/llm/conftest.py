import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {
    "en": "the and of house water river stone thing ship think brother light".split(),
    "de": "der und das haus wasser fluss stein ding schiff denken bruder licht".split(),
}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Null, empty, blank, letterless, short, odd and very long texts, copies and near copies."""
    rng = random.Random(2)
    base = prose(rng, "en", 120)
    near = base.split()
    near[60] = "changed"
    odd = [None, "", " \n\t ", "12 34 %%", "one", "two words", "ÀÉ ß straße naïve", "日本語 のテキスト", "tab\tand\r\nline  double", "a\x00b c", "İstanbul KK"]
    return [*odd, base, base, " ".join(near), prose(rng, "de", 150), prose(rng, "en", 30_000), *(prose(rng, rng.choice(["en", "de"]), rng.randrange(5, 80)) for _ in range(25))]


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i * 3, t, "en" if i % 2 else "de", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [(3, "", "en", "s", 0), (None, texts[11], None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
