import random

import pytest

from ledgerlight.llm.common import prepare

DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, key string, size string, score string, slot string"


@pytest.fixture(scope="session")
def llm(spark):
    return prepare(spark)


@pytest.fixture(scope="session")
def odd_docs():
    """Null, empty, blank, short, very long, equal, repeated, unlabelled and passage-sharing texts; a null id and null source."""
    draw = random.Random(7)
    fresh = lambda n: [draw.choice("abcdefghij") + format(draw.randrange(1 << 30), "x") for _ in range(n)]
    passage, other, body = fresh(70), fresh(55), fresh(300)
    join = lambda *parts: " ".join(w for p in parts for w in p)
    near = body.copy()
    near[150] = "changed"
    texts = [(1, None), (2, ""), (3, " \t\r\n\x0b\x0c "), (4, "one"), (5, "One two"), (6, join(fresh(40), passage, fresh(30))), (7, join(fresh(3), passage[:60], fresh(80), other)),
             (7, join(passage, other)), (8, join(body)), (9, join(body)), (9, join(body)), (10, join(near)), (None, join(passage, fresh(5))), (None, None),
             (11, join(fresh(9000), other, fresh(9000), passage)), (12, "x " * 120), (13, "x " * 90), (14, "Größe\u00a0ÉTÉ " * 20), (15, "same end"), (16, join(other[:49])), (17, join(other[:50]))]
    sources = ["b", "a", None, "é", "Z"]
    return [(d, t, "en", sources[i % 5], None if t is None else len(t), "r", None, "s", "x", "y") for i, (d, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd_frame(llm, odd_docs):
    return llm.createDataFrame(odd_docs, DOCUMENT).repartition(3)


@pytest.fixture(scope="session")
def no_docs(llm):
    return llm.createDataFrame([], DOCUMENT)
