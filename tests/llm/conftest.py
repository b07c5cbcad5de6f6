import random

import pytest

WORDS = "the of and to in rain stone river cloud Éclair über niño seven 42 lamp".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def edge_docs():
    """Rows (doc_id, text, lang, source, n_chars) with nulls, empty and long texts, ties, exact and near copies."""
    rng = random.Random(5)
    base = [sentence(rng, rng.randint(20, 120)) for _ in range(30)]
    shared = sentence(rng, 60)
    texts = list(base)
    texts += [base[0], base[0], base[1] + " end", "new " + base[2], shared + " " + base[3], base[4] + "\n" + shared, shared.upper()]
    texts += [None, "", "   \n", "!!! ...", "one", "one two", "ONE TWO", sentence(rng, 6000), shared * 3, "\x00 a\x0bb\x1cc d e f g"]
    return [(i, t, [None, "en", "de"][i % 3], [None, "s0", "s1", "s2"][min(i % 7, 3)], None if t is None else len(t)) for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def schema():
    return SCHEMA
