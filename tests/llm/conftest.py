import random

import pytest

U = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=120, seed=3):
    """Small documents: near and exact copies, shared passages, nulls, empties, one long text, odd white space."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    say = lambda k: [rng.choice(vocab) for _ in range(k)]
    passage, texts = " ".join(say(60)), []
    for i in range(n):
        kind = i % 10
        if kind == 0 and texts:
            texts.append(rng.choice([t for t in texts if t]))
        elif kind == 1 and texts:
            w = rng.choice([t for t in texts if t and len(t) > 100] or ["x y z"]).split(" ")
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
        elif kind == 2:
            texts.append(" ".join(say(rng.randint(20, 60))) + "\n" + passage + "\nÉté " + " ".join(say(10)))
        elif kind == 3:
            texts.append(rng.choice([None, "", " \t\n", "One two", "Ünï  \x0b code x", passage[:60]]))
        else:
            texts.append(" ".join(say(rng.randint(5, 150))).capitalize())
    texts.append(" ".join(say(9000)))
    texts += [texts[4].upper(), "a b c " * 40, "same line\nsame line\nsame line " + " ".join(say(30))]
    return [(i, t, "en", None if i % 11 == 0 else f"s{i % 3}", 0) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, rows):
    """Further columns with the names that operators use inside."""
    names = "_id _text _sha _xx _w _s _h size shard slot length node key n rep root label kept score start end mark bucket text2".split()
    return spark.createDataFrame(
        [(*r, *[1] * len(names)) for r in rows[:15]], SCHEMA + "".join(f", {c} int" for c in names)
    )
