import random

import pytest

WORDS = [f"w{i}" for i in range(60)]


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text): passages, copies, near copies, empty, null, very long and repeated rows."""
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    passage, base = say(30), say(120)
    out = [(i, f"{say(rng.randint(0, 60))}\n{passage}\t{say(rng.randint(0, 20))}") for i in range(0, 40, 2)]
    for i in range(101, 131, 2):
        words = base.split()
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        out.append((i, " ".join(words)))
    out += [(200 + n, say(n)) for n in range(16)] + [(300, base.upper()), (301, base), (302, base)]
    out += [(400, None), (401, ""), (402, " \n\t "), (403, "é" * 50_000), (404, say(30_000)), (405, "naïve ﬁ — 日本 😀 İ")]
    out += [out[0], out[-1], (500, passage), (None, passage), (None, None)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With columns whose names operators use themselves."""
    data = [(i, t, "en", 7, 1, "x", -1) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, n_words int, id int, key string, n_chars long")
