import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, start int, w bigint, node bigint, words string"


def frame(spark, rows):
    """A table of (doc_id, text) with further columns whose names the operators might use themselves."""
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), "k", 1, 2, 3, "w") for i, t in rows], SCHEMA)


def corpus(seed: int = 5, n: int = 60):
    """Documents with copies, near copies, shared passages, own repeats, odd characters, and nulls."""
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)] + ["the", "of", "and", "Ünï", "naïve", "日本", "İx", "it's", "3,5", "<|endoftext|>"]
    text = lambda k: " ".join(rng.choices(vocab, k=k))
    passage = text(40)
    out = []
    for i in range(n):
        kind = rng.randrange(8)
        t = text(rng.randrange(1, 160))
        if kind == 1 and out:
            t = rng.choice(out)[1] or ""
        elif kind == 2 and out:
            words = (rng.choice(out)[1] or "a b").split(" ")
            words[rng.randrange(len(words))] = "changed"
            t = " ".join(words)
        elif kind == 3:
            t = text(30) + "\n" + passage + "\t" + text(20)
        elif kind == 4:
            p = text(25)
            t = f"{p}\n{p} {text(10)}\n{p}"
        out.append((i * 3 + 1, t))
    long = " ".join(f"v{k % 7919}" for k in range(30_000))
    return [*out, (0, None), (500, ""), (501, " \n\t "), (502, "one"), (503, long), (504, long[:100_000]), (505, "\x00\x1f\x85 \x0b x"), (506, "a"), (507, "a")]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def odd(spark):
    """A null id, repeated rows, equal ids with different texts."""
    t = " ".join(f"q{k}" for k in range(60))
    return frame(spark, [(None, t), (None, None), (7, t), (7, t), (7, "other " + t), (8, None), (8, "x")])
