import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slice int, node long, key long, component_id long, n_words long, size long, rest string, score double, shard int, start long, part int, words string"
COLUMNS = len(SCHEMA.split(","))


def corpus(seed: int = 5, n: int = 60) -> list[tuple[int | None, str | None, str | None]]:
    """Ids, texts and sources with copies, near copies, shared passages, nulls, ties, blanks, repeats and long texts."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeiourstlnÉñ") for _ in range(rng.randint(1, 7))) for _ in range(300)] + ["The", "of", "a", "GNU", "***", "x|y", "№7"]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage, line = say(70), "Home | News | Contact"
    texts: list[str | None] = [None, "", "  \n\t ", "one", "one two", "one", say(3000), say(5) + "\n" + say(5), "same " * 200, passage, "é" * 120]
    base = say(120)
    while len(texts) < n:
        kind = rng.randrange(7)
        if kind == 0:
            texts.append(base)
        elif kind == 1:
            near = base.split(" ")
            for _ in range(rng.randint(1, 3)):
                near[rng.randrange(len(near))] = rng.choice(words)
            texts.append(" ".join(near))
        elif kind == 2:
            texts.append(f"{say(rng.randint(1, 30))}\n{passage}\n{line}\n{say(10)}\n{line}")
        elif kind == 3:
            texts.append(f"{say(20)} GNU General Public License, version 3. {say(5)}\nLicensed under CC BY-NC 4.0.")
        else:
            texts.append(say(rng.randint(1, 200)))
    rows = [(k, t, rng.choice(["a", "b", "c", None])) for k, t in enumerate(texts)]
    return [*rows, rows[9], (None, passage + " end", "a"), (None, None, None), (12, "other text of the same id " + passage, "b")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, s, len(t) if t else None, *[None] * (COLUMNS - 5)) for i, t, s in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
