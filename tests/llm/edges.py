"""Small documents with the awkward cases every operator has a defined result for."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row long, `a.b` string"
CLASH = (7, "clash")


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}x{'' if rng.random() < 0.9 else ','}" for _ in range(n))


def documents(seed=1, n=60):
    """Rows of SCHEMA: nulls, empties, white space, ties, copies, near copies, shared passages."""
    rng = random.Random(seed)
    texts = [
        None, "", "   \n\t ", "a", "Ünïcödé — “quoted” don't!! 12.5", "x" * 3000,
        "one two three", "same same same " * 60, "line\n" * 80, "I’m <|endoftext|> it's 3rd\x00z",
        "　wide space\x1c sep 漢字かな交じり文 🙂🙂", "ab" * 400,
    ]
    passage = words(rng, 70)
    base = words(rng, 120)
    for _ in range(n):
        kind = rng.random()
        text = words(rng, rng.randrange(1, 300))
        if kind < 0.2:
            text = f"{text} {passage} {words(rng, 20)}"
        elif kind < 0.4:
            parts = base.split(" ")
            parts[rng.randrange(len(parts))] = "edit"
            text = " ".join(parts)
        elif kind < 0.5:
            text = base
        elif kind < 0.6:
            text = f"{text}\nshared line of text here\n{words(rng, 30)}"
        texts.append(text)
    rows = [
        (i, t, "en", None if i % 17 == 0 else f"src{i % 3}", None if t is None else len(t), *CLASH)
        for i, t in enumerate(texts)
    ]
    rng.shuffle(rows)
    return rows


def frame(spark, rows=None, **options):
    return spark.createDataFrame(documents(**options) if rows is None else rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
