from __future__ import annotations

import random

VOCABULARY = [f"w{i}" for i in range(400)]


def words(rng: random.Random, n: int) -> list[str]:
    return [rng.choice(VOCABULARY) for _ in range(n)]


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """(doc_id, text) with copies, near copies, shared passages, nulls, empty texts, a long text and repeated ids."""
    rng = random.Random(seed)
    rows = [(i, " ".join(words(rng, rng.randint(1, 300)))) for i in range(n)]
    passage = words(rng, 90)
    for i in range(n, n + 12):
        own = words(rng, 120)
        at = rng.randint(0, 120)
        rows.append((i, " ".join(own[:at] + passage[rng.randint(0, 15) : rng.randint(60, 90)] + own[at:])))
    for i in range(n + 12, n + 30):
        copy = rows[rng.randrange(0, 20)][1].split(" ")
        if i % 2:
            copy[rng.randrange(len(copy))] = "edited"
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(copy)))
    rows += [(900, None), (901, ""), (902, " \n"), (None, rows[3][1]), (None, None), (5, rows[7][1]), (5, rows[5][1]), (903, " ".join(words(rng, 20_000)))]
    return rows


#: Columns whose names operators use inside.
CLASHING = "doc_id long, text string, id int, row string, spans int, mark string, _id int, _mark int, _n int, _row string, mix int, fp int, score int, n_chars long, source string"


def clashing(spark, rows):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(i, t, 7, "r", 1, "m", 2, 3, 4, "x", 5, 6, 8, 0, None if k % 5 == 0 else f"s{k % 3}") for k, (i, t) in enumerate(rows)], CLASHING)


def frame(spark, rows):  # noqa: ANN001, ANN201
    return spark.createDataFrame(rows, "doc_id long, text string")
