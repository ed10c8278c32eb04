"""Small tables of documents with the cases that every operator must stand."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts(seed: int = 5, n: int = 60) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 7))) for _ in range(300)] + ["The", "and", "of", "the", "漢字", "x y"]
    word = lambda: rng.choice(vocab)
    passage = " ".join(word() for _ in range(140))
    out: list[tuple[int | None, str | None]] = []
    for i in range(n):
        kind = i % 10
        body = "\n".join(" ".join(word() for _ in range(rng.randint(3, 30))) for _ in range(rng.randint(1, 6)))
        if kind == 3:
            body = body + "\n" + passage + " " + body
        elif kind == 4 and i > 10:
            body = out[rng.randrange(i)][1] or ""
        elif kind == 5 and i > 10:
            parts = (out[rng.randrange(i)][1] or "a b").split(" ")
            parts[rng.randrange(len(parts))] = "zz"
            body = " ".join(parts)
        elif kind == 6:
            body = passage[20:700] + body
        elif kind == 7:
            body = ("ab " * rng.randint(1, 90)) + "!!!!" * rng.randint(0, 60)
        out.append((i * 3, body))
    out += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "one"), (1004, "one two"), (1005, passage), (1006, passage), (1007, passage.upper()), (1008, "x" * 400), (1009, "x" * 90)]
    out += [(1010, passage * 30)]
    return out


def frame(spark, rows):
    """A documents table; the other columns are null."""
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)


def messy(rows):
    """With repeated rows, a null id and a null text without id added."""
    return [*rows, rows[3], rows[3], rows[13], (None, rows[3][1]), (None, None), (None, rows[23][1])]
