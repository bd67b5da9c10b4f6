"""Small corpora with the awkward cases: nulls, empty and long texts, copies, near copies, shared passages."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, node long, component long, t binary"


def words(rng, n):
    return ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 6))) for _ in range(n)]


def sentence(rng, n=9):
    return " ".join(words(rng, n)).capitalize() + "."


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    passage = " ".join(sentence(rng) for _ in range(12))
    base = " ".join(sentence(rng) for _ in range(15))
    texts = [None, "", " ", "\n\n", "one", "two words", "x" * 3000, ("ab " * 900).strip(), passage, passage, "Tail    odd  spaces \n \n end ", "<|endoftext|> a <s> </s>"]
    for i in range(n):
        own = [sentence(rng) for _ in range(rng.randint(1, 14))]
        if i % 5 == 0:
            own.insert(rng.randint(0, len(own)), passage)
        if i % 7 == 0:
            w = base.split(" ")
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "zz"
            own = [" ".join(w)]
        texts.append(rng.choice([" ", "\n"]).join(own))
    texts.append(" ".join(sentence(rng) for _ in range(400)))
    return [(i, t, rng.choice(["en", "fr", None]), "s", len(t) if t else None, True, 1, 2, b"x") for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def with_oddities(rows):
    """Repeated rows, a null id, and one id with two texts."""
    return [*rows, rows[20], rows[20], (None, rows[21][1], *rows[21][2:]), (rows[22][0], "another text for this id. " * 3, *rows[22][2:])]
