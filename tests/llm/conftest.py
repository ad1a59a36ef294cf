import random

import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with copies, near copies, shared passages, nulls, ties and clashing names."""
    rng = random.Random(5)
    syllables = "the an on er ing tion sch über éa ción ou wh be".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    passage = " ".join(word() for _ in range(40))
    rows = []
    for i in range(120):
        text = " ".join(word() for _ in range(rng.randint(0, 150)))
        if i % 5 == 1 and rows:
            text = rng.choice(rows)[1]
        elif i % 5 == 2 and rows:
            words = (rng.choice(rows)[1] or "a b").split()
            for _ in range(rng.randint(1, 2)):
                words[rng.randrange(len(words))] = word()
            text = " ".join(words)
        elif i % 5 == 3:
            text = text[: rng.randint(0, len(text))] + passage + text
        rows.append((i, text if text else "x", ["en", "de", None][i % 3], f"src{i % 4 if i % 3 else 0}"))
    rows += [(200, None, None, None), (201, "", "en", "src1"), (202, "  \t\n", "en", "src1")]
    rows += [(203, "ab " * 20000, "en", "src0"), (204, "ab " * 3000, "en", "src0")]
    rows += [rows[7], rows[0]]
    rows = [(*r, len(r[1] or ""), r[0], "x", r[0], "y", 1.0) for r in rows]
    rng.shuffle(rows)
    schema = "doc_id long, text string, lang string, source string, n_chars long, key long, kind string, place long, mix_tokens string, copy double"
    return spark.createDataFrame(rows, schema).repartition(5)


@pytest.fixture(scope="session")
def nameless(spark, docs):
    """docs with rows that have no doc_id."""
    rows = [(None, "no id " * 30, None, None, 180, None, None, None, None, None), (None, *docs.where("doc_id = 3").first()[1:]), (None, *[None] * 9)]
    return docs.unionByName(spark.createDataFrame(rows, docs.schema)).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
