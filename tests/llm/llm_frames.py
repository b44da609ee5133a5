"""Small frames with every odd case the operators must handle."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, keys int, score double"


def documents(spark, texts, partitions=3):
    """Rows with extra columns whose names an operator might use itself."""
    rows = [(i, t, "en", "s", len(t or ""), "x", 1, 0.5) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def odd_texts(seed=1, n=60):
    """Random word soup with copies, near copies, shared passages, nulls, empty, blank, one-word and long texts."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["Été", "ÜBER", "naïve", "日本", "🙂"]
    soup = lambda k: [r.choice(vocab) for _ in range(k)]
    passage = soup(40)
    texts = [None, "", " \t\n", "One", "one", "two words", "a b c", "A b C d", "a  b\nc\td", "x" * 5000]
    base = soup(120)
    for i in range(n):
        kind = i % 6
        if kind == 0:
            t = soup(r.randint(1, 80))
        elif kind == 1:
            t = list(base)
            for _ in range(r.randint(0, 4)):
                t[r.randrange(len(t))] = r.choice(vocab)
        elif kind == 2:
            t = soup(15) + passage[r.randint(0, 10):r.randint(25, 40)] + soup(15)
        elif kind == 3:
            t = texts[-1].split() if texts[-1] else soup(5)
        elif kind == 4:
            t = soup(30) * 2
        else:
            t = passage[:19] + soup(3)
        texts.append(r.choice([" ", " ", "\n", "  "]).join(t))
    texts.append(" ".join(soup(6000)))
    return list(enumerate(texts, start=3))


def rows(df):
    return {r[0]: r for r in df.collect()}
