"""Small documents with everything that tends to break: nulls, empty and long texts, repeats, names that clash."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, name string, size int, fp string, chunk int, spans int, node int"


def words(rng, count, kinds=40):
    return " ".join(rng.choice(["The", "of", "été", "naïve,", "Über", "x."]) if rng.random() < 0.3 else f"w{rng.randrange(kinds)}" for _ in range(count))


def rows(seed=1, count=60):
    rng = random.Random(seed)
    texts = [words(rng, rng.choice([1, 2, 3, 8, 60, 200])) for _ in range(count // 3)]
    passage = "\n".join(words(rng, 30, 1000) for _ in range(3))
    out = []
    for i in range(count):
        text = rng.choice(texts)
        if i % 7 == 0:
            text = words(rng, 40, 900) + "\n" + passage + "\n" + words(rng, 12, 900)
        if i % 9 == 0:
            text += " password = hunter2hunter2 AKIA" + "Q" * 16 + " " + "0123456789abcdef" * 2
        out.append((i, text))
    out += [(1000, None), (1001, None), (1002, ""), (1003, "  \n\t\n "), (None, texts[0]), (None, None), (1004, "\n" * 300)]
    out += [(1005, words(rng, 20_000, 3000)), (1006, "z" * 70_000), (3, out[3][1]), (3, out[3][1]), (4, "another text under a used id")]
    out += [(1007, "日本語 のテキスト ▁▁ <|endoftext|> É́ \x00 \x1c 😀")]
    return [(i, t, rng.choice(["en", None]), rng.choice(["src0", None]), None if t is None else len(t), 7, None, 3, "f", 1, 2, None) for i, t in out]


def documents(spark, seed=1, count=60):
    return spark.createDataFrame(rows(seed, count), SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
