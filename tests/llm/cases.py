"""Tables with nulls, empty and long texts, ties, repeated rows and columns named like the operators' own."""

import random

CLASHING = ["__doc_id", "__th", "__row", "__gone", "toxic", "toxic_score", "copy", "tokens", "rate", "digest", "batch", "keep_id", "key", "lane", "window", "sig", "comp", "__copy", "__rate", "__0", "score"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed, alphabet="abcdefghijklmnopqrstuvwxyz"):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 8))) for _ in range(n))


def rows():
    base = [(i, words(30 + i, i), ["en", "de"][i % 2], f"src{i % 3}", 100) for i in range(40)]
    twin = base[0][1]
    near = " ".join(["changed", *base[1][1].split()[1:]])
    return [
        *base,
        (100, twin, "en", "src0", 1),
        (101, twin, None, None, None),
        (102, near, "en", "src1", 1),
        (103, "", "en", "src1", 0),
        (104, "", "en", "src1", 0),
        (105, None, "en", "src1", 0),
        (106, None, None, None, None),
        (None, "a row without a number is never a copy", "en", "src2", 5),
        (None, "a row without a number is never a copy", "en", "src2", 5),
        (107, words(60_000, 7), "en", "src2", 300_000),
        (108, "one", "en", "src2", 3),
        (109, " \n\t ", "en", "src2", 4),
        (5, base[5][1], "de", "src2", 100),
        (5, base[5][1], "de", "src2", 100),
        (110, "ünïcödé 文字 🙂 " * 3, "fr", "src1", 30),
    ]


def table(spark, data=None, clashing=False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows() if data is None else data, SCHEMA)
    return df.withColumns({c: F.lit(i) for i, c in enumerate(CLASHING)}) if clashing else df


def same_rows(df):
    return sorted(map(str, df.collect()))
