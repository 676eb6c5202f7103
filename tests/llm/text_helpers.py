"""A small table with the cases every text operator has to take, and brute-force versions."""

import random
import re
import zlib

from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACES = re.compile(r"[\x20\x09-\x0D]+")
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


def words(text):
    return [w for w in SPACES.split(text or "") if w]


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def held(doc_id, divisor):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % divisor


def corpus(seed=1, n=70):
    """Random prose, exact and near copies, shared passages, nulls, blanks, one long text, other alphabets."""
    rng = random.Random(seed)
    parts = ["an", "re", "tion", "el", "or", "ing", "ou", "th", "ea", "st", "un", "ver", "ß", "é", "ñó"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    prose = lambda k: [word() for _ in range(k)]
    passage = prose(55)
    rows = []
    for i in range(n):
        body = prose(rng.choice([3, 12, 40, 80, 160]))
        if i % 9 == 4:
            at = rng.randint(0, len(body))
            body = body[:at] + passage + body[at:]
        rows.append((i, " ".join(body) + ".", ["en", "de", "fr"][i % 3], "src0", 0))
    base = [r for r in rows if len(r[1]) > 400]
    for j in range(12):
        i, text, lang, *_ = base[j % 5]
        new = text.split(" ")
        if j % 3:
            for _ in range(1 + j % 4):
                new[rng.randrange(len(new))] = word()
        rows.append((n + j, ("  " if j % 2 else "\n").join(new), lang, "src0", 0))
    rows += [
        (200, None, None, None, None), (201, "", "en", "src1", 0), (202, " \t\r\n\x0b\x0c ", "en", "src1", 0),
        (203, "don't <|endoftext|> STOP 12345 ²½ “x” 日本 \x1c \x85 a b", None, "src1", 1),
        (204, " ".join(prose(9000)), "de", "src1", 1), (205, "x", "en", "src1", 1), (206, "X", "en", "src1", 1),
        (207, "same words here now", "en", "s", 1), (208, "SAME words HERE now", "en", "s", 1),
        (None, "a row without an id " * 20, "en", "s", 1), (300, "twice " * 60, "en", "s", 1), (300, "twice " * 60, "en", "s", 1),
    ]
    return rows


def frame(spark, rows):
    """With extra columns whose names operators use inside."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit(c) for c in ("class", "key", "n", "digest", "rank", "text_key", "rest", "kept", "grp", "a", "b")})


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)
