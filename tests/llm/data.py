"""Small documents with everything that may go wrong."""

import random
import zlib

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents(seed=5, n=120):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = words(rng, rng.choice([1, 3, 8, 40, 120, 300]))
        rows.append((i, t, "en", rng.choice(["a", "b", "ü", "zz", None]), len(t)))
    base = words(rng, 200)
    rows += [(200 + i, base, "en", "hot", len(base)) for i in range(30)]  # copies
    for i in range(30):  # near copies
        w = base.split()
        w[rng.randrange(len(w))] = f"new{i}"
        rows.append((300 + i, " ".join(w), "en", "hot", 0))
    long = words(rng, 20_000)
    rows += [(400, None, None, None, None), (401, "", "en", "a", 0), (402, " \n ", "en", "a", 3), (403, long, "de", "b", len(long)), (404, long + " end", "de", "b", 0)]
    rows += [(405, "naïve café 😀 x", "fr", "a", 15), (405, "naïve café 😀 x", "fr", "a", 15)]  # a repeated row
    return rows


def write(spark, folder, rows, labels=()):
    spark.createDataFrame(rows, DOCS).repartition(5).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def crc(x):
    return zlib.crc32(x)
