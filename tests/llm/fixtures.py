"""Small document tables for the text operators."""

import random

WORDS = "amber basalt cedar delta ember fjord garnet harbor indigo juniper kelp lagoon meadow nectar onyx prairie quartz ridge sable tundra umber violet willow xenon yarrow zephyr".split()


def prose(seed, words):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 400)) for _ in range(words))


def edited(text, places, seed=0):
    out, r = text.split(" "), random.Random(seed)
    for k in r.sample(range(len(out)), places):
        out[k] = "changed" + str(r.randint(0, 10**6))
    return " ".join(out)


ODD_TEXTS = [None, "", " ", "\n\t ", "one", "Two  words", "two words", "ünïcödé 漢字 😀 text", prose(1, 30000), "x" * 50000]
ODD_NAMES = "hash name row n id block key component _id _key _sha _spans _n _all key0 key1 key_id cut_id cut_spans segments same toxic words".split()
DDL = "doc_id long, text string, " + ", ".join(f"{name} string" for name in ODD_NAMES)


def table(spark, texts, ids=None):
    """Documents with columns whose names the operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, *ODD_NAMES) for i, t in zip(ids, texts)], DDL)


def empty(spark):
    return spark.createDataFrame([], DDL)
