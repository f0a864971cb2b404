"""Rows that every operator has to take: nulls, empty and long texts, ties, repeated rows."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "long words run on and on, " * 20000


def rows(texts, first=0):
    return [(first + i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]


def odd():
    plain = "one two three four five six seven eight nine ten eleven twelve"
    found = rows([plain, plain, "", None, " \n\t", "x", LONG, "Ünï çödé \U0001F600 " * 9])
    return found + [found[0], found[0], (None, plain, None, None, None), (None, None, None, None, None)]


def table(spark, found, clash=True):
    """The rows as a table of several partitions, with columns whose names operators use."""
    df = spark.createDataFrame(found, SCHEMA)
    if clash:
        names = ("size", "shard", "slot", "label", "name", "count", "_size", "_id", "_at", "_key",
                 "mark", "group", "k1", "a.b", "position")
        for c in names:
            df = df.selectExpr("*", f"'{c}' as `{c}`")
    return df.repartition(3)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
