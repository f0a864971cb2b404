"""Greedy packing of texts that no single task has to hold.

``chunk`` folds over the sentences of a text in its own row. Here a text comes in parts, and a
chunk's end follows from its start alone: with running sums of sizes, the next chunk starts at the
first sentence that would go over the budget. Those next-pointers are found in blocks of bounded
size; from block to block they are composed by pointer doubling, so a text of B blocks takes
log2(B) joins of narrow rows. Sentences stay together in the row of the part they start in; only
their sizes and numbers are rows of their own. Chunks are those of ``chunk``.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsmill.functions.text import (
    CHUNK_LIMIT, WHITESPACE, bind, count_tokens, count_words, py_strip, summary_budget)
from newsmill.operators.pin import pin
from newsmill.operators.scan import running_sums
from newsmill.session import passing, stored

STOPS = ("!", "?", ".")
SOME = f"[^|{WHITESPACE}]"
SPAN = 64  # budgets in a block
LONGS = T.ArrayType(T.LongType())


def cut_parts(parts: DataFrame, key: str, part: str, text: str) -> DataFrame:
    """Stored rows (key, part, head, rest, first, last, blank): the pieces of each part.

    ``key`` is a struct from here on, in which nulls compare as equal. ``blank`` is the text of a
    part that has nothing but white space in it.
    """
    marked = F.col(text)
    for stop in STOPS:
        marked = F.replace(marked, F.lit(f"{stop} "), F.lit(f"{stop}|"))
    rows = parts.filter(F.col(text).isNotNull()).select(
        F.struct(F.col(key).alias("key")).alias("key"), F.col(part).alias("part"),
        F.split(marked, r"\|").alias("pieces"),
        F.substring(text, 1, 1).alias("first"), F.substring(text, -1, 1).alias("last"),
        F.when(~F.col(text).rlike(SOME), F.col(text)).alias("blank"))
    rows = pin(rows, "pieces")
    return stored(rows.select("key", "part", F.get("pieces", F.lit(0)).alias("head"), F.slice(
        "pieces", 2, F.size("pieces")).alias("rest"), "first", "last", "blank"), "pieces")


def sentence_parts(cut: DataFrame) -> DataFrame:
    """Rows (key, part, ``sentences``): the sentences that start in each part, blank ones left out.

    A sentence may run over any number of parts, and a stop may end one part while its space
    begins the next. Which part a piece belongs to follows from one narrow row a part; only first
    pieces of parts are brought to the part their sentence starts in.
    """
    rows = cut.filter("first <> ''")
    order = Window.partitionBy("key").orderBy("part")
    opens = F.lag("last").over(order).isNull() | (
        F.lag("last").over(order).isin(*STOPS) & (F.col("first") == " "))
    narrow = rows.select("key", "part", "first", "last", (F.size("rest") > 0).alias("many")).withColumn("opens", opens)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    owner = F.last(F.when(F.col("many") | F.col("opens"), F.col("part")), True).over(before)
    places = stored(narrow.select("key", "part", "opens", owner.alias("owner")), "places")
    more = rows.select("key", "part", "head").join(places.filter("not opens"), ["key", "part"]).groupBy(
        "key", F.col("owner").alias("part")).agg(F.array_join(F.transform(F.array_sort(
            F.collect_list(F.struct("part", "head"))), lambda x: x["head"]), "").alias("more"))
    placed = rows.select("key", "part", "head", "rest").join(
        places.select("key", "part", "opens").join(more, ["key", "part"], "left"), ["key", "part"])
    own = F.when(F.col("opens"), F.concat(F.array("head"), "rest")).otherwise(F.col("rest"))
    whole = bind(own, lambda x: F.transform(x, lambda piece, j: py_strip(F.when(
        j == F.size(x) - 1, F.concat(piece, F.coalesce("more", F.lit("")))).otherwise(piece))))
    found = placed.select("key", "part", F.filter(whole, lambda x: x != "").alias("sentences"))
    return pin(found, "sentences").filter(F.size("sentences") > 0)


def sentence_rows(parts: DataFrame, key: str, part: str, text: str) -> DataFrame:
    """Rows (key, ``at``, ``sentence``) of texts that come in parts, ``part`` giving their order."""
    rows = sentence_parts(cut_parts(parts, key, part, text)).select(
        "key.key", "part", F.posexplode("sentences").alias("j", "sentence"))
    return rows.select("key", F.struct("part", "j").alias("at"), "sentence")


@F.arrow_udf(LONGS)
def sums_before(sizes: pa.Array) -> pa.Array:
    """For each number in an array, the sum of those before it."""
    ends = sizes.offsets.to_numpy()
    flat = sizes.values.to_numpy()[ends[0]:ends[-1]]
    ends = ends - ends[0]
    upto = np.concatenate(([0], np.cumsum(flat)))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(
        upto[:-1] - np.repeat(upto[ends[:-1]], np.diff(ends)), pa.int64()))


def pointers(max_tokens: int, length: int):
    """What ``blocks`` asks of a block, from the starts and sizes of the sentences it sees."""
    @F.pandas_udf("nexts array<long>, exits array<long>, entries long")
    def find(block: pd.Series, first: pd.Series, starts: pd.Series, sizes: pd.Series) -> pd.DataFrame:
        found = []
        for b, f, start, size in zip(block, first, starts, sizes):
            own = int(np.searchsorted(start, (b + 1) * length, "left"))
            over = np.searchsorted(start + size, start[:own] + max_tokens, "right")
            ahead = np.maximum(np.arange(1, own + 1), over)  # within the block, by place
            out = ahead.tolist()
            for place in range(own - 1, -1, -1):
                if out[place] < own:
                    out[place] = out[out[place]]
            near = int(np.searchsorted(start[:own], b * length + max_tokens, "right"))
            found.append((ahead + f, np.array(out, dtype=np.int64) + f, max(near, 1)))
        return pd.DataFrame(found, columns=["nexts", "exits", "entries"])

    return find


def blocks(rows: DataFrame, max_tokens: int, span: int = SPAN) -> DataFrame:
    """Rows (key, block, first, parts, js, nexts, exits, entries) from rows (key, part, j, i, start, n).

    A block holds the sentences that start within ``span`` budgets, and looks ahead at those that
    start within one budget of its end. ``nexts`` says where the chunk after one that starts at a
    sentence starts, ``exits`` the first start beyond the block that this leads to; the number of
    sentences where there is none. A chunk of an earlier block may end just before each of the
    first ``entries`` sentences.
    """
    length = span * max_tokens
    block = F.expr(f"start div {length}")
    near = F.col("start") - block * length <= max_tokens
    seen = rows.select("*", F.explode(F.when(near & (block > 0), F.array(block, block - 1)).otherwise(
        F.array(block))).alias("block"))
    met = seen.groupBy("key", "block").agg(F.array_sort(F.collect_list(
        F.struct("i", "start", "n", "part", "j"))).alias("seen"))
    met = met.filter(F.get("seen", F.lit(0))["start"] < (F.col("block") + 1) * length)
    made = met.withColumn("first", F.get("seen", F.lit(0))["i"]).withColumn(
        "found", pointers(max_tokens, length)("block", "first", "seen.start", "seen.n"))
    return made.select("key", "block", "first", F.col("seen.part").alias("parts"), F.col("seen.j").alias("js"), "found.*")


def _reached(entries: DataFrame) -> DataFrame:
    """Rows (key, i): entries met on the way from sentence 0, by doubling the length of jumps.

    ``entries`` has rows (key, i, exit); an exit that is no entry is the end of the text.
    """
    names = ("k", "from", "to")
    jumps = stored(entries.select(F.col("key").alias("k"), F.col("i").alias("from"), F.col("exit").alias("to")), "jumps")
    met = stored(entries.filter("i = 0").select("key", "i"), "met")
    while not jumps.isEmpty():
        same = (F.col("key") == F.col("k")) & (F.col("i") == F.col("from"))
        met = stored(met.unionByName(met.join(jumps, same).select("key", F.col("to").alias("i"))), "met")
        after = jumps.select(*[F.col(c).alias(f"{c}2") for c in names])
        jumps = stored(jumps.join(after, (F.col("k") == F.col("k2")) & (
            F.col("to") == F.col("from2"))).select("k", "from", F.col("to2").alias("to")), "jumps")
    return met


@F.pandas_udf(LONGS)
def chunks_opened(firsts: pd.Series, nexts: pd.Series, entries: pd.Series) -> pd.Series:
    """For each sentence of a block, how many chunks have started in the block, its own included.
    Without an entry (-1) none do."""
    found = []
    for first, ahead, entry in zip(firsts, nexts, entries):
        opened, place = np.zeros(len(ahead), dtype=np.int64), entry - first
        while 0 <= place < len(ahead):
            opened[place] = 1
            place = ahead[place] - first
        found.append(np.cumsum(opened))
    return pd.Series(found)


def chunk_numbers(made: DataFrame) -> DataFrame:
    """Rows (key, part, chunk numbers of the part's sentences), from the rows of ``blocks``."""
    made = stored(made, "blocks")
    far = made.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    entries = made.join(far, "key", "left_semi").select("key", "block", F.posexplode(
        F.slice("exits", 1, F.col("entries").cast("int"))).alias("p", "exit"), "first").select(
        "key", "block", (F.col("first") + F.col("p")).alias("i"), "exit")
    entries = stored(entries, "entries")
    # the way from block to block enters each at one sentence, if at all
    entered = entries.join(_reached(entries), ["key", "i"]).select("key", "block", F.col("i").alias("entry"))
    known = made.join(entered, ["key", "block"], "left")
    entry = F.coalesce("entry", F.when(F.col("first") == 0, F.lit(0)).otherwise(F.lit(-1))).cast("long")
    known = known.select("key", "block", "parts", "js", chunks_opened("first", "nexts", entry).alias("opened"))
    known = stored(known.withColumn("n", F.element_at("opened", -1)), "opened")
    before = running_sums(known, ["key"], "block", "block", {"through": F.col("n")}, along=["parts", "js", "opened", "n"])
    rows = before.select("key", F.explode(F.arrays_zip(
        F.slice("parts", 1, F.size("opened")).alias("part"), F.slice("js", 1, F.size("opened")).alias("j"),
        F.transform("opened", lambda x: F.col("through") - F.col("n") + x - 1).alias("no"))).alias("x"))
    return rows.groupBy("key", F.col("x.part").alias("part")).agg(F.transform(F.array_sort(
        F.collect_list(F.struct("x.j", "x.no"))), lambda x: x["no"]).alias("nos"))


def _runs(sentences, nos):
    """Sentences of one chunk in a row, joined: ARRAY<STRUCT<chunk_no, text>>."""
    begins = F.filter(F.sequence(F.lit(0), F.size(nos) - 1), lambda k: (k == 0) | (
        F.get(nos, k) != F.get(nos, k - 1)))
    return bind(begins, lambda at: F.transform(at, lambda b, q: F.struct(
        F.get(nos, b).alias("chunk_no"), F.array_join(F.slice(
            sentences, b + 1, F.coalesce(F.get(at, q + 1), F.size(nos)) - b), " ").alias("text"))))


def _texts(parts: DataFrame, key: str, part: str, text: str, count) -> tuple[DataFrame, DataFrame]:
    """Stored sentences with their sizes, by part; and the parts of texts that have none."""
    cut = cut_parts(parts, key, part, text)
    rows = stored(sentence_parts(cut).withColumn("sizes", F.transform(
        "sentences", lambda x: count(x).cast("long"))), "sentences", last=True)
    blank = cut.select("key", "part", F.col("blank").alias("text")).filter("text is not null").join(
        rows.select("key").distinct(), "key", "left_anti")
    return rows, stored(blank, "blank", last=True)


def _numbers(rows: DataFrame, max_tokens: int, span: int) -> DataFrame:
    """Stored chunk numbers of the sentences of each part, from their sizes."""
    sizes = rows.select("key", "part", "sizes", F.size("sizes").cast("long").alias("m"), F.aggregate(
        "sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    before = running_sums(sizes, ["key"], "part", "part", {"words": F.col("n"), "sentences": F.col("m")},
                          along=["sizes", "m", "n"])
    each = before.select("key", "part", F.col("words") - F.col("n"), F.col("sentences") - F.col("m"), F.posexplode(
        F.arrays_zip(F.col("sizes").alias("n"), sums_before("sizes").alias("before")))).toDF(
            "key", "part", "words", "sentences", "j", "x")
    each = each.select("key", "part", "j", (F.col("sentences") + F.col("j")).alias("i"), (
        F.col("words") + F.col("x.before")).alias("start"), "x.n")
    return stored(chunk_numbers(blocks(each, max_tokens, span)), "numbers", last=True)


def chunk_parts(parts: DataFrame, key: str, part: str, text: str, max_tokens: int = CHUNK_LIMIT,
                count=count_words, span: int = SPAN) -> DataFrame:
    """One row per chunk with its own token count and summary budget, of texts that come in parts.

    The parts of a text, in the order of ``part``, are the text; null parts are nothing. ``count``
    (Column -> Column) sizes a sentence. A text without sentences is its own chunk.
    """
    spark = parts.sparkSession
    with passing(spark):
        rows, blank = _texts(parts, key, part, text, count)
    with passing(spark):
        nos = _numbers(rows, max_tokens, span)
    pieces = rows.select("key", "part", "sentences").join(nos, ["key", "part"]).select(
        "key", "part", F.inline(_runs(F.col("sentences"), F.col("nos"))))
    made = pieces.groupBy("key", "chunk_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("part", "text"))), lambda x: x["text"]), " ").alias("chunk"))
    bare = blank.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("part", "text"))), lambda x: x["text"]), "").alias("chunk")).select(
        "key", F.lit(0).cast("long").alias("chunk_no"), "chunk")
    sized = made.unionByName(bare).withColumn("n_tokens", count_tokens(F.col("chunk"), count=count).cast("int"))
    return sized.withColumn("budget", summary_budget(F.col("n_tokens"))).select(
        F.col("key.key").alias(key), "chunk_no", "chunk", "n_tokens", "budget.min_len", "budget.max_len")
