import pytest
from pyspark.sql import functions as F

from newsmill.functions import emotions, guards, text, tokens
from newsmill.operators.chunk import chunk_table, chunks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


MIXED = "Rain 🌧 on 🚀 the 🧭 quay ⛵️"


def test_title_and_lines(spark):
    assert one(spark, text.clean_title(F.lit(MIXED))) == "Rain  on  the  quay"
    assert one(spark, text.clean_lines(F.lit(MIXED))) == ""
    lines = "\n".join(["a" * 30, "b" * 31, "  " + "c" * 31 + "\t"])
    assert one(spark, text.clean_lines(F.lit(lines))) == "b" * 31 + "\n" + "c" * 31


def test_the_two_emoji_classes_differ(spark):
    sample = "a日b🤖c☀d️e😀"
    assert one(spark, text.strip_corpus_emoji(F.lit(sample))) == "ab🤖cde"
    assert one(spark, text.strip_page_emoji(F.lit(sample))) == "a日bcde"


def test_strip_equals_python(spark):
    for sample in (" \t x y \n\x1c", " x　\x85", "​x​", "", "\x00 x"):
        assert one(spark, text.py_strip(F.lit(sample))) == sample.strip()


def test_words_equal_python(spark):
    for sample in ("a b\tc\x1cd e\xa0f", "  ", "", " x", "​"):
        assert one(spark, text.words(F.lit(sample))) == sample.split()


def test_sentences(spark):
    got = one(spark, text.sentences(F.lit("Hi! How are you? Fine. a|b  . End.")))
    assert got == ["Hi!", "How are you?", "Fine.", "a", "b  .", "End."]


@pytest.mark.parametrize("n, want", [
    (0, (12, 30)), (200, (12, 30)), (206, (12, 30)), (207, (12, 31)), (400, (24, 60)),
    (853, (50, 127)), (854, (51, 128)), (5000, (51, 128))])
def test_budget(spark, n, want):
    got = one(spark, text.summary_budget(F.lit(n)))
    assert (got["min_len"], got["max_len"]) == want


def test_budget_equals_python_everywhere(spark):
    rows = spark.range(3000).select("id", text.summary_budget(F.col("id")).alias("b")).collect()
    for r in rows:
        longest = min(128, max(30, int(r["id"] * 0.15)))
        assert (r["b"]["min_len"], r["b"]["max_len"]) == (max(10, int(longest * 0.4)), longest)


def test_route_percent_score(spark):
    assert [one(spark, text.route(F.lit(n))) for n in (1024, 1025)] == ["direct", "chunked"]
    assert [one(spark, text.as_percent(F.lit(v))) for v in (0.125, 0.5)] == [13, 50]
    assert one(spark, text.as_score(F.lit(8 / 11))) == 72.7273


def test_ids(spark):
    ids = F.sequence(F.lit(10), F.lit(609))
    cut = one(spark, tokens.truncate_ids(ids, 512))
    assert len(cut) == 512 and cut[0] == 0 and cut[-1] == 2 and cut[1:511] == list(range(10, 520))
    assert len(one(spark, tokens.truncate_ids(F.slice(ids, 1, 200), 128))) == 128
    got = one(spark, tokens.unmask(F.array(F.lit(5), F.lit(-100), F.lit(7)), 1))
    assert got == [5, 1, 7]
    sample = "  " + " ".join(f"w{i}" for i in range(700)) + " "
    whole = one(spark, tokens.hashed_ids(text.words(F.lit(sample))))
    assert one(spark, tokens.encode(F.lit(sample), 512)) == [0, *whole[:510], 2]


@pytest.mark.parametrize("url, want", [
    ("https://a.b/c", True), ("HTTP://x", True), ("ftp://q", False), ("not-a-valid-url", False),
    ("", False), (None, False), ("http://", False), ("https:x.org", True), (" http://x ", True),
    ("http://a b", False), ("http://u:p@h:80/p?q#f", True), ("http://h:port/", False),
    ("http://[::1]/", True), ("javascript:http://x", False)])
def test_urls(spark, url, want):
    assert one(spark, guards.is_web_url(F.lit(url).cast("string"))) is want


@pytest.mark.parametrize("n, status", [(0, "error"), (1, "ok"), (2000, "ok"), (2001, "error")])
def test_scoring_guard(spark, n, status):
    got = one(spark, guards.scoring_guard(F.lit("x" * n)))
    assert got["status"] == status
    if n == 2001:
        assert "2001" in got["detail"] and "2000" in got["detail"]


def test_blank_and_contracts(spark):
    for blank in ("", "   ", " \n"):
        assert one(spark, guards.blank_to_empty(F.lit(blank), F.lit("model"))) == ""
        assert one(spark, guards.summary_guard(F.lit(blank))) == "invalid"
    assert one(spark, guards.extraction_guard(F.lit(None).cast("string"), F.lit("t"))) == "missing"


def test_top_emotions(spark):
    m = F.create_map(*[F.lit(x) for x in ("joy", .5, "fear", .2, "anger", .2, "love", .1)])
    assert [e["emotion"] for e in one(spark, emotions.top_emotions(m))] == ["joy", "anger", "fear"]


def test_label_scores(spark):
    items = F.array(*[F.struct(F.lit(k).alias("label"), F.lit(v).alias("score"))
                      for k, v in (("joy", .5), ("fear", .2), ("joy", .7))])
    assert one(spark, emotions.from_label_scores(items)) == {"joy": .7, "fear": .2}


def test_lexicon_scores(spark):
    got = one(spark, emotions.lexicon_scores(F.lit("The delighted crew was glad, and joy filled the boat.")))
    assert max(got, key=got.get) == "joy" and abs(sum(got.values()) - 1) < 1e-12


PACKED = "One two. Three four five. Six! Seven eight nine ten eleven. Twelve."
LONG = "Seven eight nine ten eleven."


@pytest.mark.parametrize("limit, want", [
    (3, ["One two.", "Three four five.", "Six!", LONG, "Twelve."]),
    (4, ["One two.", "Three four five. Six!", LONG, "Twelve."]),
    (5, ["One two. Three four five.", "Six!", LONG, "Twelve."]),
    (100, [PACKED])])
def test_chunks(spark, limit, want):
    assert one(spark, chunks(F.lit(PACKED), limit)) == want


def test_chunk_fallback(spark):
    assert one(spark, chunks(F.lit("  "))) == ["  "]


def test_chunks_keep_every_sentence(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = docs.select(text.sentences(F.col("text")).alias("s"), chunks(F.col("text"), 50).alias("c"),
                      F.col("text")).collect()
    for r in got:
        assert " ".join(r["c"]) == (" ".join(r["s"]) if r["s"] else r["text"])
        for part in r["c"]:
            assert len(part.split()) <= 50 or part in r["s"]


def test_chunk_table(spark):
    df = spark.createDataFrame([(1, PACKED)], "k long, t string")
    rows = chunk_table(df, "k", "t", 4).orderBy("chunk_no").collect()
    assert [r["n_tokens"] for r in rows] == [4, 6, 7, 3]
