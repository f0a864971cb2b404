import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from newsmill.functions.text import count_tokens
from newsmill.operators import features, models
from newsmill.streaming.streams import enrich


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def cutter(texts, lows, highs):
    """A model that is no Spark expression."""
    return [" ".join(t.split()[:h]) for t, h in zip(texts, highs)]


def loads_once():
    return cutter


TEXTS = {1: "Short text here.", 2: "", 3: "   ", 4: "Tides lift small boats. " * 400, 5: None}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(TEXTS.items()), "k long, t string")


@pytest.mark.parametrize("load", [None, loads_once])
def test_summaries(docs, load):
    got = {r["k"]: r for r in models.summarise(docs, "t", load).collect()}
    assert got[1]["summary"] == "Short text here." and got[1]["route"] == "direct"
    assert got[2]["summary"] == got[3]["summary"] == got[5]["summary"] == ""
    assert got[4]["route"] == "chunked" and got[4]["n_tokens"] == 1602 and got[4]["n_chunks"] == 2
    assert 0 < len(got[4]["summary"].split()) <= 256


def test_second_pass_only_when_long(docs):
    got = {r["k"]: r for r in models.summarise(docs, "t", loads_once, max_tokens=40, direct_limit=100).collect()}
    assert got[4]["combined_tokens"] > 100 and len(got[4]["summary"].split()) <= 128


def test_same_input_same_summary(docs):
    a, b = (models.summarise(docs, "t").orderBy("k").collect() for _ in range(2))
    assert a == b


def test_lead_summary(spark):
    text = "One two three. Four five six. Seven eight."
    df = spark.createDataFrame([(text,)], "t string")
    for top, want in ((6, "One two three. Four five six."), (5, "One two three."), (2, "One two")):
        assert df.select(models.lead_summary(F.col("t"), F.lit(top))).first()[0] == want


def test_scorer_model(spark):
    def load():
        def score(texts):
            return [[{"label": "joy", "score": 0.75}, {"label": "fear", "score": 0.25}]
                    if "bad" not in t else {"label": "joy"} for t in texts]
        return score

    rows = [(1, "fine"), (2, ""), (3, "x" * 2001), (4, "bad"), (5, None)]
    df = spark.createDataFrame(rows, "k long, t string")
    got = {r["k"]: (r["status"], r["probabilities"], r["detail"]) for r in
           models.score_emotions(df, "t", load).collect()}
    assert got[1][:2] == ("ok", {"joy": 0.75, "fear": 0.25})
    assert all(got[k][0] == "error" and not got[k][1] for k in (2, 3, 4, 5))
    assert got[4][2] == "analyzer output is invalid"


@pytest.mark.parametrize("wrong", [lambda x: x[1:], lambda x: x + x[:1], lambda x: None])
def test_too_few_or_too_many_results_are_never_shifted(spark, wrong):
    def scores():
        def score(texts):
            made = [[{"label": t, "score": 0.5}] for t in texts]
            return wrong(made) if "break" in texts else made
        return score

    def summaries():
        def first(texts, lows, highs):
            made = [t.split()[0] for t in texts]
            return wrong(made) if "break" in texts else made
        return first

    rows = [(1, "a"), (2, "bb"), (3, "break"), (4, "dd dd dd"), (5, None)]
    df = spark.createDataFrame(rows, "k long, t string").coalesce(1)
    got = {r["k"]: (r["status"], r["probabilities"]) for r in
           models.score_emotions(df, "t", scores, batch_size=2).collect()}
    assert got[1] == ("ok", {"a": 0.5}) and got[2] == ("ok", {"bb": 0.5})
    assert got[3] == got[4] == ("error", None) and got[5][0] == "error"
    made = {r["k"]: r["summary"] for r in models.summarise(df, "t", summaries, batch_size=2).collect()}
    assert made == {1: "a", 2: "bb", 3: None, 4: None, 5: ""}
    answers = models.respond(models.summarise(df.withColumn("n", F.lit("x")), "t", summaries,
                                              batch_size=2), "n", "t")
    assert {r["k"]: r["status"] for r in answers.collect()}[3] == "invalid"


def test_other_counters(spark):
    df = spark.createDataFrame([(1, "aaaa bbbb. cccc dddd. eeee.")], "k long, t string")
    got = models.summarise(df, "t", loads_once, max_tokens=10, direct_limit=12, count=F.length).first()
    assert (got["n_tokens"], got["n_chunks"], got["route"]) == (29, 3, "chunked")


def test_batched_map_drops_columns(docs):
    out = models.map_batches(docs.filter("t is not null"), lambda b: b.assign(n=b.t.str.len())[["k", "n"]],
                             "k long, n long")
    assert out.columns == ["k", "n"] and {r["k"]: r["n"] for r in out.collect()}[1] == 16


def test_model_inputs_and_collation(spark):
    df = spark.createDataFrame([(i, "w " * (3 + i), "h " * (2 + i), i // 2) for i in range(4)],
                               "k long, article string, highlights string, b long")
    rows = features.model_inputs(df, keep=["k", "b"])
    assert rows.columns == ["k", "b", "input_ids", "attention_mask", "labels"]
    got = {r["k"]: r for r in features.collate(rows, "b").collect()}
    assert len(got[0]["input_ids"]) == len(got[1]["input_ids"]) == 6
    assert got[0]["input_ids"][-1] == 1 and got[0]["attention_mask"] == [1] * 5 + [0]
    assert got[0]["labels"][-1] == -100 and len(got[2]["labels"]) == 7


def test_token_counter_counts_markers(docs):
    assert docs.filter("k = 1").select(count_tokens(F.col("t"))).first()[0] == 5


def test_enrichment_keeps_bad_rows(spark):
    body = "This happy sentence is long enough to stay. " * 10
    rows = [(1, "u1", f"<h1>A title that is long enough to stay</h1><article>{body}</article>"),
            (2, "u2", "<p>no title</p>"), (3, "u3", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in enrich(df).collect()}
    assert got[1]["outcome"] == "ok" and got[1]["summary"] and got[1]["probabilities"]
    assert got[1]["full_article"] == body.strip()
    assert got[2]["reason"] == "No title found." and got[3]["outcome"] == "error"
