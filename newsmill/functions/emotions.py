"""Emotion scores as MAP<STRING, DOUBLE>."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsmill.functions.text import bind

# A stand-in for a trained classifier: a word list for each label, scores are smoothed shares.
LEXICON = {
    "anger": ("angry", "anger", "furious", "rage", "outrage", "hate", "hostile", "attack"),
    "fear": ("fear", "afraid", "scared", "threat", "danger", "panic", "terror", "worry"),
    "joy": ("happy", "joy", "glad", "excited", "delight", "celebrate", "smile", "win"),
    "love": ("love", "dear", "affection", "adore", "care", "kind", "tender", "friend"),
    "neutral": ("report", "said", "state", "plan", "data", "office", "public", "year"),
    "sadness": ("sad", "grief", "loss", "mourn", "cry", "tragic", "death", "lonely"),
    "surprise": ("surprise", "sudden", "shock", "amazed", "unexpected", "wonder"),
}


def lexicon_scores(text: Column, lexicon=LEXICON) -> Column:
    """Share of each label's words in the whole text, one added to every count."""
    labels = sorted(lexicon)
    tokens = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "), " ")

    def count(ts):
        def hits(members):
            return F.size(F.filter(ts, lambda t: t.isin(*members))) + 1
        return F.array(*[hits(lexicon[k]) for k in labels])

    def shares(counts):
        total = F.aggregate(counts, F.lit(0), lambda a, n: a + n)
        return bind(total, lambda all_: F.transform(counts, lambda n: n / all_))

    return F.map_from_arrays(F.array(*[F.lit(k) for k in labels]), bind(bind(tokens, count), shares))


def from_label_scores(pairs: Column) -> Column:
    """ARRAY<STRUCT<label, score>> -> MAP<label, score>; the last score of a label wins."""
    return F.aggregate(
        pairs, F.create_map().cast("map<string,double>"),
        lambda m, p: F.map_concat(
            F.map_filter(m, lambda k, _: k != p["label"]),
            F.create_map(p["label"], p["score"].cast("double"))))


def top_emotions(scores: Column, n: int = 3) -> Column:
    """The ``n`` highest scores as ARRAY<STRUCT<emotion, score>>; equal scores by label."""
    ranked = F.array_sort(F.transform(
        F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("k"), e["key"].alias("emotion"))))
    return F.slice(F.transform(
        ranked, lambda e: F.struct(e["emotion"].alias("emotion"), (-e["k"]).alias("score"))), 1, n)
