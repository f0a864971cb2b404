"""Model-side queries: input ids, batches, chunks, summaries, emotion scores."""

from pyspark.sql import functions as F

from newsmill.functions import tokens
from newsmill.functions.emotions import from_label_scores, top_emotions
from newsmill.functions.text import as_percent
from newsmill.operators import chunk, features, models, spans
from newsmill.plans import sql
from newsmill.plans.articles import articles, table
from newsmill.plans.registry import query

BATCH = 8


def _ids_sql(x, limit):
    one = "CAST(('0x' || md5(w)[1:8])::BIGINT % 50000 + 4 AS BIGINT)"
    body = f"list_transform({sql.words(x)}[1:{limit - 2}], lambda w: {one})"
    return f"list_concat(list_concat([0::BIGINT], {body}), [2::BIGINT])"


INPUTS = f"""inputs AS (SELECT doc_id, {_ids_sql('article', 512)} AS ids,
  {_ids_sql('highlights', 128)} AS labels FROM articles)"""


def _show(*columns):
    return [F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c) for c in columns]


@query(f"""WITH {sql.ARTICLES}, {INPUTS} SELECT doc_id, array_to_string(ids, ' ') AS input_ids,
  array_to_string(list_transform(ids, lambda x: 1), ' ') AS attention_mask,
  array_to_string(labels, ' ') AS labels FROM inputs""")
def model_inputs(spark, sf_dir):
    rows = features.model_inputs(articles(spark, sf_dir, heavy=True), keep=["doc_id"])
    return rows.select("doc_id", *_show("input_ids", "attention_mask", "labels"))


PADDED = f"""{INPUTS}, sized AS (SELECT *, doc_id // {BATCH} AS batch_no,
    max(len(ids)) OVER (PARTITION BY doc_id // {BATCH}) AS n,
    max(len(labels)) OVER (PARTITION BY doc_id // {BATCH}) AS m FROM inputs),
padded AS (SELECT doc_id, batch_no, n, list_resize(ids, n, 1::BIGINT) AS ids,
    list_resize(list_transform(ids, lambda x: 1), n, 0) AS mask,
    list_resize(labels, m, -100::BIGINT) AS labels FROM sized)"""


def _batches(spark, sf_dir):
    rows = features.model_inputs(articles(spark, sf_dir, heavy=True), keep=["doc_id"])
    numbered = rows.withColumn("batch_no", F.floor(F.col("doc_id") / BATCH).cast("long"))
    return features.collate(numbered, "batch_no")


@query(f"""WITH {sql.ARTICLES}, {PADDED} SELECT doc_id, batch_no, array_to_string(ids, ' ') AS input_ids,
  array_to_string(mask, ' ') AS attention_mask, array_to_string(labels, ' ') AS labels FROM padded""")
def collated_batches(spark, sf_dir):
    return _batches(spark, sf_dir).select(
        "doc_id", "batch_no", *_show("input_ids", "attention_mask", "labels"))


@query(f"""WITH {sql.ARTICLES}, {PADDED} SELECT doc_id, array_to_string(list_transform(labels,
  lambda x: CASE WHEN x = -100 THEN 1 ELSE x END), ' ') AS labels FROM padded""")
def unmasked_labels(spark, sf_dir):
    rows = _batches(spark, sf_dir).select("doc_id", tokens.unmask(F.col("labels")).alias("labels"))
    return rows.select("doc_id", *_show("labels"))


def _words(x):
    return f"len({sql.words(x)})"


def _quarters(x):
    """A counter other than words: four characters to a token."""
    return f"((length({x}) + 3) // 4)"


def quarters(c):
    return F.ceil(F.length(c) / 4).cast("int")


def _chunks_sql(source, limit, count=_words, name="chunked"):
    """Greedy packing over (doc_id, text): a fold that keeps (tokens used, chunk texts)."""
    kind = "STRUCT(used BIGINT, done VARCHAR[])"
    step = (f"CASE WHEN len(acc.done) = 0 OR acc.used + x.used > {limit} "
            "THEN {'used': x.used, 'done': list_concat(acc.done, x.done)} "
            "ELSE {'used': acc.used + x.used, 'done': list_concat(acc.done[1:len(acc.done) - 1], "
            "[acc.done[len(acc.done)] || ' ' || x.done[1]])} END")
    return f"""{name}_parts AS (SELECT doc_id, text, list_transform({sql.sentences('text')},
    lambda s: CAST({{'used': {count('s')}, 'done': [s]}} AS {kind})) AS parts FROM {source}),
{name} AS (SELECT doc_id, CASE WHEN len(parts) = 0 THEN [text] ELSE list_reduce(parts,
    lambda acc, x: {step}, CAST({{'used': 0, 'done': []}} AS {kind})).done END AS chunks
    FROM {name}_parts)"""


def _chunk_rows_sql(limit, count=_words):
    return f"""WITH {_chunks_sql('documents', limit, count)}, rows AS (
  SELECT doc_id, chunks, unnest(range(1, len(chunks) + 1)) AS k FROM chunked),
sized AS (SELECT doc_id, k - 1 AS chunk_no, chunks[k] AS chunk,
  {count('chunks[k]')} + 2 AS n_tokens FROM rows)
SELECT doc_id, chunk_no, chunk, n_tokens, {sql.min_len('n_tokens')} AS min_len,
  {sql.max_len('n_tokens')} AS max_len FROM sized"""


@query(_chunk_rows_sql(900))
def chunk_table(spark, sf_dir):
    return chunk.chunk_table(table(spark, sf_dir, "documents", heavy=True), "doc_id", "text")


@query(_chunk_rows_sql(90))
def chunk_table_small(spark, sf_dir):
    """A tight budget, so that most documents have several chunks."""
    return chunk.chunk_table(table(spark, sf_dir, "documents", heavy=True), "doc_id", "text", 90)


@query(_chunk_rows_sql(90))
def chunk_table_of_parts(spark, sf_dir):
    """Texts in parts of 1000 characters, packed over blocks of four budgets."""
    docs = table(spark, sf_dir, "documents", heavy=True)
    cut = F.when(F.length("text") > 0, F.regexp_extract_all("text", F.lit("(?s).{1,1000}"), F.lit(0)))
    parts = docs.select("doc_id", F.posexplode(F.coalesce(cut, F.array("text"))).alias("part", "piece"))
    return spans.chunk_parts(parts, "doc_id", "part", "piece", 90, span=4)


@query(_chunk_rows_sql(200, _quarters))
def chunk_table_by_count(spark, sf_dir):
    """Chunks sized by a counter that is not words."""
    return chunk.chunk_table(table(spark, sf_dir, "documents", heavy=True), "doc_id", "text", 200,
                             count=quarters)


def _lead_sql(source, text, name, count=_words):
    """Stand-in summary of (doc_id, k, text) rows: leading sentences within the budget."""
    return f"""{name}_s AS (SELECT *, {sql.sentences(text)} AS s,
    {sql.max_len(f"({count(text)} + 2)")} AS top FROM {source}),
{name}_k AS (SELECT *, len(list_filter(range(1, len(s) + 1), lambda i:
    list_sum(list_transform(s[1:i], lambda x: len({sql.words('x')}))) <= top)) AS fit FROM {name}_s),
{name} AS (SELECT * EXCLUDE (s, top, fit), CASE WHEN fit > 0 THEN array_to_string(s[1:fit], ' ')
    ELSE array_to_string(({sql.words("coalesce(s[1], '')")})[1:top], ' ') END AS made FROM {name}_k)"""


def _shortest_sql(source, text, name, count=_words):
    """The model below: the first words of each text, as many as its summary has at least."""
    return f"""{name} AS (SELECT *, array_to_string(({sql.words(f"coalesce({text}, '')")})[
    1:{sql.min_len(f"({count(text)} + 2)")}], ' ') AS made FROM {source})"""


def summaries_sql(limit, direct, count=_words, model=_lead_sql):
    """The whole summariser: route, chunk, summarise, combine, summarise again when long."""
    return f"""WITH sized AS (SELECT doc_id, text, {count('text')} + 2 AS n_tokens FROM documents),
routed AS (SELECT *, CASE WHEN {sql.strip('text')} = '' THEN 'blank' WHEN n_tokens <= {direct}
    THEN 'direct' ELSE 'chunked' END AS route FROM sized),
long AS (SELECT doc_id, text FROM routed WHERE route = 'chunked'),
{_chunks_sql('long', limit, count)},
units AS (SELECT doc_id, 1 AS k, text AS unit FROM routed WHERE route = 'direct' UNION ALL
  SELECT doc_id, k, chunks[k] FROM (SELECT doc_id, chunks, unnest(range(1, len(chunks) + 1)) AS k
    FROM chunked)),
{model('units', 'unit', 'first_pass', count)},
joined AS (SELECT doc_id, string_agg(made, ' ' ORDER BY k) AS joined, count(*) AS n_chunks
  FROM first_pass GROUP BY doc_id),
counted AS (SELECT r.doc_id, r.route, r.n_tokens, coalesce(j.n_chunks, 0) AS n_chunks,
    coalesce(j.joined, '') AS joined,
    {count("coalesce(j.joined, '')")} + 2 AS combined_tokens
  FROM routed r LEFT JOIN joined j USING (doc_id)),
{model('counted', 'joined', 'second_pass', count)}
SELECT doc_id, route, n_tokens, n_chunks, combined_tokens,
  CASE WHEN route = 'chunked' AND combined_tokens > {direct} THEN made ELSE joined END AS summary
FROM second_pass"""


SUMMARY_COLUMNS = ("doc_id", "route", "n_tokens", "n_chunks", "combined_tokens", "summary")


@query(summaries_sql(900, 1024))
def summaries(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", heavy=True).select("doc_id", "text")
    return models.summarise(docs, "text").select(*SUMMARY_COLUMNS)


@query(summaries_sql(60, 80))
def summaries_small(spark, sf_dir):
    """Tight limits, so that the second pass over combined summaries happens."""
    docs = table(spark, sf_dir, "documents", heavy=True).select("doc_id", "text")
    return models.summarise(docs, "text", max_tokens=60, direct_limit=80).select(*SUMMARY_COLUMNS)


def shortest(texts, lows, highs):
    """A model from outside Spark: the first ``low`` words of each text."""
    return [" ".join(t.split()[:n]) for t, n in zip(texts, lows)]


@query(summaries_sql(60, 80, model=_shortest_sql))
def summaries_by_model(spark, sf_dir):
    """A Python model over whole documents, through chunks and the second pass."""
    docs = table(spark, sf_dir, "documents", heavy=True).select("doc_id", "text")
    return models.summarise(docs, "text", lambda: shortest, max_tokens=60, direct_limit=80).select(
        *SUMMARY_COLUMNS)


@query(summaries_sql(100, 150, _quarters))
def summaries_by_count(spark, sf_dir):
    """Budgets, chunks and routes by a counter that is not words."""
    docs = table(spark, sf_dir, "documents", heavy=True).select("doc_id", "text")
    return models.summarise(docs, "text", max_tokens=100, direct_limit=150, count=quarters).select(
        *SUMMARY_COLUMNS)


def count_in_batch(batch):
    return batch.assign(n_words=batch.text.str.split().str.len())[["doc_id", "n_words"]]


@query(f"SELECT doc_id, len({sql.words('text')}) AS n_words FROM documents")
def batched_map(spark, sf_dir):
    """A Python function over Arrow batches; other columns are dropped."""
    docs = table(spark, sf_dir, "documents", heavy=True).select("doc_id", "text")
    return models.map_batches(docs, count_in_batch, "doc_id long, n_words long")


@query(f"""WITH {sql.ARTICLES} SELECT doc_id, CASE WHEN {sql.strip('highlights')} = ''
  THEN 'invalid' ELSE 'ok' END AS status, split AS title, highlights AS summary,
  article AS full_article FROM articles""")
def responses(spark, sf_dir):
    rows = articles(spark, sf_dir).withColumns({
        "summary": F.col("highlights"), "title": F.col("split")})
    return models.respond(rows, "title", "article").select(
        "doc_id", "status", "title", "summary", "full_article")


# words of the invented prose, so that the stand-in scorer has something to find
WORDS = {
    "anger": ("er", "en", "und"), "fear": ("the", "on", "le"), "joy": ("is", "que", "sch"),
    "love": ("of", "eau", "ie"), "neutral": ("a", "la", "de"), "sadness": ("re", "ti", "an"),
    "surprise": ("it", "in", "ou"),
}


def scores_sql(lexicon=WORDS, source="documents"):
    """shares (doc_id, emotion, score) of the texts short enough to be scored."""
    counts = ", ".join(
        f"len(list_filter(t, lambda w: w IN ({', '.join(repr(w) for w in lexicon[k])}))) + 1 AS {k}"
        for k in sorted(lexicon))
    total = " + ".join(sorted(lexicon))
    rows = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS emotion, CAST({k} AS DOUBLE) / ({total}) AS score "
                              "FROM counted_words" for k in sorted(lexicon))
    return f"""scored AS (SELECT doc_id, string_split(
    regexp_replace(lower(text), '[^\\p{{L}}]+', ' ', 'g'), ' ') AS t FROM {source}
    WHERE length(text) BETWEEN 1 AND 2000),
counted_words AS (SELECT doc_id, {counts} FROM scored), shares AS ({rows}),
shown AS (SELECT doc_id, string_agg(emotion || '=' || CAST(round(score * 100000) AS BIGINT), ' '
  ORDER BY emotion) AS probabilities FROM shares GROUP BY doc_id)"""


def shown_scores():
    """Scores as text, in hundred-thousandths."""
    return F.array_join(F.transform(F.array_sort(F.map_entries("probabilities")), lambda e: F.concat(
        e["key"], F.lit("="), F.round(e["value"] * 100000).cast("long").cast("string"))), " ")


def _scored(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", heavy=True).select("doc_id", "text")
    return models.score_emotions(docs, "text", lexicon=WORDS)


@query(f"""WITH {scores_sql()}
  SELECT d.doc_id, CASE WHEN w.doc_id IS NULL THEN 'error' ELSE 'ok' END AS status, w.probabilities
  FROM documents d LEFT JOIN shown w USING (doc_id)""")
def emotion_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", "status", shown_scores().alias("probabilities"))


def shares_of_letters(texts):
    """A scorer from outside Spark."""
    def share(text, letters):
        return sum(text.count(x) for x in letters) / len(text)
    return [[{"label": "vowels", "score": share(t, "aeiou")}, {"label": "blank", "score": share(t, " ")}]
            for t in texts]


@query("""WITH shares AS (SELECT doc_id, length(text) AS n,
    length(text) - length(regexp_replace(text, '[aeiou]', '', 'g')) AS vowels,
    length(text) - length(replace(text, ' ', '')) AS blank FROM documents)
SELECT doc_id, CASE WHEN n BETWEEN 1 AND 2000 THEN 'ok' ELSE 'error' END AS status,
  CASE WHEN n BETWEEN 1 AND 2000 THEN CAST(vowels AS DOUBLE) / n END AS vowels,
  CASE WHEN n BETWEEN 1 AND 2000 THEN CAST(blank AS DOUBLE) / n END AS blank FROM shares""")
def emotion_scores_by_model(spark, sf_dir):
    """A Python scorer over all documents; refused texts never reach it."""
    docs = table(spark, sf_dir, "documents", heavy=True).select("doc_id", "text")
    scored = models.score_emotions(docs, "text", lambda: shares_of_letters)
    return scored.select("doc_id", "status", *[
        F.element_at("probabilities", k).alias(k) for k in ("vowels", "blank")])


@query(f"""WITH {scores_sql()} SELECT doc_id,
    row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, emotion) AS place, emotion,
    CAST(floor(score * 100 + 0.5::DOUBLE) AS BIGINT) AS percent FROM shares
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, emotion) <= 3""")
def top_emotions_of_texts(spark, sf_dir):
    top = F.posexplode(top_emotions(F.col("probabilities"))).alias("place", "t")
    return _scored(spark, sf_dir).filter("status = 'ok'").select("doc_id", top).select(
        "doc_id", (F.col("place") + 1).alias("place"), "t.emotion",
        as_percent(F.col("t.score")).alias("percent"))


@query(f"""WITH turns AS (SELECT conv_id, role, CAST(sum(length(text)) AS DOUBLE) AS score
  FROM conversations GROUP BY conv_id, role)
  SELECT conv_id, role AS label, score FROM turns""")
def label_scores(spark, sf_dir):
    """Label/score items of each conversation as a map, and back to rows."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(
        F.sum(F.length("text")).cast("double").alias("score"))
    # at most one item per role
    items = turns.groupBy("conv_id").agg(
        F.collect_list(F.struct(F.col("role").alias("label"), "score")).alias("items"))
    return items.select("conv_id", F.explode(from_label_scores(F.col("items"))).alias("label", "score"))
