"""Corpus queries: cleaning, dedup, splits, checks."""

from pyspark.sql import functions as F

from newsmill.operators import clean, expect, expect_state
from newsmill.plans import sql
from newsmill.plans.articles import articles, table
from newsmill.plans.registry import query
from newsmill.session import scratch, stored
from newsmill.sources import corpus, results

EMOJI = "😀日🤖☀️"  # the given texts hold none, so the emoji queries append some

BUCKETS = 16


@query(f"WITH {sql.ARTICLES}, {sql.cleaned()} SELECT doc_id, id, article, highlights, split FROM cleaned")
def clean_articles(spark, sf_dir):
    return clean.clean_articles(articles(spark, sf_dir), "doc_id")


@query(f"WITH {sql.ARTICLES}, {sql.cleaned(within='split')} "
       "SELECT doc_id, id, article, highlights, split FROM cleaned")
def clean_articles_by_split(spark, sf_dir):
    return clean.clean_articles(articles(spark, sf_dir), "doc_id", ["split"])


def _sha_articles(spark, sf_dir):
    """Articles whose id is a digest of the text, so that copies share an id."""
    return articles(spark, sf_dir).withColumn("id", F.sha1("article"))


SHA_ARTICLES = sql.ARTICLES + ", sha_articles AS (SELECT * REPLACE (sha1(article) AS id) FROM articles)"


@query(f"WITH {SHA_ARTICLES}, {sql.cleaned('sha_articles')} SELECT doc_id, id, article, highlights FROM cleaned")
def clean_articles_step_by_step(spark, sf_dir):
    return clean.clean_articles_wide(_sha_articles(spark, sf_dir), "doc_id").select(
        "doc_id", "id", "article", "highlights")


@query(f"WITH {sql.ARTICLES}, {sql.cleaned()} SELECT doc_id, id, article, highlights, split FROM cleaned")
def clean_articles_in_stages(spark, sf_dir):
    """Narrow tables stored; few dropped rows, so no article is shuffled."""
    return clean.clean_articles_stored(articles(spark, sf_dir), "doc_id")


@query(f"WITH {sql.ARTICLES}, {sql.cleaned()} SELECT doc_id, id, article, highlights, split FROM cleaned")
def clean_articles_bucketed(spark, sf_dir):
    """Articles stored in buckets by row key; the survivors come to them without moving a text."""
    stored_rows = clean.bucketed(articles(spark, sf_dir), "doc_id", BUCKETS, "articles")
    return clean.clean_articles_bucketed(stored_rows, "doc_id", BUCKETS)


@query(f"""SELECT doc_id, {sql.corpus_emoji(f"text || '{EMOJI}'")} AS article,
       {sql.corpus_emoji(f"'{EMOJI}' || lang")} AS highlights FROM documents""")
def remove_corpus_emoji(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat("text", F.lit(EMOJI)).alias("article"),
        F.concat(F.lit(EMOJI), "lang").alias("highlights"))
    return clean.remove_emoji(docs)


@query(f"SELECT doc_id, {sql.page_emoji(f"text || '{EMOJI}'")} AS text FROM documents")
def remove_page_emoji(spark, sf_dir):
    from newsmill.functions.text import strip_page_emoji
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", strip_page_emoji(F.concat("text", F.lit(EMOJI))).alias("text"))


@query("""WITH rows AS (SELECT doc_id, text AS article, string_split(text, chr(10))[2] AS highlights
  FROM documents) SELECT * FROM rows WHERE article IS NOT NULL AND highlights IS NOT NULL
  AND article <> '' AND highlights <> ''""")
def drop_missing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("article"),
        F.get(F.split("text", "\n"), F.lit(1)).alias("highlights"))
    return clean.drop_missing(docs)


@query(f"WITH {sql.ARTICLES} SELECT doc_id, article FROM articles WHERE length(article) > 50")
def drop_short(spark, sf_dir):
    return clean.drop_short(articles(spark, sf_dir)).select("doc_id", "article")


@query(f"""WITH {sql.ARTICLES} SELECT doc_id, highlights FROM articles
  WHERE length(highlights) < length(article)""")
def drop_long_highlights(spark, sf_dir):
    return clean.drop_long_highlights(articles(spark, sf_dir)).select("doc_id", "highlights")


@query("""SELECT conv_id, turn, CAST(conv_id AS VARCHAR) AS id, text FROM conversations
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1""")
def dedup_ids(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumns({
        "id": F.col("conv_id").cast("string"), "at": F.struct("conv_id", "turn")})
    return clean.dedup_ids(turns, "at").select("conv_id", "turn", "id", "text")


@query("""SELECT event_id, event_type AS id, user_id, value FROM events
  QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) = 1""")
def dedup_hot_ids(spark, sf_dir):
    """Few ids, each holding a large share of the table."""
    events = table(spark, sf_dir, "events").withColumn("id", F.col("event_type"))
    return clean.dedup_ids(events, "event_id").select("event_id", "id", "user_id", "value")


@query(f"""WITH {sql.ARTICLES} SELECT doc_id, article, highlights FROM articles
  QUALIFY row_number() OVER (PARTITION BY article, highlights ORDER BY doc_id) = 1""")
def dedup_pairs(spark, sf_dir):
    return clean.dedup_pairs(articles(spark, sf_dir), "doc_id").select(
        "doc_id", "article", "highlights")


@query("""SELECT doc_id, text FROM documents
  WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def keep_rows(spark, sf_dir):
    good = table(spark, sf_dir, "labels").filter("quality = 1")
    return clean.keep_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), good, "doc_id")


@query(f"WITH {sql.ARTICLES} SELECT id, article, highlights, split FROM articles")
def split_round_trip(spark, sf_dir):
    """Write one folder per split, then load the named splits as one table."""
    rows, path = articles(spark, sf_dir).drop("doc_id"), scratch(spark, "splits")
    corpus.write_splits(rows, path)
    names = [r["split"] for r in rows.select("split").distinct().collect()]
    return corpus.load_splits(spark, {n: f"{path}/split={n}" for n in names})


@query("""SELECT doc_id, lang, text FROM documents ORDER BY doc_id LIMIT 1000""")
def first_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return corpus.first_rows(docs, 1000).select("doc_id", "lang", "text")


@query("""SELECT doc_id, lang, text FROM documents
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 1000""")
def first_rows_by_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return corpus.first_rows(docs, 1000, "lang").select("doc_id", "lang", "text")


@query("""SELECT lang, text IS NOT NULL AND source IS NOT NULL AND n_chars IS NOT NULL AS complete
  FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) = 1""")
def first_row_complete(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return corpus.first_row_complete(docs, ["text", "source", "n_chars"], "lang")


def _assets(spark, sf_dir):
    """The raw and the cleaned table, every split of each a data set of its own."""
    raw = _sha_articles(spark, sf_dir)
    return corpus.register_assets({
        "raw": raw, "clean": stored(clean.clean_articles(raw, "doc_id", ["split"]), "clean")})


def _check_sql(no, check):
    cols = check.columns
    keys = ", ".join(cols)
    none = " AND ".join(f"{c} IS NULL" for c in cols)
    missing, bad = "0", "0"
    if check.kind == expect.NOT_NULL:
        bad = f"sum(CASE WHEN {none} THEN 1 ELSE 0 END)"
    elif check.kind == expect.MIN_LENGTH:
        missing = f"sum(CASE WHEN {none} THEN 1 ELSE 0 END)"
        bad = f"sum(CASE WHEN length({cols[0]}) < {check.min_value} THEN 1 ELSE 0 END)"
    elif check.kind == expect.PAIR:
        missing = f"sum(CASE WHEN {none} THEN 1 ELSE 0 END)"
        bad = (f"sum(CASE WHEN NOT ({none}) AND "
               f"NOT coalesce(length({cols[0]}) < length({cols[1]}), false) THEN 1 ELSE 0 END)")
    elif check.kind in (expect.UNIQUE, expect.COMPOUND_UNIQUE):
        missing = f"sum(CASE WHEN {none} THEN 1 ELSE 0 END)"
        bad = f"sum(CASE WHEN NOT ({none}) AND n{no} > 1 THEN 1 ELSE 0 END)"
    size = (f", count(*) OVER (PARTITION BY dataset, {keys}) AS n{no}" if "unique" in check.kind else "")
    return f"""SELECT dataset, CAST({no} AS BIGINT) AS check_no, '{check.name}' AS expectation,
  '{check.target}' AS "column", 'critical' AS severity, count(*) AS element_count,
  CAST({missing} AS BIGINT) AS missing_count, CAST({bad} AS BIGINT) AS unexpected_count
  FROM (SELECT *{size} FROM assets) GROUP BY dataset"""


CHECKS = " UNION ALL ".join(_check_sql(i, c) for i, c in enumerate(expect.ARTICLE_SUITE))
RESULTS = f"""{SHA_ARTICLES}, {sql.cleaned('sha_articles', within='split')},
assets AS (SELECT 'raw_' || split AS dataset, id, article, highlights FROM sha_articles
  UNION ALL SELECT 'clean_' || split, id, article, highlights FROM cleaned),
counted AS ({CHECKS}),
results AS (SELECT *, CASE WHEN element_count > missing_count
    THEN round(100.0 * unexpected_count / (element_count - missing_count), 6) ELSE 0.0 END
    AS unexpected_percent, unexpected_count = 0 AS success FROM counted)"""


@query(f"WITH {RESULTS} SELECT * FROM results")
def validation(spark, sf_dir):
    found = expect.evaluate(_assets(spark, sf_dir), by="split")
    return found.withColumn("unexpected_percent", F.round("unexpected_percent", 6))


@query(f"WITH {RESULTS} SELECT * FROM results")
def validation_of_appended(spark, sf_dir):
    """The same checks over tables that come in three parts, one of them twice."""
    path, assets = scratch(spark, "checks"), _assets(spark, sf_dir)
    turn = F.pmod(F.xxhash64("id"), F.lit(3))
    for part in (0, 1, 2, 1):
        expect_state.append({n: df.filter(turn == part) for n, df in assets.items()}, path, f"p{part}", by="split")
    found = expect_state.results(spark, path)
    return found.withColumn("unexpected_percent", F.round("unexpected_percent", 6))


LACKING = RESULTS.replace("assets AS (", "all_assets AS (").replace("counted AS (", """assets AS (
  SELECT * FROM all_assets WHERE dataset <> 'clean_fr'),
counted AS (""")


@query(f"""WITH {LACKING}, checks AS (SELECT DISTINCT check_no, expectation, "column" FROM results)
SELECT dataset, check_no, expectation, "column", element_count, unexpected_count, success FROM results
UNION ALL SELECT 'clean_fr', check_no, expectation, "column", 0, 0, true FROM checks""")
def validation_of_emptied(spark, sf_dir):
    """A cleaner that loses a whole split still has that split in its report."""
    assets = _assets(spark, sf_dir)
    assets["clean"] = assets["clean"].filter("split <> 'fr'")
    return expect.evaluate(assets, by="split").select(
        "dataset", "check_no", "expectation", "column", "element_count", "unexpected_count", "success")


@query(f"""WITH {RESULTS} SELECT dataset, count(*) AS evaluated,
  CAST(sum(CASE WHEN success THEN 0 ELSE 1 END) AS BIGINT) AS unsuccessful
  FROM results WHERE dataset = 'raw_en' GROUP BY dataset""")
def validation_first_run(spark, sf_dir):
    """The tally of one data set only."""
    return expect.tally(expect.evaluate(_assets(spark, sf_dir), by="split"), first_only="raw_en")


@query(f"""WITH {RESULTS} SELECT 'first' AS run, dataset, check_no, expectation, "column", element_count,
  missing_count, unexpected_count, success FROM results""")
def validation_saved(spark, sf_dir):
    """Results stored twice under one run name, and read back."""
    path = scratch(spark, "results")
    found = expect.evaluate(_assets(spark, sf_dir), by="split")
    results.save(found, path, "first")
    results.save(results.load(spark, path).drop("run").transform(lambda df: stored(df, "again")), path, "first")
    return results.load(spark, path).select(
        "run", "dataset", "check_no", "expectation", "column", "element_count", "missing_count",
        "unexpected_count", "success")


@query(f"""WITH {RESULTS} SELECT dataset, count(*) AS evaluated,
  CAST(sum(CASE WHEN success THEN 0 ELSE 1 END) AS BIGINT) AS unsuccessful
  FROM results GROUP BY dataset""")
def validation_tally(spark, sf_dir):
    return expect.tally(expect.evaluate(_assets(spark, sf_dir), by="split"))


@query(f"""WITH {SHA_ARTICLES} SELECT doc_id, highlights FROM sha_articles
  WHERE length(highlights) < 10 ORDER BY doc_id LIMIT 20""")
def unexpected_sample(spark, sf_dir):
    check = expect.Check(expect.MIN_LENGTH, ("highlights",), min_value=10)
    return expect.unexpected_sample(_sha_articles(spark, sf_dir), check, "doc_id").select(
        "doc_id", "highlights")


@query(f"""WITH {SHA_ARTICLES} SELECT doc_id, id FROM sha_articles
  QUALIFY count(*) OVER (PARTITION BY id) > 1""")
def duplicate_rows(spark, sf_dir):
    check = expect.Check(expect.UNIQUE, ("id",))
    rows = _sha_articles(spark, sf_dir).select("doc_id", "id")
    return expect.unexpected_rows(rows, check, "doc_id")
