"""Text queries: line and title cleaning, sentences, tokens, budgets, guards."""

from pyspark.sql import functions as F

from newsmill.functions import guards, text
from newsmill.functions.emotions import top_emotions
from newsmill.plans import sql
from newsmill.plans.articles import articles, table
from newsmill.plans.registry import query

EMOJI = "☀️⚽日"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents", heavy=True)


@query(f"SELECT doc_id, {sql.clean_lines(f"text || '{EMOJI}'")} AS text FROM documents")
def clean_lines(spark, sf_dir):
    return _docs(spark, sf_dir).select(
        "doc_id", text.clean_lines(F.concat("text", F.lit(EMOJI))).alias("text"))


@query(f"""WITH {sql.ARTICLES} SELECT doc_id,
  {sql.strip(sql.page_emoji(f"'{EMOJI} ' || highlights || ' {EMOJI}'"))} AS title FROM articles""")
def clean_title(spark, sf_dir):
    padded = F.concat(F.lit(f"{EMOJI} "), "highlights", F.lit(f" {EMOJI}"))
    return articles(spark, sf_dir).select("doc_id", text.clean_title(padded).alias("title"))


@query(f"""SELECT doc_id, CAST(n - 1 AS BIGINT) AS n, s[n] AS sentence FROM (
  SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS n FROM (
    SELECT doc_id, {sql.sentences('text')} AS s FROM documents))""")
def sentences(spark, sf_dir):
    return _docs(spark, sf_dir).select(
        "doc_id", F.posexplode(text.sentences(F.col("text"))).alias("n", "sentence"))


@query("""SELECT doc_id, CAST(n - 1 AS BIGINT) AS n, s[n] AS paragraph FROM (
  SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS n FROM (
    SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))""")
def paragraphs(spark, sf_dir):
    return _docs(spark, sf_dir).select(
        "doc_id", F.posexplode(text.paragraphs(F.col("text"))).alias("n", "paragraph"))


TOKENS = f"tokens AS (SELECT doc_id, len({sql.words('text')}) + 2 AS n_tokens FROM documents)"


@query(f"""WITH {TOKENS} SELECT doc_id, n_tokens, n_tokens - 2 AS n_plain,
  {sql.min_len('n_tokens')} AS min_len, {sql.max_len('n_tokens')} AS max_len,
  CASE WHEN n_tokens <= 1024 THEN 'direct' ELSE 'chunked' END AS route FROM tokens""")
def token_budgets(spark, sf_dir):
    counted = _docs(spark, sf_dir).select(
        "doc_id", text.count_tokens(F.col("text")).alias("n_tokens"),
        text.count_tokens(F.col("text"), special=0).alias("n_plain"))
    n = F.col("n_tokens")
    return counted.withColumn("b", text.summary_budget(n)).select(
        "doc_id", "n_tokens", "n_plain", "b.min_len", "b.max_len", text.route(n).alias("route"))


@query(f"""WITH {sql.ARTICLES}, sized AS (SELECT doc_id, len({sql.words('highlights')}) AS got,
  len({sql.words('article')}) AS base FROM articles)
  SELECT doc_id, least(5, CAST(floor(base * 0.1::DOUBLE) AS BIGINT)) < got
     AND got < greatest(150, CAST(floor(base * 0.5::DOUBLE) AS BIGINT)) AS plausible FROM sized""")
def summary_length_check(spark, sf_dir):
    return articles(spark, sf_dir).select("doc_id", text.plausible_summary_length(
        F.col("highlights"), F.col("article")).alias("plausible"))


# every address in the given form and in forms that browsers accept or refuse
URL_FORMS = ("{}", "  {}  ", "ftp{}", "http:///", "http://?{}", "x {}", "https:host/{}", "http://a b/{}")
FORMS_SQL = " UNION ALL ".join(
    f"SELECT page_id, CAST({i} AS BIGINT) AS form, "
    f"replace('{form}', '{{}}', url) AS url FROM pages" for i, form in enumerate(URL_FORMS))


# the given addresses are well-formed; so are they between spaces, and a host without slashes
# after the scheme, while the others have another scheme, no host, or a space inside
@query(f"SELECT page_id, form, url, form IN (0, 1, 6) AS valid FROM ({FORMS_SQL})")
def url_check(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    forms = F.array(*[F.replace(F.lit(form), F.lit("{}"), F.col("url")) for form in URL_FORMS])
    rows = pages.select("page_id", F.posexplode(forms).alias("form", "url"))
    return rows.withColumn("valid", guards.is_web_url(F.col("url")))


@query("""SELECT doc_id, CASE WHEN length(text) = 0 OR length(text) > 2000 THEN 'error' ELSE 'ok' END
    AS status,
  CASE WHEN length(text) = 0 THEN 'Text cannot be empty.' WHEN length(text) > 2000 THEN
    'Text is too long (' || length(text) ||
    ' characters). Maximum allowed size is 2000 characters.' END AS detail FROM documents""")
def scoring_guard(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", guards.scoring_guard(F.col("text")).alias("g"))
    return rows.select("doc_id", "g.status", "g.detail")


@query(f"""WITH rows AS (SELECT doc_id, text, string_split(text, chr(10))[2] AS title FROM documents)
  SELECT doc_id, CASE WHEN title IS NULL THEN 'missing' ELSE 'ok' END AS extraction,
  CASE WHEN title IS NULL OR {sql.strip('title')} = '' THEN 'invalid' ELSE 'ok' END AS summary,
  CASE WHEN title IS NULL OR {sql.strip('title')} = '' THEN '' ELSE title END AS offered FROM rows""")
def contracts(spark, sf_dir):
    """Extraction contract, summary contract and blank guard; the second line is the title."""
    title = F.get(F.split("text", "\n"), F.lit(1))
    rows = _docs(spark, sf_dir).select("doc_id", "text", title.alias("title"))
    t = F.col("title")
    return rows.select(
        "doc_id", guards.extraction_guard(t, F.col("text")).alias("extraction"),
        guards.summary_guard(t).alias("summary"), guards.blank_to_empty(t, t).alias("offered"))


@query("""WITH shares AS (SELECT user_id, event_type AS emotion,
    CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY user_id) AS score
  FROM events GROUP BY user_id, event_type)
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, emotion) AS place,
    emotion, CAST(floor(score * 100 + 0.5::DOUBLE) AS BIGINT) AS percent FROM shares
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, emotion) <= 3""")
def top_labels(spark, sf_dir):
    """The three commonest event types of each user, as a label distribution."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(
        F.count(F.lit(1)).alias("n"))
    # a user has one row per event type here, so the map is bounded by the number of types
    maps = counts.groupBy("user_id").agg(
        F.sum("n").alias("total"),
        F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    scores = F.transform_values("m", lambda _, n: n / F.col("total"))
    top = maps.select("user_id", F.posexplode(top_emotions(scores)).alias("place", "t"))
    return top.select("user_id", (F.col("place") + 1).alias("place"), "t.emotion",
                      text.as_percent(F.col("t.score")).alias("percent"))
