"""SQL fragments shared by the oracle queries (DuckDB dialect)."""

from newsmill.functions.text import CORPUS_EMOJI, PAGE_EMOJI, WHITESPACE

WS_CLASS = WHITESPACE.replace("\n", r"\n").replace("\t", r"\t")


def strip(x: str) -> str:
    return f"trim({x}, '{WHITESPACE}')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{WS_CLASS}]+'), lambda w: w <> '')"


def corpus_emoji(x: str) -> str:
    return f"regexp_replace({x}, '[{CORPUS_EMOJI}]+', '', 'g')"


def page_emoji(x: str) -> str:
    return f"regexp_replace({x}, '[{PAGE_EMOJI}]+', '', 'g')"


def sentences(x: str) -> str:
    marked = f"replace(replace(replace({x}, '! ', '!|'), '? ', '?|'), '. ', '.|')"
    return (f"list_filter(list_transform(string_split({marked}, '|'), lambda s: {strip('s')}), "
            f"lambda s: s <> '')")


def clean_lines(x: str) -> str:
    lines = f"list_transform(string_split({page_emoji(x)}, chr(10)), lambda s: {strip('s')})"
    kept = f"list_filter({lines}, lambda s: length(s) > 30)"
    return strip(f"array_to_string({kept}, chr(10))")


def max_len(n: str) -> str:
    return f"least(128, greatest(30, CAST(floor({n} * 0.15::DOUBLE) AS BIGINT)))"


def min_len(n: str) -> str:
    return f"greatest(10, CAST(floor({max_len(n)} * 0.4::DOUBLE) AS BIGINT))"


ARTICLES = """articles AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, text AS article,
         string_split(text, chr(10))[1] AS highlights, lang AS split FROM documents)"""


def cleaned(source: str = "articles", within: str = "", name: str = "cleaned") -> str:
    by = f"{within}, " if within else ""
    return f"""{name}_text AS (
  SELECT * REPLACE ({corpus_emoji('article')} AS article, {corpus_emoji('highlights')} AS highlights)
  FROM {source}),
{name}_full AS (
  SELECT * FROM {name}_text WHERE article IS NOT NULL AND highlights IS NOT NULL
  AND article <> '' AND highlights <> ''),
{name}_ids AS (
  SELECT * FROM {name}_full QUALIFY row_number() OVER (PARTITION BY {by}id ORDER BY doc_id) = 1),
{name}_pairs AS (
  SELECT * FROM {name}_ids
  QUALIFY row_number() OVER (PARTITION BY {by}article, highlights ORDER BY doc_id) = 1),
{name} AS (
  SELECT * FROM {name}_pairs
  WHERE length(article) > 50 AND length(highlights) < length(article))"""


# a conversation's answer scored against the question before it
PAIRS = """pairs AS (
  SELECT r.conv_id, r.turn, p.text AS prediction, r.text AS reference,
         CASE WHEN p.text IS NULL THEN 'missing' ELSE 'ok' END AS status
  FROM conversations r LEFT JOIN conversations p
    ON p.conv_id = r.conv_id AND p.turn = r.turn + 1 AND p.role = 'assistant'
  WHERE r.role = 'user')"""


def rouge_tokens(x: str) -> str:
    return (f"list_filter(string_split(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'), ' '), "
            f"lambda t: t <> '')")
