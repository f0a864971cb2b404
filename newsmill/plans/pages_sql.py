"""Pages read and searched in DuckDB SQL, apart from the engine's own way of doing it.

Markup is cut into tags and strings by a pattern, a fold over these keeps the open elements, and
ancestors come from a recursive query. It rests on what the given pages are like: no comments or
scripts around text, no markup in attributes, few character references, and no two elements with
elements two levels below them that are equal. Its bounds are written here once more: 200 characters
of an article, 150 of a region for each paragraph, 7 and 4 regions of the first method, 6 of others.
"""

from newsmill.plans import sql


def decoded(x):
    """The character references that occur in the given pages."""
    plain = f"replace(replace(replace({x}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·')"
    return f"regexp_replace({plain}, '&amp;?', '&', 'g')"


_STATE = ("STRUCT(token VARCHAR, held STRUCT(tag VARCHAR, pos BIGINT)[], "
          "nodes STRUCT(tag VARCHAR, parent BIGINT)[], runs STRUCT(holder BIGINT, run VARCHAR)[])")
_NAME = "lower(regexp_extract(x.token, '^</?([a-zA-Z0-9]+)', 1))"
_TOP = "CASE WHEN len(acc.held) = 0 THEN -1 ELSE acc.held[len(acc.held)].pos END"
_OPEN = f"list_transform(acc.held, lambda h: h.tag)"
_VOID = "('area', 'base', 'br', 'col', 'embed', 'hr', 'img', 'input', 'link', 'meta', 'param', 'source', 'track', 'wbr')"
_STEP = f"""CASE
  WHEN x.token[1:2] = '</' AND list_contains({_OPEN}, {_NAME}) THEN {{'token': '',
    'held': acc.held[1:len(acc.held) - list_position(list_reverse({_OPEN}), {_NAME})],
    'nodes': acc.nodes, 'runs': acc.runs}}
  WHEN x.token[1:2] = '</' THEN acc
  WHEN x.token[1] = '<' THEN {{'token': '',
    'held': CASE WHEN {_NAME} IN {_VOID} THEN acc.held
      ELSE list_append(acc.held, {{'tag': {_NAME}, 'pos': len(acc.nodes)}}) END,
    'nodes': list_append(acc.nodes, {{'tag': {_NAME}, 'parent': {_TOP}}}), 'runs': acc.runs}}
  ELSE {{'token': '', 'held': acc.held, 'nodes': acc.nodes,
    'runs': list_append(acc.runs, {{'holder': {_TOP}, 'run': x.token}})}} END"""
_EMPTY = f"CAST({{'token': '', 'held': [], 'nodes': [], 'runs': []}} AS {_STATE})"


def read(source):
    """nodes (page_id, pos, tag, parent), runs (page_id, k, holder, run), above (page_id, pos, up:
    every ancestor and the element itself) of a table (page_id, url, html)."""
    bare = ("regexp_replace(regexp_replace(html, '(?s)<!.*?>', '', 'g'), "
            "'(?s)<(script|style)>.*?</(script|style)>', '<\\1></\\1>', 'g')")
    return f"""marked AS (SELECT page_id, url, list_reduce(list_transform(
    regexp_extract_all({bare}, '<[^>]*>|[^<]+'),
    lambda t: CAST({{'token': t, 'held': [], 'nodes': [], 'runs': []}} AS {_STATE})),
    lambda acc, x: {_STEP}, {_EMPTY}) AS state FROM {source}),
nodes AS (SELECT page_id, i - 1 AS pos, n.tag AS tag, n.parent AS parent FROM (
  SELECT page_id, unnest(state.nodes) AS n, unnest(range(1, len(state.nodes) + 1)) AS i FROM marked)),
runs AS (SELECT page_id, k, holder, CASE WHEN trim(run, ' \n\t') <> '' THEN {decoded('run')}
    WHEN contains(run, chr(10)) THEN chr(10) ELSE ' ' END AS run FROM (
  SELECT page_id, r.holder AS holder, r.run AS run, k FROM (SELECT page_id,
    unnest(state.runs) AS r, unnest(range(1, len(state.runs) + 1)) AS k FROM marked))),
above AS (SELECT page_id, pos, pos AS up FROM nodes UNION ALL
  SELECT a.page_id, a.pos, n.parent FROM above a JOIN nodes n ON n.page_id = a.page_id AND n.pos = a.up
  WHERE n.parent >= 0),
places AS (SELECT n.*, CASE WHEN n.parent = -1 THEN -2 WHEN u.parent = -1 THEN -1 ELSE u.parent END
    AS region FROM nodes n LEFT JOIN nodes u ON u.page_id = n.page_id AND u.pos = n.parent)"""


NODES = f"""WITH RECURSIVE {read('pages')}
SELECT n.page_id, n.pos, n.parent AS parent_pos, n.region AS grandparent_pos, n.tag,
  coalesce(string_agg(r.run, '' ORDER BY r.k), '') AS own_text
FROM places n LEFT JOIN runs r ON r.page_id = n.page_id AND r.holder = n.pos GROUP BY ALL"""


def _ranking(name, tags):
    """Regions above elements of these names: place j by count, then by the first element."""
    return f"""{name}_tally AS (SELECT page_id, region, count(*) AS cnt, min(pos) AS first
  FROM places WHERE tag IN ({tags}) GROUP BY ALL),
{name} AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY cnt DESC, first) - 1 AS j
  FROM {name}_tally)"""


def _tries(name, ranking, first, last, excluded="NULL"):
    """Regions in the order they are tried; beyond the ranking, or from above the page on, the
    whole page with a count of one."""
    return f"""{name}_left AS (SELECT r.page_id, r.region, r.cnt, row_number() OVER (
    PARTITION BY r.page_id ORDER BY r.j) - 1 AS j FROM {ranking} r {excluded}),
{name}_end AS (SELECT page_id, coalesce(min(CASE WHEN region = -2 THEN j END), count(*)) AS stop
  FROM {name}_left GROUP BY page_id),
{name} AS (SELECT p.page_id, {first} + t.j AS j, CASE WHEN t.j < coalesce(e.stop, 0) THEN r.region
    ELSE -1 END AS region, CASE WHEN t.j < coalesce(e.stop, 0) THEN r.cnt ELSE 1 END AS cnt
  FROM (SELECT page_id FROM marked) p CROSS JOIN range({last - first + 1}) t(j)
  LEFT JOIN {name}_end e ON e.page_id = p.page_id
  LEFT JOIN {name}_left r ON r.page_id = p.page_id AND r.j = t.j)"""


def extracted(source):
    """``articles`` (page_id, link, status, branch, attempt, title, text) of pages, all with a
    heading: the <article> if its text is long enough, or the first region dense enough."""
    last = 6
    return f"""{read(source)},
heads AS (SELECT page_id, min(pos) AS pos FROM nodes WHERE tag = 'h1' GROUP BY page_id),
bodies AS (SELECT page_id, min(pos) AS pos FROM nodes WHERE tag = 'article' GROUP BY page_id),
inner_runs AS (SELECT r.page_id, a.up AS pos, r.k, r.run FROM runs r
  JOIN above a ON a.page_id = r.page_id AND a.pos = r.holder),
headings AS (SELECT page_id, string_agg(run, '' ORDER BY k) AS heading FROM heads
  JOIN inner_runs USING (page_id, pos) GROUP BY page_id),
direct AS (SELECT page_id, string_agg({sql.strip('run')}, chr(10) ORDER BY k) AS body FROM bodies
  JOIN inner_runs USING (page_id, pos) WHERE {sql.strip('run')} <> '' GROUP BY page_id),
paragraphs AS (SELECT n.page_id, n.pos, {sql.strip("coalesce(string_agg(i.run, '' ORDER BY i.k), '')")}
    AS text FROM nodes n LEFT JOIN inner_runs i USING (page_id, pos) WHERE n.tag = 'p' GROUP BY ALL),
pieces AS (
  SELECT a.page_id, a.up AS region, p.pos AS place, ' ' || p.text || ' ' || chr(10) AS piece, 1 AS kind
  FROM paragraphs p JOIN above a ON a.page_id = p.page_id AND a.pos = p.pos AND a.up <> a.pos
  UNION ALL SELECT page_id, -1, pos, ' ' || text || ' ' || chr(10), 1 FROM paragraphs
  UNION ALL SELECT page_id, pos, k, {sql.strip('run')} || chr(10), 2 FROM inner_runs
    WHERE {sql.strip('run')} <> ''
  UNION ALL SELECT page_id, -1, k, {sql.strip('run')} || chr(10), 2 FROM runs
    WHERE {sql.strip('run')} <> ''),
regions AS (SELECT page_id, region, arg_min(whole, kind) AS whole FROM (
  SELECT page_id, region, kind, string_agg(piece, '' ORDER BY place) AS whole FROM pieces GROUP BY ALL)
  GROUP BY ALL),
{_ranking('by_p', "'p'")}, {_ranking('by_all', "'p', 'span', 'article'")},
{_tries('firsts', 'by_p', 0, last, '')},
{_tries('seconds', 'by_all', 7, 10,
        f'JOIN firsts f ON f.page_id = r.page_id AND f.j = {last} AND f.region <> r.region')},
tried AS (SELECT t.page_id, t.j, r.whole FROM (SELECT * FROM firsts UNION ALL SELECT * FROM seconds) t
  JOIN regions r USING (page_id, region) WHERE length(r.whole) / t.cnt >= 150),
chosen AS (SELECT page_id, min(j) AS attempt, arg_min(whole, j) AS whole FROM tried GROUP BY page_id),
articles AS (SELECT m.page_id, m.url AS link,
    CASE WHEN length(d.body) > 200 OR c.page_id IS NOT NULL THEN 'ok'
      ELSE 'Not enough words.' END AS status,
    CASE WHEN length(d.body) > 200 THEN 'article'
      WHEN c.page_id IS NOT NULL THEN 'region' END AS branch,
    CASE WHEN coalesce(length(d.body), 0) <= 200 THEN c.attempt END AS attempt,
    CASE WHEN length(d.body) > 200 THEN {sql.clean_lines('h.heading')}
      WHEN c.page_id IS NOT NULL THEN {sql.strip(sql.page_emoji('h.heading'))} END AS title,
    CASE WHEN length(d.body) > 200 THEN {sql.clean_lines('d.body')}
      WHEN c.page_id IS NOT NULL THEN {sql.clean_lines('c.whole')} END AS text
  FROM marked m LEFT JOIN headings h USING (page_id) LEFT JOIN direct d USING (page_id)
  LEFT JOIN chosen c USING (page_id))"""


ARTICLES = f"WITH RECURSIVE {extracted('pages')} SELECT * FROM articles"
ARTICLES_BY_REGION = f"""WITH RECURSIVE plain AS (SELECT page_id, url,
  regexp_replace(html, '(</?)article', '\\1div', 'g') AS html FROM pages),
{extracted('plain')} SELECT * FROM articles"""
REGIONS = f"""WITH RECURSIVE {read('pages')}, {_ranking('by_p', "'p'")}
SELECT page_id, region, cnt FROM by_p WHERE j = 0"""
# the later methods try fewer regions, and only the last one counts when all fail
CASCADE = f"""WITH RECURSIVE {extracted('pages')},
methods AS (SELECT *, coalesce(attempt, 0) < 6 AS early,
  NOT starts_with(link, 'https://') AS by_first, NOT contains(link, '?') AS by_second FROM articles),
won AS (SELECT *, CASE WHEN status = 'ok' AND by_first THEN 'REQUESTS'
    WHEN status = 'ok' AND early AND by_second THEN 'CLOUDSCRAPER'
    WHEN status = 'ok' AND early THEN 'SELENIUM' END AS method FROM methods)
SELECT link, CASE WHEN method IS NULL THEN 'error' ELSE 'ok' END AS status, method,
  CASE WHEN method IS NOT NULL THEN title END AS title,
  CASE WHEN method IS NOT NULL THEN text END AS text,
  CASE WHEN method IS NULL THEN 'Not enough words.' END AS detail FROM won"""
