"""ROUGE queries: an assistant's turn is the prediction, the user's turn before it the reference."""

from pyspark.sql import functions as F

from newsmill.operators import rouge
from newsmill.plans import sql, stem_sql
from newsmill.plans.articles import table
from newsmill.plans.registry import query

KEY = ["conv_id", "turn"]


def _pairs(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    predictions = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("prediction"))
    references = turns.filter("role = 'user'").select(
        "conv_id", "turn", F.col("text").alias("reference"))
    return rouge.pair_up(predictions, references, KEY)


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"WITH {sql.PAIRS} SELECT * FROM pairs")
def prediction_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


def _ngrams(n, side):
    gram = "t[i]" if n == 1 else " || ' ' || ".join(f"t[i + {k}]" for k in range(n))
    tokens = sql.rouge_tokens(side)
    return f"""(SELECT conv_id, turn, {gram} AS g, count(*) AS c FROM (
      SELECT conv_id, turn, t, unnest(range(1, len(t) - {n - 2})) AS i FROM (
        SELECT conv_id, turn, {tokens} AS t FROM pairs)) GROUP BY ALL)"""


def _rouge_sql(n):
    size = lambda side: f"greatest(len({sql.rouge_tokens(side)}) - {n - 1}, 0)"
    return f"""overlap{n} AS (SELECT p.conv_id, p.turn, sum(least(p.c, r.c)) AS hits
  FROM {_ngrams(n, 'prediction')} p JOIN {_ngrams(n, 'reference')} r USING (conv_id, turn, g)
  GROUP BY ALL),
sides{n} AS (SELECT conv_id, turn, CAST(coalesce(hits, 0) AS DOUBLE) AS hits, {size('prediction')} AS n_p,
    {size('reference')} AS n_r FROM pairs LEFT JOIN overlap{n} USING (conv_id, turn)),
pr{n} AS (SELECT conv_id, turn, CASE WHEN n_p > 0 THEN hits / n_p ELSE 0 END AS p,
    CASE WHEN n_r > 0 THEN hits / n_r ELSE 0 END AS r FROM sides{n}),
rouge{n} AS (SELECT conv_id, turn, p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f
  FROM pr{n})"""


def _rouge_rows(n):
    return f"""WITH {sql.PAIRS}, {_rouge_sql(n)} SELECT conv_id, turn, round(p, 6) AS rouge{n}_p,
  round(r, 6) AS rouge{n}_r, round(f, 6) AS rouge{n}_f FROM rouge{n}"""


@query(_rouge_rows(1))
def rouge_1(spark, sf_dir):
    return _rounded(rouge.rouge_n(_pairs(spark, sf_dir), KEY, 1))


@query(_rouge_rows(2))
def rouge_2(spark, sf_dir):
    return _rounded(rouge.rouge_n(_pairs(spark, sf_dir), KEY, 2))


@query(f"""WITH {sql.PAIRS}, {_rouge_sql(1)}, {_rouge_sql(2)}
  SELECT (SELECT round(avg(f) * 100, 4) FROM rouge1) AS rouge1,
         (SELECT round(avg(f) * 100, 4) FROM rouge2) AS rouge2""")
def mean_rouge_n(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    return rouge.mean_scores({f"rouge{n}": rouge.rouge_n(pairs, KEY, n) for n in (1, 2)})


# a fold over the predicted tokens keeps one row of the length table; inside it, a cell is the
# running maximum of its candidates: the cell above, or its left neighbour plus one on a match
LCS = """list_reduce(list_transform(p, lambda t: {'t': t, 'row': CAST([] AS BIGINT[])}),
  lambda acc, x: {'t': x.t, 'row': list_reduce(
    list_transform(range(1, len(r) + 1), lambda k: [CASE WHEN r[k] = x.t
      THEN (CASE WHEN k = 1 THEN 0 ELSE acc.row[k - 1] END) + 1 ELSE acc.row[k] END]),
    lambda a, b: list_append(a, greatest(a[len(a)], b[1])))},
  {'t': '', 'row': list_transform(r, lambda _: 0::BIGINT)}).row[len(r)]"""
ROUGE_L = f"""sides AS (SELECT conv_id, turn, {sql.rouge_tokens('prediction')} AS p,
    {sql.rouge_tokens('reference')} AS r FROM pairs),
common AS (SELECT conv_id, turn, len(p) AS n_p, len(r) AS n_r,
    CASE WHEN len(p) = 0 OR len(r) = 0 THEN 0 ELSE CAST({LCS} AS DOUBLE) END AS hits FROM sides),
prl AS (SELECT conv_id, turn, CASE WHEN n_p > 0 THEN hits / n_p ELSE 0 END AS p,
    CASE WHEN n_r > 0 THEN hits / n_r ELSE 0 END AS r FROM common)"""


@query(f"""WITH {sql.PAIRS}, {ROUGE_L} SELECT conv_id, turn, round(p, 6) AS "rougeL_p",
  round(r, 6) AS "rougeL_r", round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6)
  AS "rougeL_f" FROM prl""")
def rouge_l(spark, sf_dir):
    return _rounded(rouge.rouge_l(_pairs(spark, sf_dir), KEY))


@query(f"""WITH {sql.PAIRS}, {_rouge_sql(1)}, {_rouge_sql(2)}, {ROUGE_L},
means AS (SELECT round(avg(a.f) * 100, 4) AS rouge1, round(avg(b.f) * 100, 4) AS rouge2,
    round(avg(CASE WHEN l.p + l.r > 0 THEN 2 * l.p * l.r / (l.p + l.r) ELSE 0 END) * 100, 4) AS "rougeL"
  FROM pairs JOIN rouge1 a USING (conv_id, turn) JOIN rouge2 b USING (conv_id, turn)
  JOIN prl l USING (conv_id, turn) WHERE status = 'ok')
SELECT rouge1, rouge2, "rougeL", (SELECT count(*) FROM pairs) AS pairs,
  (SELECT count(*) FROM pairs WHERE status = 'missing') AS missing FROM means""")
def corpus_rouge_unstemmed(spark, sf_dir):
    """The means without stemming, over pairs that have a prediction."""
    return rouge.corpus_scores(_pairs(spark, sf_dir), KEY, stemmed=False).drop("rougeLsum")


# weights of a resampled corpus: the key's hash on a line whose factor and shift are hashes too
RESAMPLED = """lines AS (SELECT b,
    1 + ('0x' || left(md5('0:factor ' || b), 15))::BIGINT % 2147483646 AS factor,
    ('0x' || left(md5('0:shift ' || b), 15))::BIGINT % 2147483647 AS shift FROM range(1000) t(b)),
poisson AS (SELECT list(floor(upto * 2147483647) ORDER BY n) AS steps FROM (
    SELECT n, sum(exp(-1.0::DOUBLE) / gamma(n + 1.0::DOUBLE)) OVER (ORDER BY n) AS upto FROM range(9) t(n)) q),
drawn AS (SELECT b, f1, f2, fl, len(list_filter(steps, lambda s: (h * factor + shift) % 2147483647 >= s)) AS w
  FROM hashed, lines, poisson),
means AS (SELECT b, sum(w * f1) / sum(w) AS m1, sum(w * f2) / sum(w) AS m2, sum(w * fl) / sum(w) AS ml
  FROM drawn GROUP BY b HAVING sum(w) > 0),
quantiles AS (SELECT 'rouge1' AS metric, quantile_cont(m1, [0.025, 0.5, 0.975]) AS q FROM means
  UNION ALL SELECT 'rouge2', quantile_cont(m2, [0.025, 0.5, 0.975]) FROM means
  UNION ALL SELECT 'rougeL', quantile_cont(ml, [0.025, 0.5, 0.975]) FROM means)
SELECT metric, round(q[1] * 100, 4) AS low, round(q[2] * 100, 4) AS mid, round(q[3] * 100, 4) AS high
FROM quantiles"""


@query(f"""WITH {sql.PAIRS}, {_rouge_sql(1)}, {_rouge_sql(2)}, {ROUGE_L},
hashed AS (SELECT ('0x' || left(md5(conv_id::VARCHAR || ':' || turn::VARCHAR), 15))::BIGINT % 2147483647 AS h,
    a.f AS f1, b.f AS f2, CASE WHEN l.p + l.r > 0 THEN 2 * l.p * l.r / (l.p + l.r) ELSE 0 END AS fl
  FROM pairs JOIN rouge1 a USING (conv_id, turn) JOIN rouge2 b USING (conv_id, turn)
  JOIN prl l USING (conv_id, turn) WHERE status = 'ok'),
{RESAMPLED}""")
def rouge_intervals(spark, sf_dir):
    """Corpus scores without stemming with their 95 percent intervals over 1000 resampled corpora."""
    return rouge.interval_scores(_pairs(spark, sf_dir), KEY, stemmed=False,
                                 metrics=("rouge1", "rouge2", "rougeL"))


def _sides(stemmed):
    """CTEs ``said``, one row a token with its line and place, and ``sides``, token lists of pairs."""
    lines = lambda side, text: f"""SELECT conv_id, turn, '{side}' AS side,
      string_split(coalesce({text}, ''), chr(10)) AS lines FROM pairs"""
    pieces = f"""pieces AS (SELECT conv_id, turn, side, line, unnest(range(1, len(ts) + 1)) AS pos,
    unnest(ts) AS token FROM (SELECT conv_id, turn, side, unnest(range(1, len(lines) + 1)) AS line,
      unnest(list_transform(lines, lambda l: {sql.rouge_tokens('l')})) AS ts
    FROM ({lines('p', 'prediction')} UNION ALL {lines('r', 'reference')})))"""
    words = (f"""words AS (SELECT DISTINCT token FROM pieces), {stem_sql.stems('words')},
said AS (SELECT conv_id, turn, side, line, pos, stem AS t FROM pieces JOIN stems USING (token))"""
             if stemmed else "said AS (SELECT conv_id, turn, side, line, pos, token AS t FROM pieces)")
    return f"""{pieces}, {words},
whole AS (SELECT conv_id, turn, side, list(t ORDER BY line, pos) AS ts FROM said GROUP BY ALL),
sides AS (SELECT conv_id, turn, status, coalesce(p.ts, []) AS p, coalesce(r.ts, []) AS r FROM pairs
  LEFT JOIN (SELECT conv_id, turn, ts FROM whole WHERE side = 'p') p USING (conv_id, turn)
  LEFT JOIN (SELECT conv_id, turn, ts FROM whole WHERE side = 'r') r USING (conv_id, turn))"""


def _hits(n):
    """``hits_n``: clipped n-grams in common, and how many there are on either side."""
    gram = " || ' ' || ".join(f"ts[i + {k}]" for k in range(n))
    count = lambda side: f"""(SELECT conv_id, turn, {gram} AS g, count(*) AS c FROM (SELECT conv_id, turn,
      {side} AS ts, unnest(range(1, len({side}) - {n - 2})) AS i FROM sides) GROUP BY ALL)"""
    return f"""hits_{n} AS (SELECT s.conv_id, s.turn, status, coalesce(h, 0) AS h, greatest(len(p) - {n - 1}, 0) AS n_p,
    greatest(len(r) - {n - 1}, 0) AS n_r FROM sides s LEFT JOIN (
      SELECT a.conv_id, a.turn, sum(least(a.c, b.c)) AS h FROM {count('p')} a JOIN {count('r')} b
      USING (conv_id, turn, g) GROUP BY ALL) USING (conv_id, turn))"""


HITS_L = f"""hits_l AS (SELECT conv_id, turn, status, CASE WHEN len(p) = 0 OR len(r) = 0 THEN 0 ELSE {LCS} END AS h,
    len(p) AS n_p, len(r) AS n_r FROM sides)"""
# every line of the reference against every line of the prediction: the table of lengths, row by row
# (a leading zero in each), then the walk back from its end, which marks places of the reference
# line; a token counts as often as it is marked in any of the walks, and occurs in the prediction
HITS_LSUM = """line_lists AS (SELECT conv_id, turn, side, line, list(t ORDER BY pos) AS ts FROM said GROUP BY ALL),
tables AS (SELECT a.conv_id, a.turn, a.line, b.line AS other, a.ts AS a, b.ts AS b, list_reduce(
    list_prepend([list_transform(range(0, len(b.ts) + 1), lambda _: 0::BIGINT)],
      list_transform(a.ts, lambda t: [list_transform(b.ts, lambda x: CASE WHEN x = t THEN 1 ELSE 0 END::BIGINT)])),
    lambda rows, same: list_append(rows, list_reduce(
      list_prepend([0::BIGINT], list_transform(range(1, len(b.ts) + 1), lambda k: [
        CASE WHEN same[1][k] = 1 THEN rows[len(rows)][k] + 1 ELSE rows[len(rows)][k + 1] END])),
      lambda row, cell: list_append(row, greatest(row[len(row)], cell[1]))))) AS d
  FROM line_lists a JOIN line_lists b ON b.conv_id = a.conv_id AND b.turn = a.turn AND a.side = 'r' AND b.side = 'p'),
walk AS (SELECT conv_id, turn, line, other, len(a) AS i, len(b) AS j, NULL::BIGINT AS place FROM tables
  UNION ALL SELECT w.conv_id, w.turn, w.line, w.other,
    CASE WHEN a[i] = b[j] OR d[i + 1][j + 1] <= d[i][j + 1] THEN i - 1 ELSE i END,
    CASE WHEN a[i] = b[j] OR d[i + 1][j + 1] > d[i][j + 1] THEN j - 1 ELSE j END,
    CASE WHEN a[i] = b[j] THEN i END
  FROM walk w JOIN tables USING (conv_id, turn, line, other) WHERE i > 0 AND j > 0),
marked AS (SELECT conv_id, turn, t, count(*) AS c FROM said JOIN (
    SELECT DISTINCT conv_id, turn, line, place AS pos FROM walk WHERE place IS NOT NULL)
  USING (conv_id, turn, line, pos) WHERE side = 'r' GROUP BY ALL),
hits_lsum AS (SELECT s.conv_id, s.turn, status, coalesce(h, 0) AS h, len(p) AS n_p, len(r) AS n_r
  FROM sides s LEFT JOIN (SELECT conv_id, turn, sum(least(marked.c, n.c)) AS h FROM marked JOIN (
      SELECT conv_id, turn, t, count(*) AS c FROM said WHERE side = 'p' GROUP BY ALL) n
    USING (conv_id, turn, t) GROUP BY ALL) USING (conv_id, turn))"""


def _scored(hits, name):
    """Precision, recall and F1 of each pair from its hits."""
    return f"""SELECT conv_id, turn, round(p, 6) AS "{name}_p", round(r, 6) AS "{name}_r",
  round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS "{name}_f" FROM (
  SELECT conv_id, turn, CASE WHEN n_p > 0 THEN h::DOUBLE / n_p ELSE 0 END AS p,
    CASE WHEN n_r > 0 THEN h::DOUBLE / n_r ELSE 0 END AS r FROM {hits})"""


def _mean(hits, name):
    return f"""(SELECT round(avg(CASE WHEN n_p + n_r > 0 THEN 2 * h::DOUBLE / (n_p + n_r) ELSE 0 END) * 100, 4)
    FROM {hits} WHERE status = 'ok') AS "{name}\""""


@query(f"""WITH RECURSIVE {sql.PAIRS}, {_sides(True)}, {_hits(1)}, {_hits(2)}, {HITS_L}, {HITS_LSUM}
SELECT {_mean('hits_1', 'rouge1')}, {_mean('hits_2', 'rouge2')}, {_mean('hits_l', 'rougeL')},
  {_mean('hits_lsum', 'rougeLsum')}, (SELECT count(*) FROM pairs) AS pairs,
  (SELECT count(*) FROM pairs WHERE status = 'missing') AS missing""")
def corpus_rouge(spark, sf_dir):
    """All four metrics with stemming: one row of means."""
    return rouge.corpus_scores(_pairs(spark, sf_dir), KEY)


@query(f"WITH RECURSIVE {sql.PAIRS}, {_sides(False)}, {HITS_LSUM} {_scored('hits_lsum', 'rougeLsum')}")
def rouge_lsum(spark, sf_dir):
    return _rounded(rouge.rouge_lsum(_pairs(spark, sf_dir), KEY))


@query(f"WITH {sql.PAIRS}, {_sides(True)}, {_hits(1)} {_scored('hits_1', 'rouge1')}")
def rouge_1_stemmed(spark, sf_dir):
    return _rounded(rouge.rouge_n(_pairs(spark, sf_dir), KEY, 1, stemmed=True))


@query(f"""WITH {sql.PAIRS} SELECT p.conv_id, p.turn, CAST(sum(least(p.c, r.c)) AS BIGINT) AS overlap
  FROM {_ngrams(1, 'prediction')} p JOIN {_ngrams(1, 'reference')} r USING (conv_id, turn, g)
  GROUP BY ALL""")
def overlap_by_join(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    return rouge.overlap_by_join(
        rouge.gram_counts(pairs, KEY, "prediction"), rouge.gram_counts(pairs, KEY, "reference"), KEY)


@query(f"""WITH counts AS (SELECT token, count(*) AS n FROM (
    SELECT unnest({sql.rouge_tokens('text')}) AS token FROM documents) GROUP BY token),
{stem_sql.stems('counts')}
SELECT stem, sum(n)::BIGINT AS n, count(*) AS forms FROM counts JOIN stems USING (token) GROUP BY stem""")
def vocabulary_stems(spark, sf_dir):
    """Stems of every distinct token, joined back, and how many occurrences each stem has."""
    docs = table(spark, sf_dir, "documents", heavy=True)
    counts = (docs.select(F.explode(rouge.tokens(F.col("text"))).alias("token"))
              .groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    joined = rouge.attach_stems(counts, rouge.vocabulary(docs, "text"))
    return joined.groupBy("stem").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("forms"))


@query(f"SELECT t AS token, count(*) AS n FROM (SELECT unnest({sql.rouge_tokens('text')}) AS t "
       "FROM documents) GROUP BY t")
def token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", heavy=True)
    return docs.select(F.explode(rouge.tokens(F.col("text"))).alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("n"))
