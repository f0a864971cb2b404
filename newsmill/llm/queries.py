"""The operators of this subpackage applied to whole given tables, with SQL where it can say it."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsmill.llm.audit import audit
from newsmill.llm.clusters import cluster
from newsmill.llm.decontaminate import contamination
from newsmill.llm.exact_dedup import copies
from newsmill.llm.licenses import scan_licences
from newsmill.llm.mixing import mixed
from newsmill.llm.ngram_join import near_duplicates
from newsmill.llm.quality import judge
from newsmill.llm.secrets import count_kind, find_secrets, written
from newsmill.llm.sharding import shard_documents
from newsmill.llm.suffix_dedup import remove_repeats
from newsmill.llm.token_counts import count_tokens
from newsmill.llm.token_files import digest, read_ids, write_ids
from newsmill.session import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SHARDS = 24
TOKEN_LIMIT = 2048
MIX = {"weights": (3, 1, 2), "share": 1.5, "cap": 2.0}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return add


def vocabulary(name: str) -> bytes:
    """A tokenizer file, read where the query is built and sent along with it."""
    import public_tokenizers
    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query(f"""
WITH crc AS (  -- one step for each value of a byte
    SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k:
               CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS step
    FROM range(256) t(i)),
d AS (
    SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size,
           xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
               regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
               lambda h: ('0x' || h)::BIGINT)),
               lambda c, b: xor(c >> 8, step[1 + (xor(c, b) & 255)])), 4294967295) AS text_crc32
    FROM documents, crc),
s AS (
    SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32 ROWS UNBOUNDED PRECEDING)
              - size AS before, sum(size) OVER () AS total FROM d),
p AS (
    SELECT *, ((2 * before + size) * {SHARDS} // (2 * total))::INTEGER AS shard FROM s)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY before) - 1 AS slot,
       NULL::INTEGER AS grown_shard
FROM p""")
def op1_sharding(spark, sf_dir):
    """All documents in 24 shards of nearly equal bytes."""
    return shard_documents(documents(spark, sf_dir), SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


@query("""
WITH d AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
           ('0x' || substr(md5(concat_ws(':', '17', doc_id::VARCHAR)), 1, 15))::BIGINT AS mix
    FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
    SELECT *, [3.0, 1.0, 2.0][(row_number() OVER named - 1) % 3 + 1]::DOUBLE AS w,
           [0.6, 0.0, -0.6][(row_number() OVER named - 1) % 3 + 1]::DOUBLE AS slope,
           source_size * 2.0::DOUBLE AS cap,
           sum(source_size) OVER () * 1.5::DOUBLE AS everything
    FROM s WINDOW named AS (ORDER BY source NULLS LAST)),
f AS (
    SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
           sum(w) OVER (ORDER BY cap / w, source NULLS LAST
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS remaining
    FROM w),
l AS (
    SELECT filled, remaining FROM f WHERE w * (everything - filled) / remaining < cap
    ORDER BY cap / w LIMIT 1),
t AS (
    SELECT f.source, f.source_size, f.slope, coalesce(
        least(f.cap, f.w * (f.everything - l.filled) / l.remaining), f.cap) AS target
    FROM f LEFT JOIN l ON true),
p AS (
    SELECT d.*, t.source_size, t.target, t.slope, sum(d.size) OVER (PARTITION BY d.source
               ORDER BY d.mix, d.doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - d.size AS before
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
    SELECT *, CASE WHEN size > 0 THEN greatest(0, ceil(
        (target - (before + size / 2)) / source_size)) ELSE 0 END::BIGINT AS copies
    FROM p)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * copies)::BIGINT AS taken,
       CASE WHEN copies = 0 THEN NULL WHEN slope = 0 THEN before / target
            ELSE (slope - 1 + sqrt((1 - slope) * (1 - slope) + 4 * slope * (before / target)))
                 / (2 * slope) END AS position
FROM c""")
def op5_mixing(spark, sf_dir):
    """Documents of all sources mixed to target weights along a curriculum: every copy is put into
    training order, and what the mix holds of a document is counted there."""
    return mixed(documents(spark, sf_dir), **MIX).select(
        "doc_id", "size", "source_size", "target", "taken", "position")


@query("""
WITH RECURSIVE d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text,
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\\x20\\x09-\\x0D]+'), []) AS words
    FROM documents),
s AS (
    SELECT DISTINCT r, unnest(CASE WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
               ELSE list_transform(range(1, len(words) - 2), lambda i:
                   array_to_string(words[i:i + 3], ' ')) END) AS shingle
    FROM d WHERE len(words) > 0),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
links AS (
    SELECT x.r AS a, y.r AS b FROM s x JOIN s y ON x.shingle = y.shingle AND x.r <> y.r
    JOIN n m ON m.r = x.r JOIN n k ON k.r = y.r
    WHERE least(m.n, k.n) * 100 >= 85 * greatest(m.n, k.n)
    GROUP BY x.r, y.r, m.n, k.n HAVING 100 * count(*) >= 85 * (m.n + k.n - count(*))),
reach AS (
    SELECT r AS a, r AS b FROM d
    UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a AS r, min(doc_id) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id
FROM d LEFT JOIN n USING (r) JOIN least USING (r)""")
def op2_ngram_join(spark, sf_dir):
    """Documents linked by common word shingles, with the component each belongs to."""
    return near_duplicates(documents(spark, sf_dir), words=4, share=85)


@query()
def op3_secret_scans(spark, sf_dir):
    """Known secrets and strings found random, as counts, a digest and spans."""
    found = find_secrets(documents(spark, sf_dir))
    counts = [count_kind(F.col("base"), kind).alias(name)
              for kind, name in enumerate(("n_assign", "n_access", "n_hex"))]
    return found.select(
        "doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("base", "random"))).alias("spans"))


@query()
def op4_quality_rules(spark, sf_dir):
    """Counted limits and the verdict of a classifier trained on the labelled rows."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(documents(spark, sf_dir), labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "probability")


@query()
def op6_suffix_dedup(spark, sf_dir):
    """Strings of 200 bytes that occur more than once, removed from every text."""
    return remove_repeats(documents(spark, sf_dir)).drop("spans")


@query()
def op7_token_counts(spark, sf_dir):
    """Tokens of every text, from piece counts of distinct pre-tokens."""
    counted = count_tokens(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query()
def op8_token_files(spark, sf_dir):
    """Token ids of every text, written as ORC and read back."""
    path = scratch(spark, "token_ids")
    write_ids(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), path)
    return digest(read_ids(spark, path))


@query("""
WITH b AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
    FROM benchmark),
bw AS (
    SELECT item_id, least(10, len(words)) AS size,
           unnest(list_transform(range(1, len(words) - least(10, len(words)) + 2), lambda i:
               array_to_string(words[i:i + least(10, len(words)) - 1], ' '))) AS phrase
    FROM b WHERE len(words) > 0),
d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text,
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS words
    FROM documents),
dw AS (
    SELECT r, size, unnest(range(1, len(words) - size + 2)) AS place,
           unnest(list_transform(range(1, len(words) - size + 2), lambda i:
               array_to_string(words[i:i + size - 1], ' '))) AS phrase
    FROM d, (SELECT DISTINCT size FROM bw) s),
hits AS (SELECT r, place, dw.size, item_id FROM dw JOIN bw USING (size, phrase)),
words AS (
    SELECT r, count(DISTINCT w) AS n_hit
    FROM (SELECT r, unnest(range(place, place + size)) AS w FROM hits) GROUP BY r),
items AS (
    SELECT r, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS digest
    FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM hits) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, coalesce(digest, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)""")
def op9_decontaminate(spark, sf_dir):
    """Benchmark windows in all documents, by an FM-index for each shard of documents."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(documents(spark, sf_dir), benchmark).drop("spans")


@query()
def op10_license_scans(spark, sf_dir):
    """Known licence sentences in all documents, and the licences they make."""
    return scan_licences(documents(spark, sf_dir))


@query("""
WITH t AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
    FROM documents),
known AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
           max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
           CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
           + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
           + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text)
                  THEN 4 ELSE 0 END
           + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
           + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
    FROM t LEFT JOIN known USING (doc_id)),
m AS (
    SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
    FROM d GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (
    SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
    WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (
    SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS bit,
           list_sum(list_transform(range(1, step), lambda i:
               1 << (ascii(filter_order[i]) - 65))) AS before
    FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM o)),
c AS (
    SELECT part, filter_order, step, bit,
           sum(CASE WHEN mask & (bit | coalesce(before, 0)::BIGINT) = 0 THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN mask & coalesce(before, 0)::BIGINT = 0 AND mask & bit <> 0
               THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN mask & coalesce(before, 0)::BIGINT <> 0 AND mask & bit <> 0
               THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN mask & coalesce(before, 0)::BIGINT = 0 AND mask & bit <> 0
               THEN good ELSE 0 END) AS good_lost,
           sum(CASE WHEN mask & coalesce(before, 0)::BIGINT = 0 AND mask & bit <> 0
               THEN toxic ELSE 0 END) AS toxic_lost
    FROM m, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM c""")
def op11_filter_audit(spark, sf_dir):
    """What five filters remove in all their orders, with their Shapley values, per language."""
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _rounds(n: int) -> str:
    """Assignments and centroids of the rounds of a clustering, as common table expressions."""
    near = """a{i} AS (
    SELECT r, min({{'d': list_sum(list_transform(list_zip(kept.v, c.v), lambda p:
               (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'k': c.k}}) AS b
    FROM kept, c{i} c GROUP BY r)"""
    mean = """c{j} AS (
    SELECT c.k, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (
        SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM (
            SELECT a.b.k AS k, i, sum(kept.v[i]) AS s, count(*) AS n
            FROM a{i} a JOIN kept USING (r), range(1, 65) t(i) GROUP BY a.b.k, i)
        GROUP BY k) m ON m.k = c.k)"""
    steps = [part.format(i=i, j=i + 1) for i in range(n) for part in (near, mean)]
    return ",\n".join([*steps, near.format(i=n)])


@query(f"""
WITH kept AS (
    SELECT row_number() OVER () AS r, vec_id,
           list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
c0 AS (
    SELECT row_number() OVER (ORDER BY mark, v) - 1 AS k, v
    FROM (SELECT sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS mark, v FROM kept
          ORDER BY mark, v LIMIT 16)),
{_rounds(3)}
SELECT vec_id, b.k::INTEGER AS cluster, b.d AS distance,
       (sum(b.d) OVER (PARTITION BY b.k))::BIGINT AS cluster_inertia,
       (sum(b.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a3 JOIN kept USING (r) JOIN c3 c ON c.k = b.k""")
def op12_centroid_clusters(spark, sf_dir):
    """All vectors in 16 clusters, after three rounds in whole numbers."""
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, length(coalesce(text, '')) AS size,
           sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS text_sha256
    FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER best = 1 AS kept, text_sha256
FROM d WINDOW best AS (PARTITION BY text_sha256 ORDER BY size DESC, doc_id NULLS LAST, r)""")
def op13_exact_dedup(spark, sf_dir):
    """Copies among all documents, by two passes over a counting Bloom filter."""
    return copies(documents(spark, sf_dir))
