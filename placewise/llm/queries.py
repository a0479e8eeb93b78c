"""The registered queries of these operators, and SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import read_table
from .decontaminate import overlaps
from .htmltext import extracted
from .importance import resampled
from .langid import languages
from .lexical import best_documents
from .mixture import taken_words
from .neardup import near_duplicates
from .quality import quality_scores
from .secrets import find_secrets
from .shards import sharded
from .tokens import token_ids
from .topk import top_k
from .warc import archived

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder)`` under ``name``."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# Lower-cases A-Z only, as SQL text.
FOLD_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op10_near_duplicates", f"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({FOLD_SQL}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []
                 ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: md5(array_to_string(w[i:i + 4], ' ')))) END AS s FROM w),
    sets AS MATERIALIZED (SELECT list_sort(s) AS s, md5(array_to_string(list_sort(s), '')) AS class, min(doc_id) AS rep, any_value(len(s)) AS n
                            FROM s WHERE len(s) > 0 GROUP BY 1, 2),
    grams AS MATERIALIZED (SELECT rep, n, unnest(s) AS g FROM sets),
    df AS (SELECT g, count(*) AS df FROM grams GROUP BY g HAVING count(*) > 1),
    ranked AS (SELECT rep, n, grams.g, row_number() OVER (PARTITION BY rep ORDER BY coalesce(df, 1), grams.g) AS pos FROM grams LEFT JOIN df ON df.g = grams.g),
    heads AS (SELECT * FROM ranked WHERE pos <= n - ceil(n * 0.85) + 1),
    cand AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM heads a JOIN heads b ON a.g = b.g AND a.rep < b.rep
              WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
    links AS (SELECT a, b FROM (SELECT a, b, x.n AS na, y.n AS nb, len(list_intersect(x.s, y.s)) AS i FROM cand JOIN sets x ON x.rep = a JOIN sets y ON y.rep = b)
               WHERE 100 * i >= 85 * (na + nb - i)),
    ties AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach AS (SELECT rep AS a, rep AS b FROM sets UNION SELECT r.a, e.b FROM reach r JOIN ties e ON e.a = r.b),
    comp AS (SELECT a AS rep, min(b) AS component_id FROM reach GROUP BY 1)
    SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id, coalesce(c.component_id, s.doc_id) = s.doc_id AS kept
      FROM s LEFT JOIN sets ON sets.class = md5(array_to_string(list_sort(s.s), '')) AND len(s.s) > 0
      LEFT JOIN comp c ON c.rep = sets.rep""")
def op10(spark, folder):
    return near_duplicates(read_table(spark, folder, "documents"), size=5, percent=85)


@query("op7_quality")
def op7(spark, folder):
    return quality_scores(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"), cut=0.3)


@query("op8_decontaminate")
def op8(spark, folder):
    """One row per document and benchmark item that it repeats."""
    found = overlaps(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_words", "n_equal")


@query("op5_mixture")
def op5(spark, folder):
    return taken_words(read_table(spark, folder, "documents"))


@query("op4_token_ids")
def op4(spark, folder):
    import public_tokenizers

    return token_ids(read_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


@query("op1_exact_top_k", """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
                WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5""")
def op1(spark, folder):
    return top_k(read_table(spark, folder, "embeddings"), every=50, k=5)


@query("op6_secrets")
def op6(spark, folder):
    return find_secrets(read_table(spark, folder, "documents"))


@query("op2_language")
def op2(spark, folder):
    return languages(read_table(spark, folder, "documents"))


SIGNS_SQL = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (CAST('0x' || substr(sha, 5 * k + 1, 5) AS INT) // {1 << by}) % 32 + 1, 1)" for by in (15, 10, 5, 0))


@query("op9_warc", f"""
    WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS size, sha1(coalesce(html, '')) AS sha FROM pages),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY sha, size) AS first FROM d)
    SELECT page_id, size AS payload_bytes, array_to_string(list_transform(range(8), lambda k: {SIGNS_SQL}), '') AS payload_digest,
           CASE WHEN first IS DISTINCT FROM page_id AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to, true AS sound
      FROM f""")
def op9(spark, folder):
    found = archived(read_table(spark, folder, "pages"), least=0)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "sound")


@query("op3_main_text")
def op3(spark, folder):
    return extracted(read_table(spark, folder, "pages"))


@query("op13_shards")
def op13(spark, folder):
    """The shard and the place in it of every document: 16 shards of near equal bytes, equal texts together."""
    return sharded(read_table(spark, folder, "documents"), shards=16)


# crc32 of the bytes x, by the checksum's table.
CRC_STEP = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
CRC_TABLE_SQL = f"""crc_rounds AS (SELECT b, 0 AS k, b::BIGINT AS c FROM range(256) t(b) UNION ALL SELECT b, k + 1, {CRC_STEP} FROM crc_rounds WHERE k < 8),
    crc AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM crc_rounds WHERE k = 8)"""


def crc_sql(column: str) -> str:
    digits = f"hex(encode({column}))"
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 2 * strlen({column}), 2),
        lambda i: ('0x' || substr({digits}, i, 2))::BIGINT)), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295)"""


@query("op11_importance_resampling", f"""
    WITH RECURSIVE {CRC_TABLE_SQL},
    d AS (SELECT doc_id, regexp_extract_all({FOLD_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    m AS (SELECT regexp_extract_all({FOLD_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    df AS (SELECT doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM d),
    mf AS (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM m),
    names AS (SELECT DISTINCT f FROM (SELECT f FROM df UNION ALL SELECT f FROM mf)),
    hashed AS MATERIALIZED (SELECT f, {crc_sql("f")} % 10000 AS bucket FROM names, crc),
    s AS (SELECT bucket, count(*) AS s FROM df JOIN hashed USING (f) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM mf JOIN hashed USING (f) GROUP BY bucket),
    n AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS all_s, (SELECT coalesce(sum(t), 0) FROM t) AS all_t),
    g AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS gain
            FROM s LEFT JOIN t USING (bucket), n),
    sums AS (SELECT doc_id, count(*) AS n, sum(gain)::DOUBLE AS total FROM df JOIN hashed USING (f) JOIN g USING (bucket) GROUP BY doc_id),
    r AS (SELECT d.doc_id, len(w) AS words, coalesce(n, 0)::BIGINT AS n_features, coalesce(floor(total / n), 0)::BIGINT AS weight,
                 ('0x' || substr(sha256('7:' || d.doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN sums USING (doc_id)),
    p AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM r),
    o AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY words >= 20) AS able FROM p)
    SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= 25 * able // 100 THEN place END AS rank FROM o""")
def op11(spark, folder):
    return resampled(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"), percent=25, least_words=20)


LETTERS_SQL = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


@query("op12_lexical_search", f"""
    WITH d AS (SELECT doc_id, regexp_extract_all({FOLD_SQL}, '{LETTERS_SQL}') AS w FROM documents),
    size AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS length FROM d WHERE len(w) > 0),
    b AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all({FOLD_SQL}, '{LETTERS_SQL}')) AS term FROM benchmark) GROUP BY ALL),
    tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM b) GROUP BY ALL),
    df AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, size GROUP BY term, n_docs),
    s AS (SELECT item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // length))))::BIGINT AS score
            FROM tf JOIN df USING (term) JOIN b USING (term), size GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 20""")
def op12(spark, folder):
    return best_documents(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"), k=20)
