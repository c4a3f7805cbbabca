"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .compactwindows import repeated_passages
from .conversationtrie import conversation_trie
from .covertree import embedding_near_duplicates
from .filteraudit import filter_audit
from .fingerprints import fingerprints
from .importance import importance_resample
from .lshforest import jaccard_join
from .mixing import mix_sources
from .outliers import quality_rules
from .packing import pack
from .toxicity import toxicity
from .urlrules import url_filter
from .warc import archive_round_trip

#: The listed rules of the URL filter as (verdict, host, path).
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


#: Domains of the sources by their number modulo 4, and target weights by level; what is not named weighs 1.
DOMAINS = ["web", "books", "news", "code"]
MIX_WEIGHTS = [{"web": 0.4, "books": 0.25, "news": 0.2, "code": 0.15}, {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}, {}]
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.6, 2, 17


def mix_levels() -> list[tuple[str, Column]]:
    number = F.coalesce(F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int"), F.lit(0))
    domain = F.element_at(F.array(*[F.lit(d) for d in DOMAINS]), F.pmod(number, F.lit(4)) + 1)
    return [("domain", domain), ("lang", F.col("lang")), ("source", F.col("source"))]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).drop("digest")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"), mix_levels(), MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED)
    return mixed.select("doc_id", F.col("__mix_domain").alias("domain"), "lang", "source", F.col("__mix_tokens").alias("tokens"), F.col("__mix_epoch").alias("epoch"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op7_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), URL_RULES)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_importance_resampling": op1_importance_resampling,
    "op2_toxicity": op2_toxicity,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_warc": op4_warc,
    "op5_mix_sources": op5_mix_sources,
    "op6_quality_rules": op6_quality_rules,
    "op7_embedding_near_dup": op7_embedding_near_dup,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_packing": op9_packing,
    "op10_url_filters": op10_url_filters,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_filter_audit": op12_filter_audit,
    "op13_fingerprints": op13_fingerprints,
}

ORACLE_SQL: dict[str, str] = {
    "op4_warc": """
        WITH p AS (
          SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT p.page_id, p.payload_bytes, p.payload_digest,
          CASE WHEN f.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN f.first_id <> p.page_id THEN f.first_id END AS refers_to
        FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100
    """,
    "op5_mix_sources": r"""
        WITH d AS (
          SELECT doc_id, lang, source, ['web', 'books', 'news', 'code'][coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT), 0) % 4 + 1] AS domain,
            len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+'))::BIGINT AS tokens, sha256(coalesce(text, '')) AS digest FROM documents
        ), s AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, 2.0::DOUBLE * sum(tokens) AS cap FROM d GROUP BY ALL HAVING sum(tokens) > 0),
        g0 AS (SELECT least(sum(cap), floor(sum(tokens) * 0.6::DOUBLE)) AS given FROM s),
        k1 AS (SELECT domain, sum(cap) AS cap, CASE domain WHEN 'web' THEN 0.4 WHEN 'books' THEN 0.25 WHEN 'news' THEN 0.2 WHEN 'code' THEN 0.15 END::DOUBLE AS w FROM s GROUP BY 1),
        u1 AS (SELECT k1.*, given, (given - coalesce(sum(cap) OVER (ORDER BY cap / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit FROM k1, g0),
        g1 AS (SELECT domain, CASE WHEN cap <= w * unit THEN cap ELSE w * arg_min(unit, cap / w) FILTER (cap > w * unit) OVER () END AS given FROM u1),
        k2 AS (SELECT domain, lang, sum(cap) AS cap, CASE lang WHEN 'en' THEN 0.5 WHEN 'de' THEN 0.2 WHEN 'fr' THEN 0.2 WHEN 'es' THEN 0.1 ELSE 1 END::DOUBLE AS w FROM s GROUP BY 1, 2),
        u2 AS (SELECT k2.*, given, (given - coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit FROM k2 JOIN g1 USING (domain)),
        g2 AS (SELECT domain, lang, CASE WHEN cap <= w * unit THEN cap ELSE w * arg_min(unit, cap / w) FILTER (cap > w * unit) OVER (PARTITION BY domain) END AS given FROM u2),
        u3 AS (SELECT s.*, given, (given - coalesce(sum(cap) OVER (PARTITION BY domain, lang ORDER BY cap, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / count(*) OVER (PARTITION BY domain, lang ORDER BY cap, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit FROM s JOIN g2 USING (domain, lang)),
        g3 AS (SELECT domain, lang, source, tokens AS t, floor(CASE WHEN cap <= unit THEN cap ELSE arg_min(unit, cap) FILTER (cap > unit) OVER (PARTITION BY domain, lang) END + 1e-6)::BIGINT AS budget FROM u3),
        o AS (SELECT d.*, budget // t AS whole, budget % t AS rest, sum(tokens) OVER (PARTITION BY domain, lang, source
            ORDER BY md5('17:' || (budget // t) || ':' || doc_id), digest) AS upto FROM d JOIN g3 USING (domain, lang, source) WHERE tokens > 0)
        SELECT doc_id, domain, lang, source, tokens, unnest(range(whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END))::INT AS epoch FROM o
    """,
    "op7_embedding_near_dup": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
        r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY 1), k AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
        SELECT c.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN k ON c.vec_id = k.vec_id
    """,
    "op8_jaccard_join": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+'), lambda x: x <> '') AS w FROM documents
        ), s AS (
          SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w
        ), z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b, i = x.n AND i = y.n AS same FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 5 * i >= 4 * (x.n + y.n - i)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1),
        k AS (SELECT a AS doc_id, count(*) AS n_links, min(b) FILTER (same) AS twin FROM l GROUP BY 1)
        SELECT c.doc_id, least(c.doc_id, coalesce(twin, c.doc_id)) AS class_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, c.doc_id = component_id AS kept
        FROM c LEFT JOIN k ON c.doc_id = k.doc_id
    """,
    "op10_url_filters": r"""
        WITH u AS (
          SELECT page_id, coalesce(url, '') AS url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), h AS (
          SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
        ), r AS (
          SELECT *, CASE
            WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
            WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
            WHEN ('.' || host) LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
            WHEN ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
            WHEN ('.' || host) LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule FROM h
        ), g AS (
          SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS given,
            list_distinct(list_concat(
              list_transform(list_reverse(string_split(host, '.')), lambda x, i: 'host' || (i - 1) || '=' || x),
              list_concat(list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x, i: 'path' || (i - 1) || '=' || regexp_replace(x, '[0-9]+', '', 'g')),
              list_concat(list_transform(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> ''), lambda x: 'key=' || string_split(x, '=')[1]),
              ['scheme=' || string_split(url, '://')[1]])))) AS tokens FROM r
        ), t AS (SELECT row_number() OVER () AS k, *, unnest(tokens) AS token FROM (SELECT page_id, given, tokens FROM g) q),
        s AS (
          SELECT page_id, given, token AS a, '' AS b, '' AS c FROM t
          UNION ALL SELECT x.page_id, x.given, x.token, y.token, '' FROM t x JOIN t y ON x.page_id = y.page_id AND x.token < y.token
          UNION ALL SELECT x.page_id, x.given, x.token, y.token, z.token FROM t x JOIN t y ON x.page_id = y.page_id AND x.token < y.token JOIN t z ON y.page_id = z.page_id AND y.token < z.token
        ), m AS (
          SELECT a, b, c FROM s WHERE given IS NOT NULL GROUP BY a, b, c
          HAVING count(*) FILTER (given = 'block') >= ceil(0.01 * (SELECT count(*) FROM g WHERE given IS NOT NULL))
            AND count(*) FILTER (given = 'block') >= 0.9 * count(*)
        ), f AS (SELECT DISTINCT s.page_id FROM s JOIN m USING (a, b, c))
        SELECT g.page_id, g.host, g.path, g.rule, coalesce(g.given, CASE WHEN f.page_id IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
          CASE WHEN f.page_id IS NULL THEN 'allow' ELSE 'block' END AS method_verdict
        FROM g LEFT JOIN f ON g.page_id = f.page_id
    """,
    "op11_conversation_trie": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
        k AS (SELECT conv_id, turn, md5(length(r) || ':' || r || x) AS k, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w FROM t),
        o AS (SELECT conv_id, list({'k': k, 'w': w} ORDER BY turn NULLS FIRST, k) AS own FROM k GROUP BY 1),
        h AS (
          SELECT *, conv_id - conv_id % 20 AS base, xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
            lambda c, b: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295::BIGINT), 4294967295) % 4 AS h FROM o
        ), b AS (SELECT h.conv_id, list_concat(coalesce(o.own[1:h], []), h.own[h + 1:]) AS s FROM h LEFT JOIN o ON o.conv_id = h.base),
        q AS (SELECT *, unnest(range(len(s) + 1)) AS depth FROM b),
        p AS (SELECT conv_id, len(s) = depth AS ends, depth, list_transform(s[1:depth], lambda x: x.k) AS path, CASE WHEN depth > 0 THEN s[depth].w ELSE 0 END AS w FROM q),
        n AS (SELECT path, depth, any_value(w) AS w, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY 1, 2),
        c AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
        f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c ON n.path = c.path),
        u AS (SELECT path[1:a] AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * w) AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS a FROM f) GROUP BY 1)
        SELECT f.conv_id, f.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
        FROM f JOIN u ON f.path = u.path LEFT JOIN n up ON f.depth > 0 AND up.path = f.path[1:f.depth - 1]
    """,
    "op12_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents),
        w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w FROM d),
        y AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
        f AS (
          SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
            (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT + 4 * (100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 5 * length(x))::INT
              + 8 * regexp_matches(x, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY x), false)::INT AS m
          FROM w LEFT JOIN y ON w.doc_id = y.doc_id
        ), g AS (SELECT part, m, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY 1, 2),
        l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b),
        o AS (
          SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM l a JOIN l b ON b.x <> a.x JOIN l c ON c.x NOT IN (a.x, b.x)
          JOIN l d ON d.x NOT IN (a.x, b.x, c.x) JOIN l e ON e.x NOT IN (a.x, b.x, c.x, d.x)
        ), s AS (SELECT filter_order, bits, unnest(range(1, 6)) AS step FROM o),
        t AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM s),
        r AS (
          SELECT part, filter_order, step::INT AS step, own, coalesce(sum(n) FILTER (m & (before | own) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (m & before = 0 AND m & own > 0), 0)::BIGINT AS removed,
            coalesce(sum(n) FILTER (m & before > 0 AND m & own > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (m = own), 0)::BIGINT AS unique_fails,
            coalesce(sum(good) FILTER (m & before = 0 AND m & own > 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (m & before = 0 AND m & own > 0), 0)::BIGINT AS toxic_lost
          FROM g JOIN t ON true GROUP BY ALL
        )
        SELECT * EXCLUDE (own), sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM r
    """,
}
