"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeworks.llm import decontaminate, html_extract, mixing, packing, periodic, pii, prefixes, quality, sharding, simhash, tokens, toxicity, urlfilter
from noticeworks.llm.common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, both = pii.redact(table(spark, sf_dir, "documents"))
    return both.select(F.col("row.doc_id").alias("doc_id"), "n_entities", F.col("new").alias("text"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.rate(table(spark, sf_dir, "documents"))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return rows.select(*base, "n_tokens", "chars_per_token", "byte_share", "token_entropy")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.rules_table(spark))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.trie(table(spark, sf_dir, "conversations"), prefixes.rebuilt)


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return periodic.digest(periodic.periodic_runs(docs.withColumn("text", periodic.with_tail(F.col("text"), F.col("doc_id")))))


QUERIES = {
    f.__name__: f
    for f in (
        *(op1_token_counts, op2_packing, op3_pii, op4_sharding, op5_decontamination, op6_simhash, op7_toxicity, op8_quality, op9_url_filter, op10_html),
        *(op11_prefix_trie, op12_mixing, op13_periodic_runs),
    )
}

ORACLES = {
    "op5_decontamination": r"""
        WITH texts AS (
            SELECT 'item' AS kind, item_id AS number, 0 AS line, text FROM benchmark
            UNION ALL SELECT 'document', doc_id, row_number() OVER (), text FROM (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents)
        ), spelled AS (
            SELECT kind, number, line, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM texts
        ), widths AS (
            SELECT DISTINCT least(5, len(w)) AS width FROM spelled WHERE kind = 'item' AND len(w) > 0
        ), words AS (
            SELECT kind, number, line, len(w) AS n, unnest(w) AS a, unnest(range(1, len(w) + 1)) AS pos FROM spelled
        ), runs AS (
            SELECT kind, number, line, n, pos, a AS s1, a || ' ' || lead(a) OVER o AS s2, a || ' ' || lead(a) OVER o || ' ' || lead(a, 2) OVER o AS s3,
                   a || ' ' || lead(a) OVER o || ' ' || lead(a, 2) OVER o || ' ' || lead(a, 3) OVER o AS s4,
                   a || ' ' || lead(a) OVER o || ' ' || lead(a, 2) OVER o || ' ' || lead(a, 3) OVER o || ' ' || lead(a, 4) OVER o AS s5
            FROM words WINDOW o AS (PARTITION BY kind, number, line ORDER BY pos)
        ), sized AS (
            SELECT kind, number, line, CASE width WHEN 1 THEN s1 WHEN 2 THEN s2 WHEN 3 THEN s3 WHEN 4 THEN s4 ELSE s5 END AS s
            FROM runs JOIN widths ON kind = 'document' OR width = least(5, n)
        ), shingles AS (
            SELECT DISTINCT kind, number, line, s FROM sized WHERE s IS NOT NULL
        ), pieces AS (SELECT number AS item_id, s FROM shingles WHERE kind = 'item'),
        sizes AS (SELECT item_id, count(*) AS n FROM pieces GROUP BY 1)
        SELECT d.number AS doc_id, item_id, count(*) AS shared, n::INTEGER AS item_shingles, count(*) / n AS containment
        FROM shingles d JOIN pieces USING (s) JOIN sizes USING (item_id)
        WHERE d.kind = 'document'
        GROUP BY d.number, d.line, item_id, n HAVING count(*) >= 0.8::DOUBLE * n - 1e-9
    """,
    "op9_url_filter": r"""
        WITH rules(verdict, host, path) AS (
            VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
        ), parts AS (
            SELECT page_id, url,
                   translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
            FROM pages
        ), numbered AS (SELECT row_number() OVER () AS n, * FROM parts),
        fit AS (
            SELECT n, r.host || r.path AS rule, r.verdict,
                   row_number() OVER (PARTITION BY n ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS place
            FROM numbered p JOIN rules r
              ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
        )
        SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
        FROM numbered p LEFT JOIN fit f ON p.n = f.n AND f.place = 1
    """,
    "op11_prefix_trie": r"""
        WITH turns AS (
            SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
                   coalesce(role, '') AS role, coalesce(text, '') AS text
            FROM conversations WHERE conv_id IS NOT NULL
        ), numbers AS (
            SELECT c, count(*) AS n, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                lambda s, x: list_reduce(list_concat([xor(s, x)], [1::BIGINT, 1, 1, 1, 1, 1, 1, 1]), lambda v, one: xor(v >> 1, (v & one) * 3988292384))) AS raw
            FROM turns GROUP BY c
        ), convs AS (SELECT c, n, xor(raw, 4294967295) % 6 AS h FROM numbers),
        heads AS (
            SELECT v.c, t.pos AS pos, t.role, t.text FROM convs v JOIN turns t ON t.c = v.c - v.c % 100 AND t.pos < v.h
        ), taken AS (SELECT v.c, v.h, count(x.pos) AS k FROM convs v LEFT JOIN heads x ON x.c = v.c GROUP BY ALL),
        built AS (
            SELECT c, pos + 1 AS depth, role, text FROM heads
            UNION ALL SELECT t.c, k.k + t.pos - k.h + 1, t.role, t.text FROM turns t JOIN taken k ON k.c = t.c WHERE t.pos >= k.h
        ), path AS (
            SELECT c, depth, list(sha256(length(role) || ':' || role || text)) OVER (PARTITION BY c ORDER BY depth) AS p, length(text) AS points FROM built
            UNION ALL SELECT c, 0, []::VARCHAR[], 0 FROM convs
        ), long AS (SELECT c, max(depth) AS length FROM path GROUP BY c),
        nodes AS (
            SELECT p, min(c) AS conv_id, depth, count(*) AS n_convs, min(points) AS points,
                   coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE depth = length), '') AS ends
            FROM path JOIN long USING (c) GROUP BY p, depth
        ), edges AS (SELECT p[:depth - 1] AS p, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
        counted AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN edges USING (p)),
        totals AS (
            SELECT p[:above] AS p, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum((n_convs - 1) * points)::BIGINT AS saved_tokens
            FROM (SELECT *, unnest(range(0, depth + 1)) AS above FROM counted) GROUP BY 1
        )
        SELECT x.conv_id, x.depth::BIGINT AS depth, y.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, saved_tokens, sha256(x.ends) AS ends_sha256
        FROM counted x JOIN totals t ON t.p = x.p LEFT JOIN nodes y ON x.depth > 0 AND y.p = x.p[:x.depth - 1]
    """,
    "op12_mixing": r"""
        WITH worded AS (
            SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), weighed AS (
            SELECT doc_id, source, len(w) AS size,
                   CASE WHEN len(w) > 1 THEN 0.1::DOUBLE + 0.9::DOUBLE * (list_unique(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))::DOUBLE / (len(w) - 1)) ELSE 1.0::DOUBLE END AS quality,
                   ('0x' || substr(md5('mix ' || coalesce(doc_id::VARCHAR, '') || '|' || text), 1, 13))::BIGINT AS bits
            FROM worded
        ), keyed AS (SELECT doc_id, source, size, -ln((bits::DOUBLE + 1) / 4503599627370496::DOUBLE) / quality AS key FROM weighed),
        sources AS (
            SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::DOUBLE AS most, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
            FROM keyed GROUP BY source
        ), levels AS (
            SELECT *, sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS words, sum(weight) OVER () AS all_weight,
                   coalesce(sum(most) OVER o, 0) AS left_of, coalesce(sum(weight) OVER o, 0) AS weigh_of
            FROM sources WINDOW o AS (ORDER BY most / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), capped AS (SELECT *, (words - left_of) / (all_weight - weigh_of) > most / weight AS full_up FROM levels),
        shared AS (
            SELECT source, source_size, CASE WHEN full_up THEN most ELSE least(most, weight * ((words - coalesce(sum(CASE WHEN full_up THEN most END) OVER (), 0))
                   / (all_weight - coalesce(sum(CASE WHEN full_up THEN weight END) OVER (), 0)))) END AS target
            FROM capped
        ), passes AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM shared),
        budgets AS (SELECT *, least(source_size, greatest(0, round(target)::BIGINT - epochs * source_size)) AS budget FROM passes),
        placed AS (
            SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM keyed
        )
        SELECT doc_id, size::BIGINT AS size, source_size, target, (epochs * size + greatest(0, least(size, budget - before)))::BIGINT AS taken
        FROM placed p JOIN budgets b ON p.source IS NOT DISTINCT FROM b.source
    """,
}
