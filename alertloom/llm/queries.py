"""One query per operator over the whole table it is meant for, with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertloom.llm import common, debruijn, exact, language, lattice, leaks, linkgraph, negatives, packing, prefixes, quality, secret_scan, simhash, suffixes

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark, sf_dir):
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return add


@query("op1_language_id")
def op1(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    split = docs.withColumn("held_out", common.remainder(4) == 2)
    model = language.learn(common.documents(split.where("not held_out"), "lang"))
    return language.predict(common.documents(split, "held_out"), model)


@query("op2_lm_scoring")
def op2(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    found = lattice.score_documents(docs.withColumn("train", common.remainder(5) != 1))
    return found.select("doc_id", (~F.col("train")).alias("held_out"), *found.columns[2:])


@query(
    "op3_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
)
def op3(spark, sf_dir):
    return exact.exact_dedup(common.table(spark, sf_dir, "documents")).drop("bucket")


@query("op4_secret_scan")
def op4(spark, sf_dir):
    """Labelled findings are those of three documents in four: 1 where a value of 32 or more hex digits is assigned in quotes."""
    docs = common.table(spark, sf_dir, "documents")
    found = secret_scan.candidates(docs, "source")
    found = common.stage(secret_scan.features(found, secret_scan.dictionary(docs)), "candidates")
    assigned = F.col("candidate").rlike("^[0-9a-fA-F]{32,}$") & (F.col("quoted") == 1) & F.col("before1").rlike("[=:]$")
    labelled = found.where(common.remainder(4) != 2).withColumn("label", assigned.cast("int"))
    return secret_scan.scan(found, secret_scan.fit(labelled))


@query("op5_substring_dedup")
def op5(spark, sf_dir):
    return debruijn.remove_repeats(common.table(spark, sf_dir, "documents")).drop("spans")


@query("op6_best_fit_packing")
def op6(spark, sf_dir):
    return packing.pack(common.table(spark, sf_dir, "documents"), special=packing.SPECIAL)


@query("op7_benchmark_decontamination")
def op7(spark, sf_dir):
    return leaks.find_leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


@query("op8_quality_classifier")
def op8(spark, sf_dir):
    docs = common.documents(common.table(spark, sf_dir, "documents")).withColumn("held_out", common.remainder(4) == 2)
    model = quality.fit(docs.where("not held_out"), common.table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, model)


@query("op9_suffix_array_dedup")
def op9(spark, sf_dir):
    return suffixes.remove_repeats(common.table(spark, sf_dir, "documents")).drop("spans")


@query("op10_simhash_near_dedup")
def op10(spark, sf_dir):
    found = simhash.near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query(
    "op11_hard_negatives",
    """
    WITH v AS (
        SELECT *, row_number() OVER () AS row FROM (
            SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND NOT coalesce(list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x))), false))
    ), s AS (
        SELECT a.row, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
        FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id IS DISTINCT FROM b.vec_id
    ), p AS (
        SELECT row, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY row ORDER BY score DESC, id) AS place FROM s WHERE same
        QUALIFY place <= 5
    )
    SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY row, place ORDER BY score DESC, id)::INT AS rank,
           id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (row) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
    QUALIFY rank <= 5
    """,
)
def op11(spark, sf_dir):
    vectors = common.table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


@query(
    "op12_conversation_prefix_trie",
    """
    WITH own AS (
        SELECT conv_id, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS item, strlen(coalesce(text, '')) AS bytes,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
        FROM conversations WHERE conv_id IS NOT NULL
    ), c AS (
        SELECT conv_id, conv_id - conv_id % 5 AS base, xor(4294967295, list_reduce(
            [4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
            lambda crc, byte: list_reduce([xor(crc, byte)] || range(8), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))
        )) % 9 AS h
        FROM own GROUP BY conv_id
    ), r AS (
        SELECT c.conv_id, 0 AS part, o.pos, o.item, o.bytes FROM c JOIN own o ON o.conv_id = c.base AND o.pos <= c.h
        UNION ALL SELECT c.conv_id, 1, o.pos, o.item, o.bytes FROM c JOIN own o ON o.conv_id = c.conv_id AND o.pos > c.h
    ), d AS (
        SELECT conv_id, bytes, row_number() OVER w AS depth, string_agg(item, '') OVER w AS key FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)
    ), p AS (
        SELECT conv_id, bytes, depth, key, coalesce(lag(key) OVER (PARTITION BY conv_id ORDER BY depth), '') AS up FROM d
        UNION ALL SELECT conv_id, 0, 0, '', NULL FROM c
    ), l AS (
        SELECT conv_id, arg_max(key, depth) AS key FROM p GROUP BY conv_id
    ), e AS (
        SELECT key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM l GROUP BY key
    ), n AS (
        SELECT key, any_value(up) AS up, any_value(depth) AS depth, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n FROM p GROUP BY key
    ), k AS (
        SELECT up AS key, count(*) AS children FROM n WHERE up IS NOT NULL GROUP BY up
    ), s AS (
        SELECT p.key, sum((n.n - 1) * n.bytes)::BIGINT AS saved, count(*) FILTER (k.children IS NULL) AS leaves
        FROM n JOIN p ON p.conv_id = n.conv_id AND p.depth <= n.depth LEFT JOIN k ON k.key = n.key GROUP BY p.key
    )
    SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(k.children, 0) AS n_children, s.leaves AS n_leaves,
           s.saved AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
    FROM n JOIN s USING (key) LEFT JOIN k USING (key) LEFT JOIN e USING (key) LEFT JOIN n u ON u.key = n.up
    """,
)
def op12(spark, sf_dir):
    return prefixes.prefix_trie(common.table(spark, sf_dir, "conversations"))


URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


@query(
    "op13_url_filter",
    r"""
    WITH RECURSIVE cut AS (
        SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
    ), named AS (
        SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut
    ), parts AS (
        SELECT page_id, html, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM named
    ), rules(verdict, name, start) AS (
        VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
    ), judged AS (
        SELECT p.*, f.rule, f.verdict FROM parts p LEFT JOIN (
            SELECT q.host, q.path, arg_max(r.name || r.start, length(r.name || r.start)) AS rule, arg_max(r.verdict, length(r.name || r.start)) AS verdict
            FROM (SELECT DISTINCT host, path FROM parts) q JOIN rules r
              ON (q.host = r.name OR ends_with(q.host, '.' || r.name)) AND starts_with(q.path, r.start) GROUP BY q.host, q.path
        ) f USING (host, path)
    ), links AS (
        SELECT host AS src, dst, count(*) AS links FROM (
            SELECT host, translate(unnest(regexp_extract_all(html, '(?i)\b(?:href|src)\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''\s<>]+)', 1)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM parts WHERE host <> ''
        ) WHERE host <> dst GROUP BY ALL
    ), edges AS (
        SELECT *, sum(links) OVER (PARTITION BY kind, host) AS all_links FROM (
            SELECT 'trust' AS kind, src AS host, dst, links FROM links UNION ALL SELECT 'distrust', dst, src, links FROM links)
    ), moving(k, kind, host, mass) AS (
        SELECT 0, CASE verdict WHEN 'block' THEN 'distrust' ELSE 'trust' END, host, count(*)::HUGEINT * 1048576 FROM judged WHERE rule IS NOT NULL GROUP BY 2, 3
        UNION ALL
        SELECT k + 1, m.kind, e.dst, sum((m.mass * 85 * e.links) // (e.all_links * 100)) FROM moving m JOIN edges e ON m.kind = e.kind AND m.host = e.host
        WHERE k < 39 GROUP BY 1, 2, 3 HAVING sum((m.mass * 85 * e.links) // (e.all_links * 100)) > 0
    ), hosts AS (
        SELECT host, sum(CASE WHEN kind = 'trust' THEN mass - mass * 85 // 100 ELSE 0 END) AS good,
               sum(CASE WHEN kind = 'distrust' THEN mass - mass * 85 // 100 ELSE 0 END) AS bad FROM moving GROUP BY host
    )
    SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN bad * 100 > (good + bad) * 50 THEN 'block' ELSE 'allow' END) AS verdict,
           coalesce(good, 0)::DOUBLE / 1048576 AS trust, coalesce(bad, 0)::DOUBLE / 1048576 AS distrust
    FROM judged LEFT JOIN hosts USING (host)
    """,
)
def op13(spark, sf_dir):
    return linkgraph.filter_urls(common.table(spark, sf_dir, "pages"), URL_RULES)
