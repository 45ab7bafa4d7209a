"""The operators of this package applied to the given tables, and their SQL."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm import (centroids, decontaminate, line_crf, minhash, ngram_lm, periodic, pii, sharding,
                            simhash, token_counts, topk, transducer, url_filter)
from ledgerflow.llm.shared import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items that it overlaps."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    items = table(spark, sf_dir, "benchmark", "item_id", "text")
    found = docs.select("doc_id", decontaminate.matches_column(docs, "text", items, "item_id", "text").alias("m"))
    ids = F.array_sort(F.array_distinct(F.transform("m", lambda x: x["item_id"])))
    return (found.select("doc_id", F.size("m").alias("n_overlaps"), ids.alias("item_ids"))
            .select("doc_id", (F.col("n_overlaps") > 0).alias("contaminated"), "n_overlaps",
                    F.size("item_ids").alias("n_items"),
                    F.array_join(F.transform("item_ids", lambda x: x.cast("string")), ",").alias("items")))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it is over the context limit."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return (docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
                        token_counts.count_column(docs, "text").alias("n_tokens"))
            .withColumn("over_limit", F.col("n_tokens") > 4096))


def held_out(doc_id) -> F.Column:
    """Rows kept from fitting: crc32 of the id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def quality_field(spark: SparkSession, docs: DataFrame, sf_dir: str) -> line_crf.Field:
    """The field fitted on all labelled documents that are not held out."""
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").filter(~held_out(F.col("doc_id")))
    return line_crf.Field.learn(line_crf.labelled_lines(docs, "doc_id", "text", labels, "doc_id", "quality"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    field = quality_field(spark, docs, sf_dir)
    return (docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                        line_crf.score_column(docs, "text", field).alias("score"))
            .withColumn("predicted", (F.col("score") >= line_crf.THRESHOLD).cast("int")))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of the text they decode to."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    both = transducer.round_trip(docs, "text", ["doc_id"]).select("doc_id", "bpe.ids", "bpe.decoded")
    return both.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best candidates of every query vector."""
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    got = topk.search(vectors, "vec_id", topk.quantized(F.col("embedding")), F.col("vec_id") % 20 == 0, 20)
    return got.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    return url_filter.judge(pages, "url").select("page_id", "host", "path", "rule", "verdict")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return simhash.components(docs, "doc_id", "text").select(
        F.col("id").alias("doc_id"), simhash.as_hex(F.col("fp")).alias("fingerprint"),
        F.col("component").alias("component_id"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and place of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumn(
        "text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    got = sharding.shard(docs, "text", "doc_id", 8, carry=["doc_id", "text_crc32"])
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                      F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model score of every document against all others."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    got = ngram_lm.score(docs, "doc_id", "text")
    mean = F.col("log_score") / F.greatest(F.col("n_words"), F.lit(1))
    return got.select(F.col("id").alias("doc_id"), "n_words", F.round("log_score", 4).alias("log_score"),
                      F.round(mean, 6).alias("mean_log_score"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = docs.select("doc_id", pii.spans_column(docs, "text").alias("s"))

    def said(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def of(*kinds):
        return F.filter("s", lambda x: x["kind"].isin(*kinds))

    base = pii.KINDS[:pii.BASE]
    return found.select(
        "doc_id", *[F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in pii.KINDS],
        F.size("s").cast("bigint").alias("n_spans"),
        F.sha2(said(of(*base)).cast("binary"), 256).alias("base_sha256"), said(F.col("s")).alias("spans"))


def repeated_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """Places of the words of a document of n words, a tail repeated in one of ten (by crc32 of the id)."""
    if doc_id is None:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % p, i)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, the longest one, and digests of the runs and of what is left."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = (docs.select("doc_id", periodic.report_column(docs, "text", "doc_id", repeated_tail).alias("r"))
             .select("doc_id", "r.runs", "r.collapsed"))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
        r["period"].cast("string"), F.lit("\n"))), "")
    return (found.withColumn("best", longest).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, squared distance and inertia of every vector of 64 components."""
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    got, cents = centroids.cluster(vectors, "vec_id", centroids.integers(F.col("embedding"), 256, 64), 64, 40, 5, "2:")
    return centroids.with_inertia(got, cents).select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and near-duplicate component of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return minhash.components(docs, "doc_id", "text").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"))


QUERIES = {f.__name__: f for f in (
    op1_decontamination, op2_token_counts, op3_quality, op4_bpe, op5_topk, op6_urls, op7_simhash,
    op8_sharding, op9_lm_scores, op10_pii, op11_periodic_runs, op12_centroids, op13_minhash)}



def _centroid_sql(rounds: int = 5, k: int = 40, dim: int = 64) -> str:
    """Rounds of plain nearest-centroid search, one after another, without any filter."""
    near = """
        n{0} AS MATERIALIZED (
            SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d
            FROM (SELECT v.r, m.c, v.qq - 2 * list_inner_product(v.q, m.q) + list_inner_product(m.q, m.q) AS d
                  FROM v, m{0} AS m)
            GROUP BY r)"""
    move = """
        s{0} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM (
            SELECT n.c, unnest(range(1, {2} + 1)) AS i, unnest(v.q) AS x FROM n{0} AS n JOIN v ON v.r = n.r)
            GROUP BY c, i),
        m{1} AS MATERIALIZED (
            SELECT m.c, coalesce(w.q, m.q) AS q FROM m{0} AS m LEFT JOIN (
                SELECT c, list(floor(s / n) ORDER BY i) AS q FROM s{0} GROUP BY c) AS w ON w.c = m.c)"""
    steps = [near.format(0)]
    for j in range(rounds):
        steps += [move.format(j, j + 1, dim), near.format(j + 1)]
    return f"""
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, q, list_inner_product(q, q) AS qq FROM (
                SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
                FROM embeddings
                WHERE len(embedding) = {dim}
                  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)),
        m0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), q) - 1 AS c, q FROM v
            WHERE vec_id IS NOT NULL ORDER BY c LIMIT {k}),
        {','.join(steps)},
        p AS (SELECT c, sum(d) AS s FROM n{rounds} GROUP BY c),
        t AS (SELECT sum(d) AS s FROM n{rounds})
        SELECT v.vec_id, CAST(n.c AS INTEGER) AS cluster, CAST(n.d AS BIGINT) AS distance,
               CAST(p.s AS BIGINT) AS cluster_inertia, CAST(t.s AS BIGINT) AS inertia,
               sha256(array_to_string(list_transform(m.q, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
        FROM v JOIN n{rounds} AS n ON n.r = v.r JOIN p ON p.c = n.c JOIN m{rounds} AS m ON m.c = n.c, t"""


ORACLES = {
    "op12_centroids": _centroid_sql(),
    "op5_topk": """
        WITH v AS (
            SELECT row_number() OVER () AS r, vec_id,
                   list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        s AS (
            SELECT a.r, a.vec_id AS query_id, b.vec_id AS vec_id,
                   CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
            FROM v AS a JOIN v AS b ON len(a.q) = len(b.q) AND a.vec_id <> b.vec_id
            WHERE a.vec_id % 20 = 0),
        r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank
            FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op6_urls": """
        WITH cut AS (
            SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
            FROM pages),
        split AS (
            SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path
            FROM cut),
        listed (h, p, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
            ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        fits AS (
            SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(action, length(h || p)) AS action
            FROM split JOIN listed ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
            GROUP BY page_id)
        SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.action, 'allow') AS verdict
        FROM split AS s LEFT JOIN fits AS f ON f.page_id = s.page_id""",
    "op9_lm_scores": r"""
        WITH t AS (
            SELECT row_number() OVER () AS rid, doc_id,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        tok AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS pos, len(w) AS n FROM t),
        seq AS (SELECT *, lag(word) OVER (PARTITION BY rid ORDER BY pos) AS prev FROM tok),
        cnt AS (
            SELECT rid, pos, greatest((SELECT count(*) FROM tok) - n, 1) AS others,
                   count(*) OVER (PARTITION BY word) - count(*) OVER (PARTITION BY rid, word) AS c1,
                   count(*) OVER (PARTITION BY prev, word) - count(*) OVER (PARTITION BY rid, prev, word) AS c2
            FROM seq),
        bef AS (SELECT *, lag(c1) OVER (PARTITION BY rid ORDER BY pos) AS c0 FROM cnt),
        p AS (
            SELECT rid, CASE WHEN pos = 1 THEN greatest(CAST(c1 AS DOUBLE), 0.4) / others
                             WHEN c2 > 0 THEN c2 / CAST(greatest(c0, 1) AS DOUBLE)
                             ELSE 0.4 * greatest(CAST(c1 AS DOUBLE), 0.4) / others END AS s
            FROM bef),
        l AS (SELECT rid, sum(ln(s)) AS ls FROM p GROUP BY rid)
        SELECT t.doc_id, CAST(len(t.w) AS BIGINT) AS n_words, round(coalesce(l.ls, 0.0), 4) AS log_score,
               round(coalesce(l.ls, 0.0) / greatest(len(t.w), 1), 6) AS mean_log_score
        FROM t LEFT JOIN l ON l.rid = t.rid""",
    "op11_periodic_runs": r"""
        WITH d AS (
            SELECT row_number() OVER () AS rid, doc_id,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        crc AS (  -- crc32 of the decimal id, a bit at a time: 256 + byte mixes a byte in, 0 shifts
            SELECT *, len(w) AS n, xor(CAST(4294967295 AS BIGINT), list_reduce(
                       list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(
                           string_split(CAST(doc_id AS VARCHAR), ''),
                           lambda c: [CAST(256 + ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0]))),
                       lambda s, x: CASE WHEN x >= 256 THEN xor(s, x - 256)
                                         WHEN s % 2 = 1 THEN xor(s >> 1, CAST(3988292384 AS BIGINT))
                                         ELSE s >> 1 END)) AS h
            FROM d),
        tail AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a, h // 10 AS g FROM crc),
        cut AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM tail),
        v AS (
            SELECT rid, n, i, w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END] AS word
            FROM (SELECT *, unnest(range(0, n)) AS i FROM cut)),
        hit AS (
            SELECT b.rid, b.i - a.i AS q, b.i AS i
            FROM v AS a JOIN v AS b ON a.rid = b.rid AND a.word = b.word AND b.i > a.i AND b.i - a.i <= a.n // 4),
        lane AS (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS isle FROM hit),
        seg AS (
            SELECT rid, q, min(i) - q AS s, count(*) + q AS l
            FROM lane GROUP BY rid, q, isle HAVING count(*) + q >= greatest(6, 4 * q)),
        run AS (SELECT rid, s, l, min(q) AS q FROM seg GROUP BY rid, s, l),
        told AS (
            SELECT rid, count(*) AS n_runs, arg_max(s, (l, -s, -q)) AS s, arg_max(l, (l, -s, -q)) AS l,
                   arg_max(q, (l, -s, -q)) AS q, sha256(string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q)) AS rs
            FROM run GROUP BY rid),
        gone AS (SELECT DISTINCT rid, unnest(range(s + q, s + l)) AS i FROM run),
        left_over AS (
            SELECT v.rid, sha256(string_agg(word, ' ' ORDER BY v.i)) AS cs
            FROM v LEFT JOIN gone ON gone.rid = v.rid AND gone.i = v.i WHERE gone.i IS NULL GROUP BY v.rid)
        SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, l AS length, q AS period,
               1000 * l // q AS exponent_milli, coalesce(rs, sha256('')) AS runs_sha256,
               coalesce(cs, sha256('')) AS collapsed_sha256
        FROM d LEFT JOIN told ON told.rid = d.rid LEFT JOIN left_over ON left_over.rid = d.rid""",
    "op13_minhash": r"""
        WITH RECURSIVE d AS MATERIALIZED (
            SELECT row_number() OVER () AS r, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        s AS MATERIALIZED (
            SELECT DISTINCT r, unnest(CASE WHEN len(w) = 0 THEN []
                WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g
            FROM d),
        n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
        l AS MATERIALIZED (
            SELECT c.a, c.b FROM (SELECT x.r AS a, y.r AS b, count(*) AS k
                                  FROM s AS x JOIN s AS y ON x.g = y.g AND x.r < y.r GROUP BY ALL) AS c
            JOIN n AS p ON p.r = c.a JOIN n AS q ON q.r = c.b
            WHERE 100 * c.k >= 85 * (p.n + q.n - c.k)),
        e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        reach AS (
            SELECT r, r AS t FROM d
            UNION
            SELECT reach.r, e.b FROM reach JOIN e ON e.a = reach.t),
        c AS (SELECT reach.r, min(o.doc_id) AS component_id FROM reach JOIN d AS o ON o.r = reach.t GROUP BY reach.r)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id,
               d.doc_id IS NOT DISTINCT FROM c.component_id AS kept
        FROM d JOIN c ON c.r = d.r LEFT JOIN n ON n.r = d.r""",
}
