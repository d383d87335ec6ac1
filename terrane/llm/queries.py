"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.sources.tables import spread

from .common import documents
from .divergence import divergence
from .exact_dedup import exact_dedup
from .importance import resample
from .katz import katz_scores
from .langid import identify
from .mixing import mix_sources
from .oracles import DIVERGENCE, SIMHASH, SPELLING, WARC
from .oracles import winnowing as winnowing_sql
from .packing import pack
from .pii import pseudonymise
from .sharding import place
from .simhash import near_groups
from .spelling import corpus_words, spelling_variants
from .warc import archived_pages
from .winnowing import edited_fingerprints

#: A key for test data; a real one comes from the caller.
PII_KEY = "not a secret"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mix_sources(documents(spark, sf_dir))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "virtual_finish")


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(documents(spark, sf_dir), key=PII_KEY)


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


def op7_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities are rounded to a millionth, so that the order of their sum can't show."""
    scored = katz_scores(documents(spark, sf_dir))
    return scored.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir))


def op9_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(documents(spark, sf_dir))


def op10_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(documents(spark, sf_dir))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(corpus_words(documents(spark, sf_dir), every=199))


def op13_warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(spread(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_mix_sources": op2_mix_sources,
        "op3_winnowing": op3_winnowing,
        "op4_pii_pseudonyms": op4_pii_pseudonyms,
        "op5_importance_resampling": op5_importance_resampling,
        "op6_language_id": op6_language_id,
        "op7_katz_scores": op7_katz_scores,
        "op8_simhash_groups": op8_simhash_groups,
        "op9_rendezvous_shards": op9_rendezvous_shards,
        "op10_curve_packing": op10_curve_packing,
        "op11_source_divergence": op11_source_divergence,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_warc_records": op13_warc_records,
    }


#: CRC-32 of the digits of doc_id, byte by byte and bit by bit, which DuckDB has no function for.
CRC_OF_ID = """
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
        lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, step: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)
"""

ORACLE = {
    "op9_rendezvous_shards": """
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS key, strlen(coalesce(text, '')) + 8 AS size,
                   list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM documents),
        c AS (SELECT * EXCLUDE bytes, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes),
                  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, step: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) AS text_crc32 FROM d),
        bids AS (SELECT row, i, -ln((CAST('0x' || substr(md5(key || ':' || i), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656::DOUBLE) AS bid FROM d, range(25) t(i)),
        won AS (SELECT row, CAST(arg_min(i, bid) FILTER (i < 24) AS INT) AS shard, CAST(arg_min(i, bid) AS INT) AS grown_shard FROM bids GROUP BY row),
        placed AS (SELECT *, md5('slot:' || key || ':' || text_crc32) AS slot_hash, CAST('0x' || substr(md5('slot:' || key || ':' || text_crc32), 1, 8) AS BIGINT) % 4096 AS bucket FROM c JOIN won USING (row))
        SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, slot_hash, doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM placed
    """,
    "op2_mix_sources": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                   md5('20:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS h FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, ([5.0, 2.0, 1.0]::DOUBLE[])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM d GROUP BY source),
        c AS (SELECT *, source_size * 3 AS cap, coalesce(sum(source_size * 3) OVER dry, 0) AS capped_before, sum(weight) OVER later AS weight_left, sum(source_size) OVER () AS budget FROM s
              WINDOW dry AS (ORDER BY source_size * 3 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                     later AS (ORDER BY source_size * 3 / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
        v AS (SELECT *, CAST(budget - capped_before AS DOUBLE) / weight_left AS v FROM c),
        t AS (SELECT *, least(CAST(cap AS DOUBLE), weight * coalesce((SELECT min_by(v, capped_before) FROM v WHERE cap / weight > v), 0.0)) AS target FROM v),
        q AS (SELECT doc_id, size, source_size, weight, target, CAST(round(target) AS BIGINT) AS quota, CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               CAST(list_sum(list_transform([0, 1, 2], lambda e: greatest(0, least(size, quota - source_size * e - before)))) AS BIGINT) AS taken, (before + size) / weight AS virtual_finish FROM q
    """,
    "op7_katz_scores": rf"""
        WITH d AS (SELECT doc_id, {CRC_OF_ID} % 7 = 2 AS held_out,
                   list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS w FROM documents),
        tok AS (SELECT doc_id, held_out, unnest(list_prepend('', w[:-2])) AS h, unnest(w) AS w FROM d),
        u AS (SELECT w, count(*) AS c FROM tok WHERE NOT held_out GROUP BY w),
        b AS (SELECT h, w, count(*) AS c FROM tok WHERE NOT held_out GROUP BY h, w),
        of AS (SELECT 1 AS n, c AS r, count(*) AS m FROM u GROUP BY c UNION ALL SELECT 2, c, count(*) FROM b GROUP BY c),
        total AS (SELECT sum(c) AS tokens, count(*) AS types FROM u),
        -- Good-Turing discounts for each cut-off, and the largest cut-off of which all are between 0 and 1
        tried AS (SELECT o.n, k, o.r, (((o.r + 1) * CAST(up.m AS DOUBLE) / (o.r * CAST(o.m AS DOUBLE))) - (k + 1) * CAST(last.m AS DOUBLE) / one.m) / (1 - (k + 1) * CAST(last.m AS DOUBLE) / one.m) AS d, (k + 1) * CAST(last.m AS DOUBLE) / one.m AS common
                  FROM of o JOIN (SELECT unnest([2, 3, 4, 5]) AS k) ON o.r <= k JOIN of up ON up.n = o.n AND up.r = o.r + 1 JOIN of last ON last.n = o.n AND last.r = k + 1 JOIN of one ON one.n = o.n AND one.r = 1),
        best AS (SELECT n, max(k) AS k FROM (SELECT n, k FROM tried GROUP BY n, k HAVING count(*) = k AND bool_and(d > 0 AND d < 1) AND bool_and(common < 1)) GROUP BY n),
        discount AS (SELECT n, r, d FROM tried JOIN best USING (n, k)),
        constant AS (SELECT n, CASE WHEN one = 0 THEN 0.5 ELSE least(0.9, greatest(0.1, one / CAST(one + 2 * two AS DOUBLE))) END AS x
                     FROM (SELECT n, coalesce(sum(m) FILTER (r = 1), 0) AS one, coalesce(sum(m) FILTER (r = 2), 0) AS two FROM (SELECT * FROM of UNION ALL SELECT 1, 0, 0 UNION ALL SELECT 2, 0, 0) GROUP BY n) WHERE n NOT IN (SELECT n FROM best)),
        less(n, c, x) AS (SELECT o.n, o.r, CASE WHEN k.x IS NOT NULL THEN o.r - k.x ELSE o.r * coalesce(g.d, 1) END FROM of o LEFT JOIN constant k ON k.n = o.n LEFT JOIN discount g ON g.n = o.n AND g.r = o.r),
        p1 AS (SELECT u.w, u.c, less.x / tokens AS p FROM u JOIN less ON less.n = 1 AND less.c = u.c, total),
        unknown AS (SELECT coalesce((SELECT sum(m * (r - x)) FROM of JOIN less ON less.n = 1 AND of.n = 1 AND less.c = of.r) / any_value(tokens), 1) AS p FROM total),
        contexts AS (SELECT b.h, sum(b.c) AS c, sum(b.c - less.x) AS freed, sum(p1.p) AS held FROM b JOIN less ON less.n = 2 AND less.c = b.c JOIN p1 USING (w) GROUP BY b.h),
        ctx AS (SELECT h, CASE WHEN freed > 1e-9 THEN c ELSE c + 1 END AS divisor, CASE WHEN freed > 1e-9 THEN freed / c ELSE 1.0 / (c + 1) END / (1 - held) AS weight FROM contexts),
        scored AS (SELECT tok.doc_id, tok.held_out, coalesce(p1.c, 0) AS c,
                   log10(CASE WHEN b.c IS NOT NULL THEN l2.x / ctx.divisor ELSE coalesce(ctx.weight, 1) * coalesce(p1.p, unknown.p) END) AS s
                   FROM tok LEFT JOIN p1 ON p1.w = tok.w LEFT JOIN b ON b.h = tok.h AND b.w = tok.w LEFT JOIN less l2 ON l2.n = 2 AND l2.c = b.c LEFT JOIN ctx ON ctx.h = tok.h, unknown)
        SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, CAST(any_value(tokens) AS BIGINT) AS train_tokens,
               round(sum(log10((c + 1) / CAST(tokens + types + 1 AS DOUBLE))), 6) AS base_score, round(sum(s), 6) AS score
        FROM scored, total GROUP BY doc_id, held_out
    """,
    "op1_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, sha256(body) AS text_sha256
        FROM d WINDOW g AS (PARTITION BY body)
    """,
}


def oracle_sql() -> dict[str, str]:
    return ORACLE | {"op3_winnowing": winnowing_sql(), "op8_simhash_groups": SIMHASH, "op11_source_divergence": DIVERGENCE, "op12_spelling_variants": SPELLING, "op13_warc_records": WARC}
