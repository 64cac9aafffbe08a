"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitplanes, bpe, chat, common, media, minhash, nbsvm, packing, quality_rules, simhash, token_count, token_output, warc, whitening
from . import pipeline as stages
from .pipeline import BYTE_BPE, table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(table(spark, sf_dir, "documents"), BYTE_BPE)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), WORD_BPE)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive_pages(table(spark, sf_dir, "pages"))
    return warc.page_digests(warc.read_archives(index, with_data=False))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = "</s>[INST] ok [/INST]"
    own = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(told).alias("text")) for k, role in enumerate(("user", "assistant"))])).alias("r")).select("r.*")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    windows = common.materialize(chat.format_windows(rows, budget=1024), "windows")
    return chat.conversation_digests(windows)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), BYTE_BPE)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_online(table(spark, sf_dir, "documents"), BYTE_BPE, keep_ids=False).drop("ids")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(table(spark, sf_dir, "embeddings"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_components(table(spark, sf_dir, "documents"))


def op13_bitplanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplanes.cluster_report(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run(spark, sf_dir)


_QUERIES = [op1_token_output, op2_bpe, op3_warc, op4_chat, op5_simhash, op6_quality_rules, op7_nbsvm, op8_token_counts, op9_packing, op10_media, op11_whitening, op12_minhash, op13_bitplanes, pipeline]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def ready(query):
        @functools.wraps(query)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            common.workers_import_this(spark)
            return query(spark, sf_dir)

        return run

    return {q.__name__: ready(q) for q in _QUERIES}


_MINHASH_SQL = r"""
    WITH RECURSIVE w AS (
        SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
    shingles AS MATERIALIZED (
        SELECT DISTINCT r, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN words ELSE list_transform(range(1, len(words)), lambda k: words[k] || ' ' || words[k + 1]) END) AS s FROM w),
    sizes AS MATERIALIZED (SELECT r, count(*) AS n FROM shingles GROUP BY r),
    links AS MATERIALIZED (
        SELECT a.r AS a, b.r AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.r < b.r JOIN sizes x ON x.r = a.r JOIN sizes y ON y.r = b.r
        GROUP BY a.r, b.r, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
    twoway AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach AS (SELECT r, r AS other FROM w UNION SELECT reach.r, twoway.b FROM reach JOIN twoway ON reach.other = twoway.a),
    least AS (SELECT reach.r, min(o.doc_id) AS component_id FROM reach JOIN w o ON o.r = reach.other GROUP BY reach.r)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM w JOIN least USING (r) LEFT JOIN sizes USING (r)"""


def _clusters_sql(k: int = 8, rounds: int = 10) -> str:
    """Each round's assignment and centres as two steps, on rows of one component each."""
    near = lambda c: f"SELECT v.r, c.cluster, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN {c} c USING (i) GROUP BY v.r, c.cluster"
    told = lambda c: f"SELECT r, arg_min(cluster, struct_pack(d := d, c := cluster)) AS cluster, min(d) AS distance FROM ({near(c)}) GROUP BY r"
    steps = []
    for n in range(1, rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED ({told(f'c{n - 1}')})")
        means = f"SELECT cluster, i, sum(x) AS s, count(*) AS n FROM a{n} JOIN v USING (r) GROUP BY cluster, i"
        steps.append(f"c{n} AS MATERIALIZED (SELECT c.cluster, c.i, coalesce(CAST((s - ((s % n) + n) % n) // n AS BIGINT), c.x) AS x FROM c{n - 1} c LEFT JOIN ({means}) m USING (cluster, i))")
    return f"""
        WITH own AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS xs FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        v AS MATERIALIZED (SELECT r, unnest(xs) AS x, unnest(range(1, 65)) AS i FROM own),
        starts AS MATERIALIZED (SELECT r, row_number() OVER (ORDER BY sha256('3:' || vec_id), xs) - 1 AS cluster FROM own QUALIFY cluster < {k}),
        c0 AS MATERIALIZED (SELECT cluster, i, x FROM starts JOIN v USING (r)),
        {", ".join(steps)},
        last AS MATERIALIZED ({told(f"c{rounds}")}),
        digests AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
        SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
               CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
        FROM last JOIN own USING (r) JOIN digests USING (cluster)"""


def oracle_sql() -> dict[str, str]:
    """Archives, links of whole sets and clusters can be said in SQL; tests hold the others against brute force."""
    payload = "coalesce(html, '')"
    return {
        "op3_warc": f"""
            WITH p AS (SELECT page_id, strlen({payload}) AS payload_bytes, sha1({payload}) AS payload_digest FROM pages),
            m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS response FROM p)
            SELECT page_id, payload_bytes, payload_digest,
                   CASE WHEN payload_bytes >= 1000 AND response <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN payload_bytes >= 1000 AND response <> page_id THEN response END AS refers_to
            FROM m""",
        "op12_minhash": _MINHASH_SQL,
        "op13_bitplanes": _clusters_sql(),
    }
