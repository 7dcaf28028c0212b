"""The numbered queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.exact import exact_groups
from tidemark.llm.kneser_ney import score_documents
from tidemark.llm.langid import identify
from tidemark.llm.lines import Rule, line_report
from tidemark.llm.media import copies_report, drawn, edited, find_copies, spread
from tidemark.llm.merkle import document_manifest
from tidemark.llm.mixing import mix_documents
from tidemark.llm.pii import personal_data, personal_data_digest
from tidemark.llm.segment import Sampling, segmentations
from tidemark.llm.shared import ship
from tidemark.llm.simhash import as_hex, near_duplicates
from tidemark.llm.spelling import variants
from tidemark.llm.sstable import encode_documents
from tidemark.llm.toxicity import toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_documents(spark, sf_dir))
    return found.withColumn("fingerprint", as_hex(F.col("fingerprint")))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data_digest(personal_data(_documents(spark, sf_dir)))


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op4_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth drawing, with one of four edits, is sought among all drawings of the vectors; a row a query lists all that it finds."""
    ship(spark)
    vectors = spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding"))
    images = vectors.select("id", drawn("embedding").alias("image"))
    asked = images.where("id % 100 = 0").select("id", edited("image", F.expr("id div 100")).alias("image"))
    return copies_report(find_copies(asked, images))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_documents(spark, sf_dir))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    found = segmentations(_documents(spark, sf_dir), model, Sampling(remembered=2_500_000, held=True, portion=1 << 21))
    return found.select(
        "doc_id", "sample", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"),
        "decoded_sha256", "log_prob", "perturbed", "inclusion",
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(_documents(spark, sf_dir))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(_documents(spark, sf_dir), Rule(equal=1))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_documents(spark, sf_dir))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_documents(spark, sf_dir))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_manifest(_documents(spark, sf_dir))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(_documents(spark, sf_dir))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


SQL = {
    "op7_mixing": r"""
        WITH d AS (
          SELECT row_number() OVER () AS row, doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest,
                 coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
          FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (
          SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no, 2 * source_size AS most,
                 1.5::DOUBLE * sum(source_size) OVER () AS wanted FROM s),
        r AS (SELECT *, [5, 2, 1][1 + no % 3] AS weight FROM w),
        v AS (
          SELECT *, (wanted - coalesce(sum(most) OVER (ORDER BY most / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                   / sum(weight) OVER (ORDER BY most / weight, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
          FROM r),
        t AS (
          SELECT *, CASE WHEN most <= level * weight THEN CAST(most AS DOUBLE)
                    ELSE weight * max(CASE WHEN most > level * weight THEN level END) OVER () END AS target
          FROM v),
        l AS (
          SELECT d.row, d.doc_id, t.no, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS take,
                 coalesce(sum(d.size) OVER (PARTITION BY t.no ORDER BY d.digest, d.doc_id, d.size
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        p AS (
          SELECT no, target, take, CAST(floor(sum(target) OVER (ORDER BY no) / greatest(sum(target) OVER (), 1e-300) * 4294967296) AS BIGINT) AS hi,
                 (take + 255) // 256 AS needed, count(*) OVER () AS n_sources, (sum(take) OVER () + 255) // 256 AS slots
          FROM (SELECT *, CAST(floor(target) AS BIGINT) AS take FROM t)),
        q AS (SELECT *, lag(hi, 1, 0) OVER (ORDER BY no) AS lo FROM p),
        u AS (SELECT i AS slot, (i % 2147483648) * 2654435769 % 4294967296 AS u FROM (SELECT unnest(range(CAST((SELECT coalesce(max(slots), 0) FROM q) AS BIGINT))) AS i)),
        r2 AS (SELECT slot, no, needed, row_number() OVER (PARTITION BY no ORDER BY slot) - 1 AS turn FROM u JOIN q ON u >= lo AND u < hi),
        had AS (SELECT no, count(*) AS had FROM r2 GROUP BY no),
        c AS (
          SELECT slot, no, turn FROM r2 WHERE turn < needed
          UNION ALL SELECT slots + turn * n_sources + no, no, turn FROM (
            SELECT q.no, slots, n_sources, unnest(range(CAST(coalesce(had, 0) AS BIGINT), CAST(needed AS BIGINT))) AS turn FROM q LEFT JOIN had USING (no))),
        a AS (SELECT l.*, pass, pass * source_size + begin AS low, least(pass * source_size + begin + size, take) AS high FROM l, (VALUES (0), (1)) v(pass) WHERE size > 0),
        b AS (SELECT *, unnest(range(CAST(low // 256 AS BIGINT), CAST((high - 1) // 256 + 1 AS BIGINT))) AS turn FROM a WHERE high > low),
        w2 AS (
          SELECT row, CAST(sum(least(high, (b.turn + 1) * 256) - greatest(low, b.turn * 256)) AS BIGINT) AS taken, CAST(min(slot) AS BIGINT) AS first_slot, count(DISTINCT slot) AS n_slots
          FROM b JOIN c ON c.no = b.no AND c.turn = b.turn GROUP BY row)
        SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, first_slot, coalesce(n_slots, 0) AS n_slots FROM l LEFT JOIN w2 USING (row)""",
    "op9_exact_dedup": r"""
        WITH n AS (
          SELECT doc_id, length(coalesce(text, '')) AS n_points,
                 translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS t
          FROM documents),
        g AS (
          SELECT *, first_value(doc_id) OVER (PARTITION BY t ORDER BY n_points DESC, doc_id) AS keep_id,
                 count(*) OVER (PARTITION BY t) AS group_size
          FROM n)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256, n_points FROM g""",
    "op11_manifest": r"""
        WITH RECURSIVE d AS (
          SELECT row_number() OVER () AS row, doc_id, lang, n_chars,
                 coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
                 || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS front,
                 coalesce(octet_length(encode(text)) || ':' || text, '-') AS back
          FROM documents),
        crc AS (
          SELECT list(v ORDER BY i) AS crc FROM (
            SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
            FROM range(256) t(i))),
        e AS (
          SELECT row, doc_id, lang, sha256(front || coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || back) AS leaf,
                 CASE WHEN xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                                lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1])), 4294967295) % 7 = 0
                 THEN sha256(front || coalesce(length(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || back) END AS tampered
          FROM d, crc),
        l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS i FROM e),
        t AS (
          SELECT lang, 0 AS level, i, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM l
          UNION ALL
          SELECT lang, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY lang, level, i // 2, n),
        s AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i FROM t WHERE n = 1),
        u AS (
          SELECT 0 AS level, i, subroot AS h, count(*) OVER () AS n FROM s
          UNION ALL
          SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY level, i // 2, n),
        beside AS (
          SELECT l.row, a.level, o.h, l.i >> a.level AS place FROM l JOIN (SELECT DISTINCT lang, level FROM t WHERE n > 1) a ON a.lang IS NOT DISTINCT FROM l.lang
          LEFT JOIN t o ON o.lang IS NOT DISTINCT FROM l.lang AND o.level = a.level AND o.i = xor(l.i >> a.level, 1)
          UNION ALL
          SELECT l.row, 1000 + a.level, o.h, s.i >> a.level FROM l JOIN s ON s.lang IS NOT DISTINCT FROM l.lang CROSS JOIN (SELECT DISTINCT level FROM u WHERE n > 1) a
          LEFT JOIN u o ON o.level = a.level AND o.i = xor(s.i >> a.level, 1)),
        p AS (
          SELECT row, sha256(coalesce(string_agg(h, '' ORDER BY level), '')) AS proof_sha256,
                 list(CASE WHEN h IS NULL THEN '-' WHEN place % 2 = 1 THEN 'L' || h ELSE 'R' || h END ORDER BY level) AS steps
          FROM beside GROUP BY row),
        f AS (
          SELECT l.row, doc_id, leaf, subroot, (SELECT h FROM u WHERE n = 1) AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256,
                 list_reduce(list_prepend(coalesce(tampered, leaf), coalesce(steps, [])), lambda h, x: CASE WHEN x = '-' THEN sha256(h) WHEN x[1] = 'L' THEN sha256(x[2:] || h) ELSE sha256(h || x[2:]) END) AS folded_root
          FROM l LEFT JOIN p ON p.row = l.row JOIN s ON s.lang IS NOT DISTINCT FROM l.lang)
        SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM f""",
    "op12_spelling": r"""
        WITH RECURSIVE crc AS (
          SELECT list(v ORDER BY i) AS crc FROM (
            SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
            FROM range(256) t(i))),
        m AS (
          SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS front,
                 unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run
          FROM documents),
        k AS (SELECT front, run, count(*) AS n FROM m GROUP BY ALL),
        h AS (
          SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, octet_length(encode(front || run))), lambda i: CAST('0x' || substr(hex(encode(front || run)), 2 * i + 1, 2) AS BIGINT))),
                             lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1])), 4294967295) AS h
          FROM k, crc WHERE length(run) >= 7),
        w AS (
          SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n
          FROM h GROUP BY 1 HAVING sum(n) >= 2 AND length(word) >= 7),
        cuts AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
        less AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM cuts),
        holes AS (SELECT word, n, substr(word, 1, i - 1) || '_' || substr(word, i + 1) AS rest FROM cuts),
        near AS (
          SELECT a.word, b.word AS near, b.n FROM holes a JOIN holes b USING (rest) WHERE a.word <> b.word
          UNION SELECT a.word, b.word, b.n FROM less a JOIN w b ON b.word = a.rest
          UNION SELECT b.word, a.word, a.n FROM less a JOIN w b ON b.word = a.rest),
        top AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS near, max(n) AS most FROM near GROUP BY word),
        f AS (
          SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * w.n THEN near END AS form, CASE WHEN most >= 10 * w.n THEN most END AS form_n
          FROM w LEFT JOIN top USING (word)),
        chain AS (
          SELECT word, form AS root FROM f WHERE form IS NOT NULL
          UNION ALL SELECT c.word, f.form FROM chain c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL),
        ends AS (SELECT c.word, c.root FROM chain c JOIN f ON f.word = c.root WHERE f.form IS NULL)
        SELECT f.word, n, n_near, form, form_n, coalesce(root, f.word) AS root FROM f LEFT JOIN ends USING (word)""",
}
