"""Queries of the numbered operators and the pipeline, with SQL for DuckDB where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language, lexical, licenses, lines, maxent, quality, sentencepiece, simhash, token_counts, token_files, warc, whitening
from .common import fresh, table


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def document_path() -> F.Column:
    """Documents as a tree: source / thousand / hundred / file; each hundred's first is its LICENSE, each thousand's its directory's."""
    hundred = F.floor(F.col("doc_id") / 100).cast("string")
    thousand = F.floor(F.col("doc_id") / 1000).cast("string")
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt"))
    deep = F.concat_ws("/", "source", thousand, hundred, F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("LICENSE."), F.col("doc_id").cast("string"))).otherwise(name))
    return F.when(F.col("doc_id") % 1000 == 1, F.concat_ws("/", "source", thousand, F.concat(F.lit("LICENSE."), F.col("doc_id").cast("string")))).otherwise(deep)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(document_path().alias("path"), "text")
    found = licenses.scan(docs)
    return found.select(F.regexp_extract("path", "([0-9]+)[^/]*$", 1).cast("long").alias("doc_id"), "*")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("__sha", F.sha1(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    got = sentencepiece.encode(docs, tokenizer("piece_bpe_32k.model"), {"doc_id": "doc_id", "text_sha1": "__sha"})
    return got.select("doc_id", "n_tokens", "ids", F.sha1(F.col("decoded").cast("binary")).alias("decoded_sha1"), (F.sha1(F.col("decoded").cast("binary")) == F.col("text_sha1")).alias("round_trip"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language.fit(docs.where(language.fold() != 1))
    return language.identify(docs, model, {"doc_id": "doc_id", "held_out": language.fold() == 1})


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = language.fold(of=7) == 2
    model, counts = maxent.fit(docs.where(~held))
    return maxent.score(docs, model, counts, {"doc_id": F.col("doc_id"), "held_out": held})


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lines.dedup_lines(read(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(read(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "token-files")
    token_files.write(read(spark, sf_dir, "documents"), path, tokenizer("byte_bpe_50k.json"))
    return token_files.digests(spark, path)


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build(read(spark, sf_dir, "documents"))
    found = table(lexical.search(index, read(spark, sf_dir, "benchmark")), "ranked")
    index.drop()
    return found


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_simhash, op2_licenses, op3_sentencepiece, op4_warc, op5_token_counts, op6_language, op7_decontaminate, op8_lm_score, op9_line_dedup, op10_quality, op11_whitening, op12_token_files, op13_search, pipeline)
}

def license_sql() -> str:
    """Lines and paragraphs against the templates by TF-IDF cosine, and inheritance, in one statement."""
    quoted = lambda w: "'" + w + "'"
    postings = ", ".join(f"({k}, {rank}, '{name}', '{w}', {n}, {int(w in need)})" for k, (rank, name, t, need) in enumerate(licenses.all_templates()) for w, n in t.items())
    words = f"list_transform(list_filter(list_transform(regexp_split_to_array(lower(y), '[^a-z0-9.]+'), lambda x: trim(x, '.')), lambda x: x <> '' AND x NOT IN ({', '.join(map(quoted, licenses.STOP_WORDS))})), lambda x: regexp_replace(x, '{licenses.VERSION}', '\\1'))"
    return rf"""
        WITH t(k, rank, license, w, tf, needed) AS (VALUES {postings}),
        f AS (
          SELECT doc_id, coalesce(text, '') AS text,
                 CASE WHEN doc_id % 1000 = 1 THEN concat_ws('/', source, (doc_id // 1000)::VARCHAR, 'LICENSE.' || doc_id)
                      ELSE concat_ws('/', source, (doc_id // 1000)::VARCHAR, (doc_id // 100)::VARCHAR, CASE WHEN doc_id % 10 = 0 THEN 'LICENSE.' || doc_id ELSE 'doc' || doc_id || '.txt' END) END AS path
          FROM documents),
        s AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM f),
        l AS (
          SELECT *, flatten(parts) AS w
          FROM (SELECT doc_id, i - 1 AS line_no, s[i] AS line, list_transform(regexp_split_to_array(s[i], '{licenses.SENTENCE_END}'), lambda y: {words}) AS parts FROM s, unnest(range(1, len(s) + 1)) AS r(i))),
        total AS (SELECT count(*) AS n FROM l WHERE line <> ''),
        df AS (SELECT w, count(DISTINCT (doc_id, line_no)) AS n FROM (SELECT doc_id, line_no, unnest(w) AS w FROM l) WHERE w IN (SELECT w FROM t) GROUP BY w),
        idf AS (SELECT t.w, ln((1.0 + total.n) / (1 + coalesce(df.n, 0))) + 1 AS x FROM (SELECT DISTINCT w FROM t) t CROSS JOIN total LEFT JOIN df USING (w)),
        q AS (SELECT k, rank, license, w, needed, sum(needed) OVER (PARTITION BY k) AS n_needed, tf * x / sqrt(sum((tf * x) * (tf * x)) OVER (PARTITION BY k)) AS q FROM t JOIN idf USING (w)),
        g AS (SELECT *, sum((len(w) = 0)::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM l),
        u AS (
          SELECT doc_id, line_no, 1 AS n_lines, w FROM l WHERE len(w) > 0
          UNION ALL SELECT doc_id, line_no, -j, parts[j] FROM l, unnest(range(1, len(parts) + 1)) AS r(j) WHERE len(parts) > 1 AND len(parts[j]) > 0
          UNION ALL SELECT doc_id, min(line_no), count(*), flatten(list(w ORDER BY line_no)) FROM g WHERE len(w) > 0 GROUP BY doc_id, run HAVING count(*) > 1),
        h AS (
          SELECT doc_id, line_no, n_lines, v.w, count(*) * any_value(x) AS p, any_value(n) AS n, count(*) AS tf
          FROM (SELECT doc_id, line_no, n_lines, unnest(w) AS w, len(w) AS n FROM u) v JOIN idf USING (w) GROUP BY doc_id, line_no, n_lines, v.w),
        norm AS (
          SELECT doc_id, line_no, n_lines, sqrt(sum(p * p) + (any_value(n) - sum(tf)) * pow(ln(1.0 + (SELECT n FROM total)) + 1, 2)) AS norm
          FROM h GROUP BY doc_id, line_no, n_lines HAVING sum(tf) >= any_value(n) * {licenses.MIN_SHARE}),
        scored AS (
          SELECT doc_id, line_no, rank, license, round(sum(p * q) / any_value(norm), 6) AS score
          FROM h JOIN norm USING (doc_id, line_no, n_lines) JOIN q USING (w) GROUP BY doc_id, line_no, n_lines, k, rank, license HAVING sum(needed) = any_value(n_needed)),
        own AS (SELECT doc_id, license, score, line_no FROM scored WHERE score >= {licenses.MIN_COSINE} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY rank, score DESC, line_no, license) = 1),
        d AS (SELECT f.doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir, license, score, line_no FROM f LEFT JOIN own USING (doc_id)),
        top AS (
          SELECT dir, license, path FROM d WHERE license IS NOT NULL AND regexp_matches(path, '(?i)(^|/)(licen[cs]e|copying|notice|copyright)([._-][^/]*)?$')
          QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, path) = 1),
        up AS (
          SELECT d.doc_id, top.license, top.path FROM d JOIN top ON top.dir = '' OR d.dir = top.dir OR starts_with(d.dir, top.dir || '/')
          QUALIFY row_number() OVER (PARTITION BY d.doc_id ORDER BY length(top.dir) DESC) = 1)
        SELECT doc_id, d.path, coalesce(d.license, up.license) AS license, score, line_no::INT AS line_no,
               CASE WHEN d.license IS NOT NULL THEN 'file' WHEN up.license IS NOT NULL THEN 'directory' END AS origin,
               CASE WHEN d.license IS NULL THEN up.path END AS inherited_from
        FROM d LEFT JOIN up USING (doc_id)"""


# XXH64 of shingles (1), trained models (6, 8), tokenizers (3, 5, 12, pipeline) and eigenvectors (11) have no SQL here; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_licenses": license_sql(),
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, sha1(html) AS digest, strlen(html) AS n FROM p),
        r AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest, n) ELSE page_id END AS response FROM d)
        SELECT page_id, n AS payload_bytes, digest AS payload_digest,
               CASE WHEN response = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN response <> page_id THEN response END AS refers_to
        FROM r""",
    "op7_decontaminate": r"""
        WITH iw AS (
          SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM benchmark WHERE text IS NOT NULL),
        windows AS (
          SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
          FROM iw, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
        dw AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM documents),
        sizes AS (SELECT DISTINCT n FROM windows),
        hits AS (
          SELECT doc_id, i, g.n, item_id
          FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM dw, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)) g
          JOIN windows ON g.s = windows.s AND g.n = windows.n),
        words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
        found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id)
        SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op9_line_dedup": r"""
        WITH l AS (
          SELECT doc_id, source, t, i, s[i] AS line, nullif(trim(regexp_replace(translate(s[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\x0B\f\r]+', ' ', 'g'), ' '), '') AS h
          FROM (SELECT doc_id, source, sha256(coalesce(text, '')) AS t, string_split(coalesce(text, ''), chr(10)) AS s FROM documents), unnest(range(1, len(s) + 1)) AS r(i)),
        bad AS (SELECT h FROM l WHERE h IS NOT NULL GROUP BY h HAVING count(DISTINCT coalesce(source, chr(0))) >= 5 AND count(DISTINCT t) >= 5)
        SELECT doc_id, count(l.h) AS n_lines, count(bad.h) AS n_removed_lines,
               sha256(coalesce(string_agg(CASE WHEN bad.h IS NULL THEN line END, chr(10) ORDER BY i), '')) AS text_sha256
        FROM l LEFT JOIN bad ON l.h = bad.h GROUP BY doc_id""",
    "op10_quality": r"""
        WITH d AS (
          SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
                 regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        l AS (
          SELECT doc_id, host, t, i, s[i] AS line, regexp_extract_all(s[i], '[^\x20\x09-\x0D]+') AS lw,
                 translate(array_to_string(regexp_extract_all(s[i], '[^\x20\x09-\x0D]+'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h
          FROM (SELECT doc_id, host, sha256(text) AS t, string_split(text, chr(10)) AS s FROM d), unnest(range(1, len(s) + 1)) AS t(i)),
        dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE len(lw) > 0 GROUP BY doc_id),
        win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM d, unnest(range(1, len(w) - 6)) AS t(i)),
        twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
        rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM twice, unnest(range(i, i + 8)) AS t(p) GROUP BY doc_id),
        bad AS (SELECT host, h FROM l WHERE h <> '' GROUP BY host, h HAVING count(DISTINCT t) > 100),
        lost AS (SELECT doc_id, sum(len(lw)) AS n FROM l JOIN bad USING (host, h) GROUP BY doc_id),
        b AS (
          SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
                 coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS n_removed_words
          FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id))
        SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
               NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - n_removed_words >= 20 AS kept
        FROM b""",
    "op13_search": r"""
        WITH d AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        q AS (
          SELECT item_id, t, count(*) AS times FROM (
            SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark)
          GROUP BY item_id, t),
        s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
        p AS (
          SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY doc_id, n, t),
        f AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM p, s GROUP BY t, n_docs),
        i AS (SELECT doc_id, t, weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms))) AS impact FROM p JOIN f USING (t), s),
        r AS (SELECT item_id, doc_id, sum(times * impact)::BIGINT AS score FROM q JOIN i USING (t) GROUP BY item_id, doc_id HAVING sum(times * impact) > 0)
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM r QUALIFY rank <= 10""",
}
