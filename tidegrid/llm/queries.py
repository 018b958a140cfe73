"""Registered queries of this package, each over whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, quality
from .alignment import alignments
from .binary_ids import token_ids
from .codes import vector_codes
from .decontaminate import contaminated
from .neardup import near_duplicates
from .packing import pack_documents
from .repetition import (
    LEAST_WORDS,
    MOST_LINE_CHARS,
    MOST_LINES,
    MOST_REPEAT_WORDS,
    MOST_REPEATED_RUNS,
    MOST_TOP_RUN,
    repetition_rules,
)
from .substring import without_repeats
from .tokens import token_counts
from .vafile import top_k
from .warc import archived_pages


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(parts: int) -> Column:
    """Remainder of the checksum of doc_id written as text; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def op1_fm_index_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return without_repeats(documents, columns=["doc_id", "text"], keep_text=False).drop("text")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, a, md5(array_to_string(w[a : a + 34], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS a FROM d WHERE len(w) >= 35)
), rep AS (
  SELECT doc_id, a FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM win) WHERE n > 1
), gone AS (
  SELECT doc_id, list_sort(list_distinct(flatten(list(range(a, a + 35))))) AS g FROM rep GROUP BY doc_id
), cut AS (
  SELECT doc_id, w, coalesce(g, []) AS g,
         list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(g, x[2])), lambda x: x[1]) AS kept
  FROM d LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(g) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN len(g) = 0 THEN w ELSE kept END, ' ')) AS kept_sha256
FROM cut
"""


def op2_simple8b_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"))


def op3_probminhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: all pairs that share a shingle, compared directly; classes by following their links
OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '\S+') AS w FROM documents
), g AS (
  SELECT doc_id,
         CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
              ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END AS g
  FROM d WHERE len(w) > 0
), c AS (
  SELECT doc_id, n, s, count(*) AS c FROM (SELECT doc_id, len(g) AS n, unnest(g) AS s FROM g) GROUP BY ALL
), p AS (
  SELECT x, y FROM (
    SELECT a.doc_id AS x, b.doc_id AS y, a.n + b.n AS n, sum(least(a.c, b.c)) AS shared
    FROM c a JOIN c b ON a.s = b.s AND a.doc_id < b.doc_id
    GROUP BY ALL
  ) WHERE shared >= 0.8 * (n - shared)
), e AS (
  SELECT x, y FROM p UNION ALL SELECT y, x FROM p
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM d
  UNION
  SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x
)
SELECT x AS doc_id, min(y) AS class_id, count(*) AS class_size FROM reach GROUP BY x
"""


def op4_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: every window of an item's length that starts where it can share a shingle, compared directly
OP4_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS w FROM benchmark
), i AS (
  SELECT item_id, len(w) AS n, least(len(w), 5) AS r,
         list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda i: array_to_string(w[i : i + least(len(w), 5) - 1], ' ')) AS g
  FROM iw WHERE len(w) > 0
), d AS (
  SELECT doc_id, len(w) AS n, r, list_transform(range(1, len(w) - r + 2), lambda i: array_to_string(w[i : i + r - 1], ' ')) AS g
  FROM dw, (SELECT DISTINCT r FROM i) WHERE len(w) >= r
), dp AS (
  SELECT doc_id, n, r, unnest(g) AS s, unnest(range(0, len(g))) AS p FROM d
), ip AS (
  SELECT item_id, n, r, s, count(*) AS c FROM (SELECT item_id, n, r, unnest(g) AS s FROM i) GROUP BY ALL
), hit AS (
  SELECT DISTINCT dp.doc_id, dp.n AS dn, ip.item_id, ip.n AS m, r, p
  FROM dp JOIN ip USING (s, r)
), win AS (
  SELECT DISTINCT doc_id, item_id, m, r, a
  FROM (SELECT *, unnest(range(greatest(0, p - m + r), least(p, greatest(0, dn - m)) + 1)) AS a FROM hit)
), wg AS (
  SELECT win.doc_id, item_id, m, a, unnest(g[a + 1 : a + m - r + 1]) AS s, len(g[a + 1 : a + m - r + 1]) AS size
  FROM win JOIN d USING (doc_id, r)
), wc AS (
  SELECT doc_id, item_id, m, a, size, s, count(*) AS c FROM wg GROUP BY ALL
), sim AS (
  SELECT wc.doc_id, wc.item_id, wc.m, a, size, sum(least(wc.c, ip.c)) AS shared
  FROM wc JOIN ip ON ip.item_id = wc.item_id AND ip.s = wc.s
  GROUP BY ALL
), best AS (
  SELECT doc_id, item_id, CAST(shared AS DOUBLE) / (size + m - least(m, 5) + 1 - shared) AS similarity, a, m FROM sim
)
SELECT doc_id, item_id, max(similarity) AS similarity,
       CAST(arg_min(a, (-similarity, a)) AS INTEGER) AS start_word, CAST(arg_min(m, (-similarity, a)) AS INTEGER) AS n_words
FROM best
WHERE similarity >= 0.8
GROUP BY doc_id, item_id
"""


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op6_va_file_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    return top_k(embeddings, embeddings.where("vec_id % 100 = 0"), k=10)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejection by distance shows in ``outlier`` only: the contract keeps ``und`` for texts without letters."""
    documents = table(spark, sf_dir, "documents")
    model = langid.fit(documents, fold(3) != 1)
    out = langid.predict(documents, model, reject=False)
    return out.select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "outlier")


def op8_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    weights = quality.fit(documents, table(spark, sf_dir, "labels"), fold(5) != 0)
    out = quality.score(documents.withColumn("doc_id", F.col("doc_id").cast("long")), weights)
    held_out = F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out")
    return out.select("doc_id", held_out, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_warc_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = archived_pages(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), d AS (
  SELECT page_id, strlen(body) AS n, sha256(body) AS digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM d
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM f
"""


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op11_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(table(spark, sf_dir, "documents"))


def _op11_sql() -> str:
    """Runs of every length found as texts, covered words counted one by one."""
    tops, runs = list(MOST_TOP_RUN), list(MOST_REPEATED_RUNS)
    lengths = sorted({3, *tops, *runs})
    limits = [("dup_line_chars", MOST_LINE_CHARS)]
    limits += [(f"top_chars_{n}", most) for n, most in MOST_TOP_RUN.items()]
    limits += [(f"repeat_chars_{n}", most) for n, most in MOST_REPEATED_RUNS.items()]
    tables = "".join(
        f"""
), g{n} AS (
  SELECT *, lag(p) OVER (PARTITION BY r, g ORDER BY p) AS q
  FROM (SELECT r, p, g, count(*) OVER (PARTITION BY r, g) AS c
        FROM (SELECT r, p, array_to_string(w[p : p + {n - 1}], ' ') AS g FROM word WHERE p <= len(w) - {n - 1}))
  WHERE c > 1
), c{n} AS (
  SELECT r, count(*) AS words, sum(chars) AS chars
  FROM (SELECT DISTINCT r, unnest(range(p, p + {n})) AS p FROM g{n}) JOIN word USING (r, p)
  GROUP BY r"""
        + (
            f"""
), t{n} AS (
  SELECT r, max(chars) AS chars
  FROM (SELECT r, g, sum(chars) AS chars
        FROM (SELECT r, g, unnest(range(greatest(p, coalesce(q + {n}, p)), p + {n})) AS p FROM g{n}) JOIN word USING (r, p)
        GROUP BY r, g)
  GROUP BY r"""
            if n in tops
            else ""
        )
        for n in lengths
    )
    columns = ["coalesce(c3.words, 0) AS n_repeat_words"]
    columns += [f"coalesce(t{n}.chars, 0) AS top_chars_{n}" for n in tops]
    columns += [f"coalesce(c{n}.chars, 0) AS repeat_chars_{n}" for n in runs]
    names = [c.rsplit(" ", 1)[1] for c in columns]
    joins = "".join(f"\n  LEFT JOIN {t}{n} ON {t}{n}.r = d.r" for n in lengths for t in ("c", *("t" if n in tops else "")))
    over = " OR ".join(f"100 * {c} > {most} * word_chars" for c, most in limits)
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), word AS (
  SELECT r, w, p, length(w[p]) AS chars FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d)
), line AS (
  SELECT r, line, length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')) AS chars, count(*) AS n
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
  GROUP BY r, line
), lines AS (
  SELECT r, sum(n) AS n_lines, sum(n - 1) AS n_dup_lines, sum((n - 1) * chars) AS dup_line_chars FROM line GROUP BY r{tables}
), m AS (
  SELECT d.doc_id, len(w) AS n_words, list_sum(list_transform(w, lambda x: length(x))) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         n_lines, n_dup_lines, dup_line_chars, {", ".join(columns)}
  FROM d LEFT JOIN lines ON lines.r = d.r{joins}
), z AS (
  SELECT doc_id, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "dup_line_chars", *names])}
  FROM m
), v AS (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEAT_WORDS} * n_words AS base_failed FROM z
)
SELECT *, NOT base_failed AND NOT (100 * n_dup_lines > {MOST_LINES} * n_lines OR {over}) AS kept FROM v
"""


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def _op13_sql() -> str:
    """Every distance from the vectors themselves, a table for each round."""
    width = "len(v) // 8"
    parts = f"list_transform(range(0, 8), lambda p: v[p * ({width}) + 1 : (p + 1) * ({width})])"
    rounds = "".join(
        f"""
), a{i} AS MATERIALIZED (
  SELECT vec_id, p, part, (arg_min(e, (d, e))) AS e, min(d) AS d
  FROM (SELECT x.vec_id, x.p, part, e, list_sum(list_transform(list_zip(part, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
        FROM x JOIN b{i} USING (p))
  GROUP BY ALL
), b{i + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(mean, entry) AS entry
  FROM b{i} LEFT JOIN (
    SELECT p, e, list(m ORDER BY i) AS mean
    FROM (SELECT p, e, i, CAST(floor(sum(part[i]) / count(*)) AS BIGINT) AS m
          FROM (SELECT p, e, part, unnest(range(1, len(part) + 1)) AS i FROM a{i}) GROUP BY p, e, i)
    GROUP BY p, e) USING (p, e)"""
        for i in range(6)
    )
    return f"""
WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (
  SELECT vec_id, unnest(range(0, 8)) AS p, unnest({parts}) AS part FROM k
), b0 AS MATERIALIZED (
  SELECT p, e, part AS entry
  FROM (SELECT *, dense_rank() OVER (ORDER BY vec_id) - 1 AS e FROM x) WHERE e < 16{rounds}
), a AS (
  SELECT vec_id, p, arg_min(e, (d, e)) AS e, min(d) AS d
  FROM (SELECT x.vec_id, x.p, e, list_sum(list_transform(list_zip(part, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
        FROM x JOIN b6 USING (p))
  GROUP BY vec_id, p
), c AS (
  SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a GROUP BY vec_id
), s AS (
  SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b6
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM c JOIN k USING (vec_id), s
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fm_index_substring_dedup": op1_fm_index_substring_dedup,
    "op2_simple8b_ids": op2_simple8b_ids,
    "op3_probminhash_near_duplicates": op3_probminhash_near_duplicates,
    "op4_simhash_decontamination": op4_simhash_decontamination,
    "op5_token_counts": op5_token_counts,
    "op6_va_file_top_k": op6_va_file_top_k,
    "op7_language_id": op7_language_id,
    "op8_quality_ftrl": op8_quality_ftrl,
    "op9_warc_reassembly": op9_warc_reassembly,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_repetition_rules": op11_repetition_rules,
    "op12_token_alignment": op12_token_alignment,
    "op13_vector_codes": op13_vector_codes,
}

SQL: dict[str, str] = {
    "op3_probminhash_near_duplicates": OP3_SQL,
    "op1_fm_index_substring_dedup": OP1_SQL,
    "op4_simhash_decontamination": OP4_SQL,
    "op6_va_file_top_k": OP6_SQL,
    "op9_warc_reassembly": OP9_SQL,
    "op11_repetition_rules": _op11_sql(),
    "op13_vector_codes": _op13_sql(),
}
