"""The registered queries of the operators, each over its whole table, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import bpe, decontaminate, exact, html, lm, near, quality, secrets, shards, spelling, toxicity, trie, warc

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary() -> str:
    """The vocabulary file the queries encode with; it belongs to the public tokenizers and is read where it lies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(_table(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm.backoff_scores(_table(spark, sf_dir, "documents"))
    return scores.select("doc_id", "n_words", F.round("score", 6).alias("score"))


def op4_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return bpe.with_tokens(docs, vocabulary()).select("doc_id", *bpe.digests())


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_table(spark, sf_dir, "documents")).drop("n_chars", "row_md5")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(_table(spark, sf_dir, "pages"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_classes(_table(spark, sf_dir, "documents")).drop("row_md5")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(_table(spark, sf_dir, "conversations"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_report(_table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_benchmark_decontamination,
        op3_lm_scoring,
        op4_bpe_encoding,
        op5_exact_dedup,
        op6_html_extraction,
        op7_quality_classifier,
        op8_toxicity,
        op9_warc,
        op10_minhash_near_dedup,
        op11_conversation_trie,
        op12_sharding,
        op13_spelling_variants,
    )
}

# Fixed by the contract, as in secrets.RULES; quotes are doubled for SQL.
_ASSIGN = """(?i:(password|passwd|secret|token|api_?key))["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""



def _crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of a string's UTF-8 bytes, bit by bit."""
    byte = f"CAST(('0x' || substr(hex({text}), 1 + 2 * (j // 8), 2)) AS BIGINT)"
    fed = f"xor(a, CASE WHEN j % 8 = 0 THEN {byte} ELSE 0 END)"
    step = f"xor({fed} >> 1, 3988292384 * ({fed} & 1))"
    return f"xor(list_reduce(list_concat([4294967295], range(0, 4 * length(hex({text})))), lambda a, j: {step}), 4294967295)"


ORACLES: dict[str, str] = {
    "op1_secret_scan": rf"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
        found AS (
            SELECT doc_id, 0 AS o, 'assign' AS kind, regexp_split_to_array(x, '{_ASSIGN}') AS p,
                   regexp_extract_all(x, '{_ASSIGN}') AS m, list_transform(regexp_extract_all(x, '{_ASSIGN}', 2), lambda g: length(g) >= 6) AS ok
            FROM t
            UNION ALL
            SELECT doc_id, 1, 'access', regexp_split_to_array(x, 'AKIA[A-Z0-9]+'), regexp_extract_all(x, 'AKIA[A-Z0-9]+'),
                   list_transform(regexp_extract_all(x, 'AKIA[A-Z0-9]+'), lambda g: length(g) >= 20)
            FROM t
            UNION ALL
            SELECT doc_id, 2, 'hex', regexp_split_to_array(x, '[0-9a-f]{{24,}}'), regexp_extract_all(x, '[0-9a-f]{{24,}}'),
                   list_transform(regexp_extract_all(x, '[0-9a-f]{{24,}}'), lambda g: true)
            FROM t),
        each AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found),
        spans AS (
            SELECT doc_id, o, kind,
                   CAST(list_sum(list_transform(p[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: length(z))), 0) AS BIGINT) AS s,
                   length(m[i]) AS n
            FROM each WHERE ok[i]),
        agg AS (
            SELECT doc_id, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
                   string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, o) AS spans
            FROM spans GROUP BY doc_id)
        SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
               sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM t LEFT JOIN agg USING (doc_id)
    """,
    "op2_benchmark_decontamination": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents),
        b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark),
        bw AS (
            SELECT item_id, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i, w FROM b WHERE len(w) > 0),
        win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS t FROM bw),
        dw AS (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k),
        hits AS (
            SELECT doc_id, dw.k, i, item_id FROM (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS t FROM dw) dw JOIN win USING (k, t)),
        words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hits) GROUP BY doc_id),
        items AS (
            SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
            FROM hits GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    # On so few words the vocabulary is every word, as here.
    "op3_lm_scoring": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents),
        each AS (SELECT r, unnest(w) AS w, unnest(range(len(w))) AS i FROM d),
        g AS (SELECT r, w, lag(w) OVER (PARTITION BY r ORDER BY i) AS v FROM each),
        uni AS (SELECT w, count(*) AS c FROM g GROUP BY w),
        n AS (SELECT count(*) AS total FROM g),
        own AS (SELECT r, v, w, count(*) AS times FROM g WHERE v IS NOT NULL GROUP BY ALL),
        pair AS (SELECT v, w, sum(times) AS c FROM own GROUP BY ALL),
        scored AS (
            SELECT r, times * CASE WHEN pair.c > times THEN ln(pair.c / f.c) ELSE ln(0.4 * s.c / total) END AS x
            FROM own JOIN pair USING (v, w) JOIN uni f ON f.w = own.v JOIN uni s ON s.w = own.w, n
            UNION ALL
            SELECT r, ln(c / total) FROM g JOIN uni USING (w), n WHERE v IS NULL)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(x / len(w), 6) AS score
        FROM d LEFT JOIN (SELECT r, sum(x) AS x FROM scored GROUP BY r) USING (r)
    """,
    "op5_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm,
                   length(coalesce(text, '')) AS n
            FROM documents),
        g AS (
            SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY norm) AS group_size
            FROM t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
    """,
    "op9_warc": """
        WITH t AS (
            SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha1(coalesce(html, '')) AS h,
                   max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
            FROM pages)
        SELECT page_id, n AS payload_bytes,
               list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + ((CAST(('0x' || substr(h, 1 + 5 * (i // 4), 5)) AS BIGINT) >> (15 - 5 * (i % 4))) & 31), 1)), lambda a, b: a || b) AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM t
    """,
    "op11_conversation_trie": rf"""
        WITH t AS (
            SELECT conv_id AS c, turn, coalesce(text, '') AS x, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id
            FROM conversations WHERE conv_id IS NOT NULL),
        own AS (
            SELECT c, list(id ORDER BY turn NULLS FIRST, id) AS ids,
                   list(len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) ORDER BY turn NULLS FIRST, id) AS ws, {_crc32("CAST(c AS VARCHAR)")} % 4 AS h
            FROM t GROUP BY c),
        m AS (
            SELECT a.c, list_concat(coalesce(b.ids, [])[1:a.h], a.ids[a.h + 1:]) AS ids, list_concat(coalesce(b.ws, [])[1:a.h], a.ws[a.h + 1:]) AS ws
            FROM own a LEFT JOIN own b ON b.c = a.c - a.c % 20),
        each AS (SELECT c, ids, ws, unnest(range(0, len(ids) + 1)) AS d FROM m),
        node AS (
            SELECT array_to_string(ids[1:d], ',') AS k, d, min(c) AS conv_id, count(*) AS n_convs, any_value(ids[1:d]) AS path,
                   (count(*) - 1) * any_value(CASE WHEN d > 0 THEN ws[d] ELSE 0 END) AS own,
                   sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = len(ids)), '')) AS ends_sha256
            FROM each GROUP BY ALL),
        up AS (SELECT k, d, array_to_string(path[1:d - 1], ',') AS pk FROM node WHERE d > 0),
        kids AS (SELECT pk, d - 1 AS d, count(*) AS n FROM up GROUP BY ALL),
        sums AS (
            SELECT array_to_string(path[1:e], ',') AS k, e AS d, sum(own) AS saved, sum(leaf) AS leaves
            FROM (SELECT node.path, node.own, CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END AS leaf, unnest(range(0, node.d + 1)) AS e
                  FROM node LEFT JOIN kids ON kids.pk = node.k AND kids.d = node.d)
            GROUP BY ALL)
        SELECT node.conv_id, node.d AS depth, parent.conv_id AS parent_conv_id, node.n_convs, coalesce(kids.n, 0) AS n_children,
               CAST(sums.leaves AS BIGINT) AS n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, node.ends_sha256
        FROM node JOIN sums ON sums.k = node.k AND sums.d = node.d
        LEFT JOIN kids ON kids.pk = node.k AND kids.d = node.d
        LEFT JOIN up ON up.k = node.k AND up.d = node.d
        LEFT JOIN node parent ON parent.k = up.pk AND parent.d = up.d - 1
    """,
    "op13_spelling_variants": rf"""
        WITH run AS (
            SELECT CAST(doc_id AS VARCHAR) AS i, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]{{7,}}')),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r
            FROM documents),
        hashed AS (SELECT r, {_crc32("(coalesce(i, '') || ':' || r)")} AS h FROM run),
        w AS (
            SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, count(*) AS n
            FROM hashed GROUP BY 1 HAVING n >= 2 AND length(word) >= 7),
        hole AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
        same AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS z FROM hole),
        cut AS (SELECT DISTINCT word, n, a || z AS short FROM same),
        near AS (
            SELECT x.word, y.word AS other, y.n AS other_n FROM same x JOIN same y USING (i, a, z) WHERE x.word <> y.word
            UNION ALL
            SELECT w.word, cut.word, cut.n FROM w JOIN cut ON cut.short = w.word
            UNION ALL
            SELECT cut.word, w.word, w.n FROM w JOIN cut ON cut.short = w.word),
        best AS (
            SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
        each AS (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n
            FROM w LEFT JOIN best USING (word)),
        way AS (
            WITH RECURSIVE step AS (
                SELECT word, word AS here, 0 AS k FROM each
                UNION ALL
                SELECT step.word, each.form, k + 1 FROM step JOIN each ON each.word = step.here WHERE each.form IS NOT NULL)
            SELECT word, arg_max(here, k) AS root FROM step GROUP BY word)
        SELECT word, form, root, n, n_near, form_n FROM each JOIN way USING (word)
    """,
}
