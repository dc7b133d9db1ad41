"""The queries of this subpackage: each applies its operator to a whole table of a folder."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact_dedup, language, minhash, mixing, pii, prefix_trie, simhash, toxicity, url_rules, vector_codes, warc
from .tables import staged, table


def op1_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", both), (-7, 1, "assistant", both)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_conversations(staged(chat.render_conversations(turns), "formatted"))


def op3_splitting_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op4_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).drop("url")


def op5_ball_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(table(spark, sf_dir, "documents"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"))


def _fold(name: str, modulus: int, value: int):
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % modulus == value


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_texts(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", _fold("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is the session's ``tidegauge.surrogates.key``; where it names none, one is drawn for this run alone."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    key = (spark.conf.get("tidegauge.surrogates.key", None) or secrets.token_hex(32)).encode()
    return pii.pseudonymise(docs, key).select("doc_id", "surrogated.text", "surrogated.n_entities", "surrogated.kinds")


def op9_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    told = language.identify(docs.drop("lang"), language.fit(docs))
    return told.select("doc_id", _fold("doc_id", 4, 2).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def op11_annular_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_components(table(spark, sf_dir, "documents"))


_ALL = (
    op1_block_naming, op2_chat_round_trip, op3_splitting_tree, op4_warc_chunks, op5_ball_hashing, op6_url_rules, op7_toxicity,
    op8_surrogates, op9_phrase_index, op10_language, op11_annular_codes, op12_prefix_trie, op13_bottom_k,
)
QUERIES = {f.__name__: f for f in _ALL}

_MARKS = r"\\|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<<ROLE |<</ROLE>>"


def _nearest(name: str, books: str) -> str:
    """SQL of the nearest entry (e) of each part and its squared distance (d); of equally near ones the lower index."""
    far = "list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT"
    return f"{name} AS MATERIALIZED (SELECT r, j, m % 64 AS e, m // 64 AS d FROM (SELECT p.r, p.j, min({far} * 64 + b.e) AS m FROM p JOIN {books} b USING (j) GROUP BY p.r, p.j))"


def _means(name: str, books: str, assigned: str) -> str:
    """SQL of codebooks whose entries are the floors of their parts' means; an entry without parts stays."""
    of_one = f"SELECT j, e, i, floor(sum(p.x[i]) / count(*))::BIGINT AS x FROM p JOIN {assigned} a USING (r, j), unnest(range(1, len(p.x) + 1)) AS t(i) GROUP BY j, e, i"
    return f"{name} AS MATERIALIZED (SELECT b.j, b.e, coalesce(m.x, b.x) AS x FROM {books} b LEFT JOIN (SELECT j, e, list(x ORDER BY i) AS x FROM ({of_one}) GROUP BY j, e) m ON m.j = b.j AND m.e = b.e)"


ORACLE_SQL = {
    "op1_block_naming": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)""",
    "op2_chat_round_trip": rf"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        s AS (SELECT *, length(text) + len(regexp_extract_all(text, '{_MARKS}')) +
                CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 WHEN 'system' THEN 19
                     ELSE 19 + length(role) + len(regexp_extract_all(role, '[\\<>\[]')) END AS n FROM t)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               sum(n)::BIGINT AS formatted_chars
        FROM s GROUP BY conv_id""",
    "op4_warc_chunks": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
        FROM f""",
    "op6_url_rules": r"""
        WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
        r(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        m AS (SELECT b.page_id, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.verdict, length(r.host || r.path)) AS verdict
              FROM b JOIN r ON (b.host = r.host OR ends_with(b.host, '.' || r.host)) AND starts_with(b.path, r.path) GROUP BY b.page_id)
        SELECT b.page_id, b.host, b.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM b LEFT JOIN m USING (page_id)""",
    "op9_phrase_index": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        v AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS k
              FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
        s AS (SELECT DISTINCT n FROM v),
        p AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS k
              FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, s WHERE len(w) >= n)),
        h AS (SELECT p.doc_id, p.i, p.n, v.item_id FROM p JOIN v ON p.n = v.n AND p.k = v.k),
        c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id),
        e AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
        SELECT d.doc_id, len(d.w) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(e.n_items, 0) AS n_items,
               sha256(coalesce(e.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN e USING (doc_id)""",
    "op11_annular_codes": f"""
        WITH k AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
                   list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS MATERIALIZED (SELECT r, j, v[j * (len(v) // 16) + 1 : (j + 1) * (len(v) // 16)] AS x FROM k, unnest(range(16)) AS t(j)),
        b0 AS MATERIALIZED (SELECT j, r - 1 AS e, x FROM p WHERE r <= 64),
        {_nearest("a0", "b0")}, {_means("b1", "b0", "a0")}, {_nearest("a1", "b1")}, {_means("b2", "b1", "a1")}, {_nearest("a2", "b2")},
        c AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY j) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY r),
        h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY j, e)) AS codebooks_sha256 FROM b2)
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM k JOIN c USING (r), h""",
    "op12_prefix_trie": """
        WITH t AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda b: ascii(b)::BIGINT)),
                  lambda x, b: list_reduce(list_concat([xor(x, b)], range(8)), lambda y, i: xor(y >> 1, CASE WHEN y & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 6 AS h FROM t),
        o AS (SELECT c.conv_id, 0 AS own, t.pos, role, text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= h
              UNION ALL SELECT c.conv_id, 1, t.pos, role, text FROM c JOIN t USING (conv_id) WHERE t.pos > h),
        r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth, role, text FROM o
              UNION ALL SELECT conv_id, 0, '', '' FROM c),
        p AS (SELECT conv_id, depth, length(text) AS tokens, max(depth) OVER (PARTITION BY conv_id) AS n_turns,
                     string_agg(concat(length(role), ':', role, length(text), ':', text), '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM r),
        n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(tokens) AS tokens, max(n_turns) = depth AS leaf,
                     sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n_turns = depth), '')) AS ends_sha256 FROM p GROUP BY path, depth),
        q AS (SELECT path, depth, lag(path) OVER (PARTITION BY conv_id ORDER BY depth) AS above FROM p),
        e AS (SELECT DISTINCT path, depth, above FROM q),
        s AS (SELECT x.path, x.depth, count(*) FILTER (WHERE y.leaf) AS n_leaves, sum((y.n_convs - 1) * y.tokens)::BIGINT AS saved_tokens
              FROM n x JOIN n y ON y.depth >= x.depth AND starts_with(y.path, x.path) GROUP BY x.path, x.depth)
        SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, (SELECT count(*) FROM e f WHERE f.above = n.path AND f.depth = n.depth + 1) AS n_children,
               s.n_leaves, s.saved_tokens, n.ends_sha256
        FROM n JOIN e USING (path, depth) JOIN s USING (path, depth) LEFT JOIN n u ON u.path = e.above AND u.depth = n.depth - 1""",
    "op13_bottom_k": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM d WHERE len(w) > 0)),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        l AS MATERIALIZED (
            SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY 1, 2) m
            JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * common >= 80 * (u.n + v.n - common)),
        r AS (SELECT a AS x, a AS y FROM l UNION SELECT r.x, l.b FROM r JOIN l ON l.a = r.y),
        c AS (SELECT x AS doc_id, min(y) AS root FROM r GROUP BY x)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.root, d.doc_id) AS component_id, coalesce(c.root, d.doc_id) = d.doc_id AS kept
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""",
}
