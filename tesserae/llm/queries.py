"""The queries of the corpus operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import exact_duplicates
from .hmm import score_texts
from .lines import line_report
from .mixing import mix_sources
from .pii import find_pii, joined_spans
from .quality import BASE, quality_rules
from .sentencepiece_codec import load_model, round_trip
from .sharding import assign_shards
from .simhash import near_duplicates
from .token_counts import token_counts
from .trie import opening_trie
from .warc import archived_pages
from .whitening import whiten

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1's base rules alone: the rules without trees."""
    ruled = quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), trees=0)
    return ruled.select("doc_id", *BASE, "base_failed")


QUALITY_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
     w AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t)),
     n AS (SELECT r, count(*) AS n_words, sum(len(w))::BIGINT AS word_chars FROM w GROUP BY r),
     g AS (SELECT r, i, concat_ws(' ', w, lead(w) OVER o, lead(w, 2) OVER o) AS g, lead(w, 2) OVER o IS NOT NULL AS whole FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
     m AS (SELECT r, i FROM g WHERE whole QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
     p AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM m, range(3) AS s(k) GROUP BY r),
     l AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
                  (len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols FROM t)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
       coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_words, 0) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * coalesce(n_words, 0) AS base_failed
FROM t JOIN l USING (r) LEFT JOIN n USING (r) LEFT JOIN p USING (r)
"""


def op2_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_table(spark, sf_dir, "documents"))


def unigram_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2's base columns alone, the score to six places: the model without rounds of training."""
    scored = score_texts(_table(spark, sf_dir, "documents"), rounds=0)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


def _unigram_sql() -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, doc_id AS c, {_LOWER} AS text FROM documents),
     t AS (SELECT r, doc_id, text, coalesce({_CRC} % 7 = 2, false) AS held_out FROM d),
     w AS (SELECT r, held_out, unnest(list_append(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), '')) AS w FROM t),
     k AS (SELECT w, count(*) AS c FROM w WHERE NOT held_out GROUP BY w),
     n AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM k),
     s AS (SELECT r, count(*) AS n_tokens, count(c) AS n_known, sum(log10((coalesce(c, 0) + 1)::DOUBLE / (n + v + 1))) AS base_score FROM w LEFT JOIN k USING (w), n GROUP BY r)
SELECT doc_id, held_out, n_tokens, n_known, n AS train_tokens, round(base_score, 6) AS base_score FROM t JOIN s USING (r), n
"""


def op3_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = line_report(_table(spark, sf_dir, "documents"))
    return report.select("doc_id", F.col("n_lines").cast("long"), F.size("dropped").cast("long").alias("n_dropped"), "dropped")


#: A public model's file; its place is a parameter of load_model.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = load_model(PIECES)
    coded = round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    same = F.col("decoded").eqNullSafe(F.replace(F.coalesce("text", F.lit("")), F.lit("\u2581"), F.lit(" ")))
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), same.alias("round_trip"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), width=4, distance=4)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"), keep="max")


OP6_SQL = f"""
WITH t AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256, strlen({_LOWER}) AS n_bytes FROM documents),
     g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256, n_bytes
FROM t JOIN g USING (text_sha256)
"""


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )


_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
OP7_SQL = f"""
WITH t AS (SELECT doc_id, source, {_WORDS}::BIGINT AS size,
                  ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h FROM documents),
     s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM t GROUP BY source),
     w AS (SELECT *, [3, 1, 2][((r - 1) % 3 + 1)::INT] AS w, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS budget FROM s),
     o AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                  sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS w_left FROM w),
     c AS (SELECT *, cap / w * w_left <= budget - before AS capped FROM o),
     f AS (SELECT *, budget - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0) AS free,
                  sum(CASE WHEN NOT capped THEN w END) OVER ()::DOUBLE AS w_free FROM c),
     g AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE free * w / w_free END AS target FROM f),
     e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM g),
     b AS (SELECT t.doc_id, t.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS b,
                  sum(t.size) OVER (PARTITION BY t.source ORDER BY t.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
                  sum(t.size) OVER (PARTITION BY t.source, t.h) AS own
           FROM t JOIN e ON t.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN b <= 0 THEN 0 WHEN cum <= b OR 2 * (b - (cum - own)) > own AND cum - own <= b THEN 1 ELSE 0 END))::BIGINT AS taken
FROM b
"""


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(_table(spark, sf_dir, "pages"), least_bytes=1000).drop("target_uri")


OP8_SQL = """
WITH t AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
     g AS (SELECT payload_digest, max(page_id) AS first FROM t WHERE payload_bytes >= 1000 GROUP BY payload_digest HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM t LEFT JOIN g USING (payload_digest)
"""


#: Bytes of a shard in the query: small enough that buckets split on tables of a few megabytes, too.
SHARD_BYTES = 1 << 18


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(_table(spark, sf_dir, "documents").select("doc_id", "text"), limit=SHARD_BYTES).drop("text")


OP9_SQL = f"""
WITH t AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS b,
                  ('0x' || substr(md5('shard:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h FROM documents),
     d AS (SELECT doc_id, b, h, depth, h >> (60 - depth) AS q FROM t, (SELECT unnest(range(0, 25))::INT AS depth)),
     s AS (SELECT depth, q, sum(b)::BIGINT AS shard_bytes, count(*) AS shard_docs, min(h) = max(h) AS one FROM d GROUP BY depth, q),
     l AS (SELECT d.doc_id, d.h, min(depth) AS shard_depth FROM d JOIN s USING (depth, q) WHERE shard_bytes <= {SHARD_BYTES} OR one GROUP BY ALL)
SELECT l.doc_id, CASE WHEN shard_depth = 0 THEN '' ELSE lpad(bin(q), shard_depth, '0') END AS shard, shard_depth, shard_bytes, shard_docs, shard_bytes <= {SHARD_BYTES} AS shard_fits
FROM l JOIN s ON s.depth = shard_depth AND s.q = l.h >> (60 - shard_depth)
"""


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(_table(spark, sf_dir, "documents"), support=2)
    count = lambda k: F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long")
    base = F.filter("spans", lambda x: x["k"] < 4)
    return found.select(
        "doc_id", count(0).alias("n_email"), count(1).alias("n_ip"), count(2).alias("n_card"), count(3).alias("n_phone"),
        F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"), count(4).alias("n_term"),
    )


_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(v, '.'), lambda x: len(ltrim(x, '0')) > 3 OR lpad(right(x, 3), 3, '0') > '255')) = 0"),
    "card": (r"[0-9]([\x20-]?[0-9])+", """len(d) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN d[-i]::INT
 ELSE d[-i]::INT * 2 - CASE WHEN d[-i]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "len(d) BETWEEN 9 AND 15"),
}


def _found(k: int, kind: str) -> str:
    """The matches of a kind by place: the pieces between matches, and the matches, give the starts."""
    pattern, valid = _KINDS[kind]
    return f"""SELECT r, {k} AS k, (sum(len(gap) + len(v)) OVER (PARTITION BY r ORDER BY i) - len(v))::INT AS s, (sum(len(gap) + len(v)) OVER (PARTITION BY r ORDER BY i))::INT AS e,
 v, {valid} AS ok FROM (SELECT r, i, vs[i] AS v, gaps[i] AS gap, regexp_replace(vs[i], '[^0-9]', '', 'g') AS d FROM (SELECT r, vs, gaps, unnest(range(1, len(vs) + 1)) AS i FROM
 (SELECT r, regexp_extract_all(t, '{pattern}') AS vs, string_split_regex(t, '{pattern}') AS gaps FROM t)))"""


OP10_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
 base AS (SELECT r, k, s, e, v, ['email', 'ip', 'card', 'phone'][k + 1] AS kind FROM ({' UNION ALL '.join(_found(k, kind) for k, kind in enumerate(_KINDS))}) WHERE ok),
 cut AS (SELECT r, i, ls[i] AS line, (sum(len(ls[i]) + 1) OVER (PARTITION BY r ORDER BY i) - len(ls[i]) - 1)::INT AS start
   FROM (SELECT r, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT r, string_split(t, chr(10)) AS ls FROM t))),
 once AS (SELECT DISTINCT line FROM cut),
 n AS (SELECT count(*)::DOUBLE AS n FROM once),
 df_t AS (SELECT w, count(*) AS df_t FROM (SELECT DISTINCT line, unnest(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM once) GROUP BY w),
 own AS (SELECT c.r, c.i, c.line, c.start, b.s - c.start AS s, b.e - c.start AS e, b.kind, b.v FROM cut c JOIN base b ON b.r = c.r AND b.s >= c.start AND b.e <= c.start + len(c.line)),
 entity AS (SELECT DISTINCT line, unnest([kind, kind || ':' || v]) AS v FROM own),
 df_v AS (SELECT v, count(*) AS df_v FROM entity GROUP BY v HAVING count(*) >= 2),
 place AS (SELECT line, w, (sum(len(gap) + len(w)) OVER (PARTITION BY line ORDER BY i) - len(w))::INT AS s, (sum(len(gap) + len(w)) OVER (PARTITION BY line ORDER BY i))::INT AS e
   FROM (SELECT line, i, ws[i] AS w, gaps[i] AS gap FROM (SELECT line, ws, gaps, unnest(range(1, len(ws) + 1)) AS i
   FROM (SELECT line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws, string_split_regex(line, '[^\x20\x09-\x0D]+') AS gaps FROM (SELECT DISTINCT line FROM own))))),
 free AS (SELECT * FROM place p WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.line = p.line AND o.s < p.e AND o.e > p.s)),
 beside AS (SELECT DISTINCT line, v, w FROM free JOIN entity USING (line)),
 told AS (SELECT v, w FROM (SELECT v, w, count(*) AS df_vt FROM beside GROUP BY v, w HAVING count(*) >= 2) JOIN df_v USING (v) JOIN df_t USING (w), n
   WHERE log2(n / df_v) > 0 AND log2(n * df_vt / df_v / df_t) >= 0.9::DOUBLE * log2(n / df_v)),
 term AS (SELECT DISTINCT line, w FROM beside JOIN told USING (v, w)),
 every AS (SELECT r, k, kind, s, e FROM base UNION ALL
   SELECT DISTINCT c.r, 4, 'term', c.start + f.s, c.start + f.e FROM cut c JOIN free f USING (line) JOIN term USING (line, w)),
 one AS (SELECT r, count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip, count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone, count(*) FILTER (k = 4) AS n_term,
   string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 4) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM every GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
 sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_term, 0) AS n_term
FROM t LEFT JOIN one USING (r)
"""


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = whiten(_table(spark, sf_dir, "embeddings"), components=16)
    return made.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096).drop("text")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opening_trie(_table(spark, sf_dir, "conversations"))


_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b:
 list_reduce(list_prepend(xor(a, b), range(8)), lambda r, i: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295::BIGINT)"""
OP13_SQL = f"""
WITH v AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
     k AS (SELECT c, turn, md5(len(role) || ':' || role || text) AS k, len(text) AS n FROM v),
     t AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) AS pos, {{'k': k, 'n': n}} AS v FROM k),
     o AS (SELECT c, count(*) AS own FROM t GROUP BY c),
     f AS (SELECT o.c, o.c - o.c % 100 AS base, h, least(h, coalesce(b.own, 0)) AS taken FROM (SELECT c, {_CRC} % 6 AS h FROM o) o LEFT JOIN o b ON b.c = o.c - o.c % 100),
     p AS (SELECT f.c, t.pos - h + taken AS pos, v FROM f JOIN t ON t.c = f.c AND t.pos > h UNION ALL SELECT f.c, t.pos, v FROM f JOIN t ON t.c = f.base AND t.pos <= taken),
     s AS (SELECT f.c, coalesce(list(v ORDER BY pos) FILTER (pos IS NOT NULL), []) AS path FROM f LEFT JOIN p ON p.c = f.c GROUP BY f.c),
     m AS (SELECT c, d, path[1:d] AS node, d = len(path) AS ends FROM (SELECT c, path, unnest(range(0, len(path) + 1)) AS d FROM s)),
     n AS (SELECT node, d, min(c) AS conv_id, count(*) AS n_convs, bool_and(ends) AS leaf, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends) AS ids FROM m GROUP BY node, d),
     b AS (SELECT node[1:a] AS node, count(*) FILTER (leaf) AS n_leaves, count(*) FILTER (d = a + 1) AS n_children, sum((n_convs - 1) * coalesce(node[-1].n, 0)) AS saved_tokens
           FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM n) GROUP BY node[1:a])
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, b.n_children, b.n_leaves, b.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(n.ids, '')) AS ends_sha256
FROM n JOIN b ON b.node = n.node LEFT JOIN n u ON n.d > 0 AND u.node = n.node[1:n.d - 1]
"""

QUERIES = {
    "op1_quality_rules": op1_quality_rules, "op2_hidden_markov": op2_hidden_markov, "op3_fuzzy_lines": op3_fuzzy_lines, "op4_sentencepiece": op4_sentencepiece, "op5_simhash": op5_simhash,
    "op6_exact_dedup": op6_exact_dedup, "op7_mixing": op7_mixing, "op8_warc": op8_warc, "op9_sharding": op9_sharding, "op10_pii": op10_pii, "op11_whitening": op11_whitening,
    "op12_token_counts": op12_token_counts, "op13_prefix_trie": op13_prefix_trie, "quality_base": quality_base, "unigram_base": unigram_base,
}
ORACLES = {"op6_exact_dedup": OP6_SQL, "op7_mixing": OP7_SQL, "op8_warc": OP8_SQL, "op9_sharding": OP9_SQL, "op10_pii": OP10_SQL, "op13_prefix_trie": OP13_SQL, "quality_base": QUALITY_SQL, "unigram_base": _unigram_sql()}
