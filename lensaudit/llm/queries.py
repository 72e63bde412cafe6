"""The registered queries of the operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import common, warc

    return warc.read_pages(spark, warc.write_pages(_table(spark, sf_dir, "pages"), common.work_dir(spark, "warc")))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import score

    return score(_table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import common, token_files

    uri = common.work_dir(spark, "tokens")
    token_files.write_tokens(_table(spark, sf_dir, "documents"), uri, tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return token_files.read_tokens(spark, uri)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .line_dedup import dedup_lines

    rows = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return rows.select("doc_id", "n_lines", "removed_lines", "removed_words", F.octet_length(kept).cast("long").alias("kept_bytes"), F.crc32(kept).alias("kept_crc32"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import link_components

    return link_components(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), tokenizer=tokenizer_path("byte_bpe_50k.json"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_search import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64.0)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign_shards

    return assign_shards(_table(spark, sf_dir, "documents"), shards=8)


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(_table(spark, sf_dir, "documents"))


def op12_window_panes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import common, window_panes

    return window_panes.run(window_panes.cut(_table(spark, sf_dir, "clicks"), batches=8), common.work_dir(spark, "panes"), batches=8)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .conversation_repair import damage, repair

    rows = repair(damage(_table(spark, sf_dir, "conversations")), gone="gone")
    return rows.withColumn("repaired_sha256", F.sha2(F.col("repaired").cast("binary"), 256)).drop("repaired")


QUERIES = {f.__name__: f for f in (op1_warc, op2_lm_scoring, op3_token_files, op4_line_dedup, op5_jaccard_join, op6_packing, op7_decontaminate, op8_vector_search, op9_quality, op10_sharding, op11_language_id, op12_window_panes, op13_conversation_repair)}

#: CRC-32 of a text of ASCII characters.
_CRC = """(xor(list_reduce(list_prepend(4294967295, list_transform(string_split({0}, ''), lambda q: CAST(ascii(q) AS BIGINT))), lambda c, b:
  list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295))"""


def _repair_sql() -> str:
    """The fold as a recursive table: for each state, cost, audit and the text so far."""
    z = 1 << 50
    put = lambda x, cost, letter, text="''": f"{{'c': {x}.c + {cost}, 'x': {x}.x || '{letter}', 't': {x}.t || {text}}}"
    new = {"u": "chr(10) || 'user:'", "a": "chr(10) || 'assistant:'"}
    both = f"{new['u']} || {new['a']}"
    keep, own = "(CASE WHEN must_go THEN {0} WHEN truncated THEN 1 ELSE 0 END)".format(z), "chr(10) || role || ':' || text"
    as_is = lambda k: f"{keep} + (CASE WHEN ini = '{k}' THEN 0 ELSE {z} END)"
    inserted_u = f"least(u, {put('e', 2, 'I', new['u'])}, {put('s', 2, 'I', new['u'])}, {put('a', 2, 'I', new['u'])})"
    inserted_a = f"least(a, {put('u', 2, 'I', new['a'])}, {put('e', 4, 'II', both)}, {put('s', 4, 'II', both)})"
    to_user = ", ".join(f"{put(x, as_is('u'), 'K', own)}, {put(x, keep + ' + 2', 'R', new['u'] + ' || text')}" for x in ("e", "s", "ia"))
    return rf"""
WITH RECURSIVE o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_CRC.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k FROM conversations
), d AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS r
  FROM o WHERE k <> 0
), n AS (
  SELECT *, row_number() OVER w AS pos, left(role, 1) AS ini, lag(left(role, 1)) OVER w AS was FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), p AS (
  SELECT *, min(pos) OVER (PARTITION BY conv_id, role, text) < pos AS seen, regexp_replace(text, '[ 	-
]+$', '') AS body FROM n
), f AS (
  SELECT *, body = '' AS blank, body <> '' AND seen AS duplicate, body <> '' AND NOT seen AND right(body, 1) NOT IN ('.', '!', '?') AS truncated,
         body = '' OR seen AS must_go, was IS NOT NULL AND was || ini NOT IN ('su', 'ua', 'au') AS illegal FROM p
), g AS (
  SELECT c.conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
         count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal, count(pos) AS n
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id
), z AS (
  SELECT conv_id, 0 AS pos, {{'c': 0, 'x': '', 't': ''}} AS e, {{'c': {z}, 'x': '', 't': ''}} AS s, {{'c': {z}, 'x': '', 't': ''}} AS u, {{'c': {z}, 'x': '', 't': ''}} AS a FROM g
  UNION ALL
  SELECT conv_id, pos, {put('e', 3, 'D')}, least({put('s', 3, 'D')}, {put('e', as_is('s'), 'K', own)}), least({put('iu', 3, 'D')}, {to_user}),
         least({put('ia', 3, 'D')}, {put('iu', as_is('a'), 'K', own)}, {put('iu', keep + ' + 2', 'R', new['a'] + ' || text')})
  FROM (SELECT z.conv_id, f.pos, role, text, ini, must_go, truncated, e, s, {inserted_u} AS iu, {inserted_a} AS ia FROM z JOIN f ON f.conv_id IS NOT DISTINCT FROM z.conv_id AND f.pos = z.pos + 1)
)
SELECT g.conv_id, CAST(gaps AS BIGINT) AS gaps, CAST(blank AS BIGINT) AS blank, CAST(duplicate AS BIGINT) AS duplicate, CAST(truncated AS BIGINT) AS truncated,
       CAST(illegal AS BIGINT) AS illegal, CAST(b.c AS BIGINT) AS cost, b.x AS audit, sha256(b.t[2:]) AS repaired_sha256
FROM g JOIN (SELECT conv_id, pos, least(e, {inserted_a}) AS b FROM z) y ON y.conv_id IS NOT DISTINCT FROM g.conv_id AND y.pos = g.n
"""


ORACLE_SQL: dict[str, str] = {
    "op12_window_panes": f"""
WITH c AS (
  SELECT click_id, min({{'arrived': arrived_at, 'ts': ts, 'kind': kind, 'value': value}}) AS r FROM clicks WHERE ts IS NOT NULL GROUP BY click_id
), d AS (
  SELECT click_id, r, date_diff('day', DATE '1970-01-01', CAST(coalesce(r.arrived, r.ts) AS DATE)) AS d, {_CRC.format("coalesce(CAST(click_id AS VARCHAR), '')")} % 30 AS k FROM c
), e AS (
  SELECT click_id, least(7, d % 8 + greatest(0, k - 23)) AS batch, coalesce(r.kind, 'none') AS kind, CAST(coalesce(floor(100 * r.value + 0.5), 0) AS BIGINT) AS cents,
         epoch_us(r.ts) - (d - d % 8) * 86400000000 AS us FROM d
), h AS (
  SELECT *, CAST((us - ((us % 3600000000) + 3600000000) % 3600000000) / 3600000000 AS BIGINT) AS hour FROM e
), w AS (
  SELECT b, (SELECT max(us) FROM h WHERE batch < b) AS w FROM range(8) t(b)
), l AS (
  SELECT h.*, coalesce(w >= (hour + 1 + 96) * 3600000000, false) AS late FROM h JOIN w ON b = batch
), p AS (
  SELECT kind, hour, batch, count(*) AS n, sum(cents) AS c FROM l WHERE NOT late GROUP BY ALL
), t AS (
  SELECT *, sum(n) OVER v AS tn, sum(c) OVER v AS tc, lag(batch) OVER v AS lb FROM p WINDOW v AS (PARTITION BY kind, hour ORDER BY batch)
), f AS (
  SELECT kind, hour, min(batch) AS b0, (SELECT min(b) FROM w WHERE w >= (hour + 1 + 6) * 3600000000) AS d FROM p GROUP BY kind, hour
), m AS (
  SELECT kind, hour, greatest(b0, d) AS first FROM f WHERE d IS NOT NULL
), r AS (
  SELECT batch, hour, click_id, 1 AS n_rows, cents, 'late' AS record, kind FROM l WHERE late
  UNION ALL SELECT first, hour, -1, sum(n), sum(c), 'emit', kind FROM m JOIN p USING (kind, hour) WHERE batch <= first GROUP BY first, hour, kind
  UNION ALL SELECT batch, hour, -1, tn - n, tc - c, 'retract', kind FROM t JOIN m USING (kind, hour) WHERE batch > first
  UNION ALL SELECT batch, hour, -1, tn, tc, 'replace', kind FROM t JOIN m USING (kind, hour) WHERE batch > first
  UNION ALL SELECT 7, hour, -1, sum(n), sum(c), 'final', kind FROM f JOIN p USING (kind, hour) WHERE d IS NULL GROUP BY hour, kind
)
SELECT CAST(batch AS BIGINT) AS batch, hour, click_id, CAST(n_rows AS BIGINT) AS n_rows, CAST(cents AS BIGINT) AS cents, record, kind FROM r
""",
    "op13_conversation_repair": _repair_sql(),
    "op1_warc": """
WITH p AS (
  SELECT page_id, sha256(coalesce(html, '')) AS d, strlen(coalesce(html, '')) AS n FROM pages
), f AS (
  SELECT d, min(page_id) AS m FROM p WHERE n >= 100 GROUP BY d
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> m THEN m END AS refers_to
FROM p LEFT JOIN f USING (d)
""",
    "op7_decontaminate": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, m, array_to_string(w[p : p + m - 1], ' ') AS s
  FROM (SELECT item_id, w, least(13, len(w)) AS m, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)
), dw AS (
  SELECT r, m, p, array_to_string(w[p : p + m - 1], ' ') AS s
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d CROSS JOIN (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)
), h AS (
  SELECT r, p, dw.m, item_id FROM dw JOIN bw USING (m, s)
), c AS (
  SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + m)) AS q FROM h) GROUP BY r
), i AS (
  SELECT r, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS k FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS k FROM h) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(k, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN i USING (r)
""",
    "op8_vector_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op5_jaccard_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p : p + least(5, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS p FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)
), r AS (
  SELECT doc_id AS x, doc_id AS y FROM d
  UNION
  SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.y) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.x = d.doc_id GROUP BY d.doc_id, n.n
""",
}
