"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingloom.llm import byte_bpe, centroids, chat_format, exact_dedup, fill_middle, graph_ann, line_dedup, minhash, packing, quality_model, quality_rules, url_filters, warc
from filingloom.llm.common import table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "text", F.col("removed_lines").cast("long").alias("removed_lines"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    last = warc.read_chunks(manifest, with_data=False).where("is_last")
    return last.select("page_id", "payload_bytes", F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality_model.classify(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", F.round("posterior", 6).alias("posterior"), F.round("score", 6).alias("score"), "kept")


def op4_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return graph_ann.search(graph_ann.build_index(vectors), vectors.where("vec_id % 100 = 0"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *quality_rules.STATS, "base_failed", "kept", F.round("posterior", 6).alias("posterior"))


def op5_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op5 that SQL can tell: its counts and base test."""
    counted = quality_rules.stats(table(spark, sf_dir, "documents"))
    return counted.select("doc_id", *quality_rules.STATS, quality_rules.base_failed().alias("base_failed"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), url_filters.rules_frame(spark, url_filters.QUERY_RULES))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    done = chat_format.format_conversations(turns)
    back, loss = chat_format.read_back(F.col("formatted")), chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))
    read = done.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), back.alias("back"), loss.alias("loss"))
    line = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(line, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), "formatted_chars",
    )


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_multi_50k.tiktoken"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    back = fill_middle.restore(F.col("output"), F.col("form"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(table(spark, sf_dir, "embeddings"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_warc": op2_warc,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_graph_ann": op4_graph_ann,
        "op5_quality_rules": op5_quality_rules,
        "op5_base_counts": op5_base_counts,
        "op6_url_filters": op6_url_filters,
        "op7_chat_format": op7_chat_format,
        "op8_byte_bpe": op8_byte_bpe,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_minhash_dedup": op10_minhash_dedup,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_centroids": op12_centroids,
        "op13_exact_dedup": op13_exact_dedup,
    }


_OP6 = """
WITH rules(verdict, host, path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
p AS (
  SELECT row_number() OVER () AS rid, page_id,
    translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*(/[^?#]*)', 1) AS path
  FROM pages),
hits AS (
  SELECT rid, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY rid)
SELECT p.page_id, p.host, p.path, h.rule, coalesce(h.verdict, 'allow') AS verdict FROM p LEFT JOIN hits h USING (rid)
"""

_OP7 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
m AS (
  SELECT *, CASE WHEN conv_id IS NULL THEN (turn, role, text) END AS own, lag(role) OVER w IS NOT DISTINCT FROM role AS joined,
    length(text) + length(text) - length(replace(text, '\', ''))
      + len(regexp_extract_all(text, '</?s>|\[/?INST\]|<\|join\|>|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>')) AS body
  FROM t WINDOW w AS (PARTITION BY conv_id, CASE WHEN conv_id IS NULL THEN (turn, role, text) END ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(body + CASE WHEN joined THEN 8 ELSE 9 + length(role) + 7 + 4 END) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id, own
"""


_OP1 = r"""
WITH docs AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (
  SELECT doc_id, i - 1 AS i, lines[i] AS line, len(lines) AS n, len(regexp_extract_all(lines[i], '[^\x20\x09-\x0D]+')) AS w
  FROM docs, LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS i)),
h AS (SELECT *, md5(coalesce(lag(md5(line)) OVER w, '') || md5(line)) AS r, lead(length(line)) OVER w AS next_len, sum(w) OVER w AS upto FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
e AS (SELECT *, coalesce(i = n - 1 OR length(line) >= 240 OR next_len >= 240 OR (i < n - 2 AND r < lag(r) OVER w AND r < lead(r) OVER w), false) AS ends FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, coalesce(sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM e),
spans AS (
  SELECT doc_id, min(i) AS first, max(i) AS last FROM c GROUP BY doc_id, pos HAVING (count(*) > 1 OR max(length(line)) >= 240) AND sum(w) > 0
  UNION SELECT doc_id, 0, max(i) FROM c GROUP BY doc_id HAVING (count(*) > 1 OR max(length(line)) >= 240) AND sum(w) > 0
  UNION SELECT a.doc_id, a.i, min(b.i) FROM e a JOIN e b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.w > 50 WHERE a.w > 0 GROUP BY a.doc_id, a.i
  UNION SELECT b.doc_id, max(a.i), b.i FROM e a JOIN e b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.w > 50 WHERE b.w > 0 GROUP BY b.doc_id, b.i),
runs AS (SELECT doc_id, first, last, array_to_string(lines[first + 1 : last + 1], chr(10)) AS run FROM spans JOIN docs USING (doc_id)),
later AS (SELECT doc_id, first, last FROM (SELECT *, min((doc_id, first)) OVER (PARTITION BY run) AS earliest FROM runs) WHERE (doc_id, first) != earliest),
gone AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS i FROM later),
kept AS (
  SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL) AS text, count(g.i) AS removed_lines
  FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, k.removed_lines FROM docs d JOIN kept k USING (doc_id)
"""

#: Base 32 digits of five bits each, from the hexadecimal digest taken five digits at a time.
_OP2 = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS hex FROM pages),
r AS (SELECT hex, n, max(page_id) AS target FROM p GROUP BY hex, n),
d AS (
  SELECT *, list_transform(range(0, 40, 5), lambda i: CAST('0x' || substr(hex, CAST(i AS INT) + 1, 5) AS BIGINT)) AS twenty FROM p JOIN r USING (hex, n))
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(twenty, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((x >> s) & 31 AS INT) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN target = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN target != page_id THEN target END AS refers_to
FROM d
"""

_OP5_BASE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, w[i : i + 7] AS words FROM t, LATERAL (SELECT unnest(range(1, len(w) - 6)) AS i) WHERE len(w) >= 8),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, words) AS times FROM windows) WHERE times > 1),
covered AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS k FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
s AS (
  SELECT t.doc_id, len(w) AS n_words, coalesce(CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT), 0) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM t LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s
"""

_OP10 = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS shingle FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON w.a = r.b),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, m.component_id = d.doc_id AS kept
FROM documents d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""


_OP11 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), i, 8) AS BIGINT)) AS h
  FROM documents),
f AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
c AS (
  SELECT *, coalesce(array_to_string(u[1 : a], ''), '') AS p, coalesce(array_to_string(u[a + 1 : b], ''), '') AS m, coalesce(array_to_string(u[b + 1 :], ''), '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form != 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM c
"""


def _op12(k: int = 40, rounds: int = 5) -> str:
    """The rounds one after another, each a pair of tables."""
    nearest = """
a{r} AS MATERIALIZED (
  SELECT rid, vec_id, v, struct_extract(best, 'd') AS d, struct_extract(best, 'c') AS c
  FROM (SELECT rid, any_value(vec_id) AS vec_id, any_value(v.v) AS v, min({{'d': CAST(list_sum(list_transform(list_zip(v.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT), 'c': m.c}}) AS best
    FROM v CROSS JOIN m{r} m GROUP BY rid))"""
    moved = """
m{s} AS MATERIALIZED (
  SELECT m.c, coalesce(n.v, m.v) AS v FROM m{r} m LEFT JOIN (
    SELECT c, list(CAST(x AS BIGINT) ORDER BY i) AS v FROM (
      SELECT c, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS x FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY c, i) GROUP BY c) n USING (c))"""
    start = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
m0 AS MATERIALIZED (SELECT c, v FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM v) WHERE c < {k}),"""
    steps = [(nearest.format(r=r), moved.format(r=r, s=r + 1)) for r in range(rounds)]
    body = ",".join(x for pair in steps for x in pair) + "," + nearest.format(r=rounds)
    return f"""{start}{body}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN m{rounds} m USING (c)
"""


_OP13 = r"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256 FROM t WINDOW w AS (PARTITION BY text)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": _OP1, "op2_warc": _OP2, "op5_base_counts": _OP5_BASE, "op6_url_filters": _OP6, "op7_chat_format": _OP7, "op10_minhash_dedup": _OP10,
        "op11_fill_in_middle": _OP11, "op12_centroids": _op12(), "op13_exact_dedup": _OP13}
