"""Registered queries of the corpus operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalign.llm import exact_dedup, fim, license_scan, line_dedup, mixing, near_dedup, prefix_trie, quality, sentencepiece_codec, sharding, topk, toxicity, url_filter
from stratalign.llm._util import LOWER, UPPER

#: The rules of the URL query.
URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"), min_docs=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def _judged(scored: DataFrame, least: float) -> DataFrame:
    return scored.select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= least, 1).otherwise(0).alias("predicted"),
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return _judged(quality.score_quality(docs, _table(spark, sf_dir, "labels")), 0.3)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return _judged(toxicity.score_toxicity(docs, _table(spark, sf_dir, "labels")), 0.5)


#: A SentencePiece model file on the driver.
MODEL = os.environ.get("STRATALIGN_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.count_ids(sentencepiece_codec.encode(docs, MODEL, check=True)).select("doc_id", "n_ids", "ids", "decoded_ok", "n_commits")


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", scale=256)
    queries = vectors.filter(F.col("id") % 50 == 0)
    return topk.top_k(vectors, queries, k=5).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), width=4, per_cent=80)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"), keep="max")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    weight = mixing.quality_weight(docs, _table(spark, sf_dir, "labels"))
    return mixing.mix_sources(docs, weight=weight).select("doc_id", "size", "source_size", "target", "taken")


def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of pages: a page is bad if its label says junk or toxic; without either label its outcome is null.

    The tables have no labels of pages. Those of the document with a page's id are a stand-in, and no
    evidence on hosts: at sf0.1 the language in the URL is that of the document in 1,112 of 2,500
    rows, and hosts named casino or bets have 0.24 bad labels (of 21), the others 0.26 (of 950).
    """
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    return _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.filter_urls(_table(spark, sf_dir, "pages"), page_labels(spark, sf_dir), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan_licenses(_table(spark, sf_dir, "documents"))
    return out.withColumns({"notices": F.array_join("notices", ","), "blocks": F.array_join("blocks", ",")})


#: Shards of the sharding query, all of one weight.
SHARDS = 40


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.place(_table(spark, sf_dir, "documents"), [1.0] * SHARDS, grown=1.0)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.transform(_table(spark, sf_dir, "documents").select("doc_id", "text"), seed=42, rate=50, spm_share=80)
    restored = fim.restore(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.grafted(prefix_trie.turns_of(_table(spark, sf_dir, "conversations"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_top_k": op2_top_k,
        "op6_sentencepiece": op6_sentencepiece,
        "op7_quality": op7_quality,
        "op8_near_dedup": op8_near_dedup,
        "op9_toxicity": op9_toxicity,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_mix_sources": op4_mix_sources,
        "op5_url_filter": op5_url_filter,
        "op10_license_scan": op10_license_scan,
        "op11_sharding": op11_sharding,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_prefix_trie": op13_prefix_trie,
    }


# ---------------------------------------------------------------- SQL

def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP1_SQL = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
common AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, c.key IS NOT NULL AS gone FROM k LEFT JOIN common c USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP3_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

OP4_SQL = r"""
WITH plain AS (
  SELECT doc_id, source, coalesce(text, '') AS t, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
shape AS (
  SELECT doc_id, source, size, greatest(length(t), 1)::DOUBLE AS n, (length(t) - length(translate(t, '*%$#&|!', '')))::DOUBLE / greatest(length(t), 1)::DOUBLE AS noisy FROM plain),
binned AS (
  SELECT *, 4 * ((noisy > 0.001e0)::INT + (noisy > 0.01e0)::INT + (noisy > 0.05e0)::INT) + (n / greatest(size, 1)::DOUBLE > 4e0)::INT + (n / greatest(size, 1)::DOUBLE > 6e0)::INT + (n / greatest(size, 1)::DOUBLE > 9e0)::INT AS bin
  FROM shape),
known AS (SELECT doc_id, max(quality) AS good FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
fitted AS (SELECT bin, (sum(good)::DOUBLE + 1e0) / (count(*)::DOUBLE + 2e0) AS weight FROM binned JOIN known USING (doc_id) GROUP BY bin),
sized AS (
  SELECT doc_id, source, size, -ln((CAST(('0x' || substr(md5('mix-1|' || CAST(doc_id AS VARCHAR)), 1, 13)) AS BIGINT) + 0.5e0) / 4503599627370496e0) / coalesce(weight, 0.5e0) AS key
  FROM binned LEFT JOIN fitted USING (bin)),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
capped AS (SELECT *, 3 * source_size AS cap, [5, 2, 1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS weight FROM per),
levels AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / CAST(sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lv
  FROM capped WINDOW f AS (ORDER BY cap::DOUBLE / weight::DOUBLE, source ASC NULLS LAST)),
level AS (SELECT max(lv) FILTER (lv * weight <= cap) AS lv FROM levels),
targets AS (SELECT source, source_size, CASE WHEN level.lv * weight <= cap THEN level.lv * weight ELSE cap::DOUBLE END AS target FROM capped, level),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM targets),
run AS (
  SELECT s.*, p.source_size, p.target, p.epochs, p.target - (p.epochs * p.source_size)::DOUBLE AS need,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN size > 0 AND (before + size)::DOUBLE - need <= need - before::DOUBLE THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM run
"""


def op5_sql() -> str:
    parsed = url_filter.parse_rules(URL_RULES)
    fits = [f"(host = {_q(h)} OR host LIKE {_q('%.' + h)}) AND path LIKE {_q(p + '%')}" for _, h, p, _ in parsed]
    rule = "CASE " + " ".join(f"WHEN {f} THEN {_q(r[0])}" for f, r in zip(fits, parsed, strict=True)) + " END"
    decided = "CASE " + " ".join(f"WHEN {f} THEN {_q(r[3])}" for f, r in zip(fits, parsed, strict=True)) + " END"
    second = "|".join(url_filter.SECOND_LEVEL)

    def level(name: str, source: str, key: str) -> str:
        return f"""
{name}_m AS (SELECT sum((bad - n * prior) * (bad - n * prior) - n * prior * (1 - prior)) AS excess, sum(n * (n - 1) * prior * (1 - prior)) AS room FROM {source}),
{name}_s AS (SELECT 1e0 / CASE WHEN room > 0 THEN least(greatest(excess / room, 1e0 / 1001), 1e0 / 3) ELSE 1e0 / 1001 END - 1e0 AS strength FROM {name}_m),
{name} AS (SELECT {key}, n, strength, (bad + strength * prior) / (n + strength) AS mean FROM {source}, {name}_s)"""

    return rf"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
o AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS bad
      FROM p JOIN labels ON page_id = doc_id GROUP BY host),
b AS (SELECT DISTINCT host, regexp_replace(host, '^.*@|:[0-9]*$|\.$', '', 'g') AS bare FROM p),
x AS (SELECT host, bare, CASE WHEN regexp_matches(bare, '^[0-9.]+$|^\[.*\]$') THEN ''
      WHEN regexp_matches(bare, '\.((?:{second})\.[a-z]{{2}})$') THEN regexp_extract(bare, '\.((?:{second})\.[a-z]{{2}})$', 1)
      ELSE regexp_extract(bare, '([^.]*)$', 1) END AS suffix FROM b),
dim AS (SELECT host, suffix, CASE WHEN suffix = '' THEN bare WHEN contains(suffix, '.') THEN regexp_extract(bare, '((?:[^.]*\.)?[^.]*\.[^.]*)$', 1)
        ELSE regexp_extract(bare, '((?:[^.]*\.)?[^.]*)$', 1) END AS domain FROM x),
c AS (SELECT dim.*, coalesce(n, 0e0) AS n, coalesce(bad, 0e0) AS bad FROM dim LEFT JOIN o USING (host)),
dn AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM c GROUP BY ALL),
sn AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (coalesce(sum(bad), 0e0) + 0.5) / (coalesce(sum(n), 0e0) + 1e0) FROM c) AS prior FROM dn GROUP BY suffix),
{level("ps", "sn", "suffix")},
dp AS (SELECT dn.*, ps.mean AS prior FROM dn JOIN ps USING (suffix)),
{level("pd", "dp", "domain, suffix")},
hp AS (SELECT c.*, pd.mean AS prior FROM c JOIN pd USING (domain, suffix)),
{level("ph", "hp", "host")},
r AS (SELECT p.*, {rule} AS rule, {decided} AS decided FROM p)
SELECT page_id, r.host, path, rule,
       coalesce(decided, CASE WHEN mean - 1.645e0 * sqrt(mean * (1 - mean) / (n + strength + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM r JOIN ph ON r.host = ph.host
"""


def op10_sql() -> str:
    whole, lines = license_scan.catalogue()
    words = r"' ' || trim(regexp_replace(x, '[^\p{L}\p{N}]+', ' ', 'g'), ' ') || ' '"
    for word, instead in license_scan.SPELLINGS:
        words = f"replace({words}, {_q(f' {word} ')}, {_q(f' {instead} ')})"
    texts = sorted({(license_scan.canonical_text(f), name) for name, text in license_scan.TEXTS.items() for f in license_scan.forms_of(name, text)})
    values = lambda d: ", ".join(f"({_q(k)}, {_q(v)})" for k, v in sorted(d.items()))
    return rf"""
WITH whole(digest, license) AS (VALUES {values(whole)}), notice(line, name) AS (VALUES {values(lines)}),
known(canon, name) AS (VALUES {", ".join(f"({_q(c)}, {_q(n)})" for c, n in texts)}),
c AS (SELECT doc_id, list_filter(list_transform(
        list_filter(string_split(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), chr(10)), lambda x: NOT regexp_matches(x, {_q(license_scan.COPYRIGHT_LINE)})),
        lambda x: trim({words}, ' ')), lambda x: x <> '') AS ls FROM documents),
d AS (SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, sha256(coalesce(array_to_string(ls, ' '), '')) AS digest, ls FROM c),
b AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS blocks FROM d JOIN known ON contains(' ' || coalesce(array_to_string(ls, ' '), '') || ' ', ' ' || canon || ' ') GROUP BY doc_id),
n AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS notices FROM (SELECT doc_id, unnest(ls) AS line FROM d) JOIN notice USING (line) GROUP BY doc_id)
SELECT d.doc_id, d.digest, n_lines, CASE WHEN n_lines > 0 THEN license END AS license, coalesce(blocks, '') AS blocks, coalesce(notices, '') AS notices
FROM d LEFT JOIN whole USING (digest) LEFT JOIN n USING (doc_id) LEFT JOIN b USING (doc_id)
"""


def crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, bit by bit from its polynomial."""
    steps = f"flatten(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: [('0x' || x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    start = "list_concat([4294967295::BIGINT], " + steps + ")"
    return f"xor(list_reduce({start}, lambda c, s: CASE WHEN s >= 0 THEN xor(c, s) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"


def _unit_sql(*parts: str) -> str:
    return f"((CAST(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13)) AS BIGINT) + 0.5e0) / 4503599627370496e0)"


def op11_sql() -> str:
    word = "coalesce(CAST(doc_id AS VARCHAR), 'null')"
    unit = _unit_sql("'shard'", word, "CAST(s AS VARCHAR)")
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
r AS (SELECT doc_id, CAST(strlen(t) + {sharding.OVERHEAD} AS BIGINT) AS size, {crc32_sql('t')} AS crc FROM t),
k AS (SELECT DISTINCT doc_id FROM documents),
x AS (SELECT doc_id, s, -ln({unit}) AS score FROM k, range({SHARDS + 1}) g(s)),
b AS (SELECT doc_id, arg_min(s, struct_pack(a := score, b := s)) FILTER (s < {SHARDS}) AS shard, arg_min(s, struct_pack(a := score, b := s)) AS grown FROM x GROUP BY doc_id)
SELECT r.doc_id, size, crc AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY {_unit_sql("'slot'", word.replace("doc_id", "r.doc_id"), "CAST(crc AS VARCHAR)")}, r.doc_id NULLS LAST, size, crc) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard
FROM r JOIN b ON r.doc_id IS NOT DISTINCT FROM b.doc_id
"""


OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
d AS (SELECT *, CAST(len(u) AS BIGINT) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
             least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM d),
c AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:n], ''), '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM c
"""

OP13_SQL = rf"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS r FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {crc32_sql('CAST(conv_id AS VARCHAR)')} % 4 AS h FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
w AS (SELECT c.conv_id, 0 AS own, o.r, role, text FROM c JOIN o ON o.conv_id = base AND o.r <= h UNION ALL SELECT c.conv_id, 1, o.r, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND o.r > h),
l AS (SELECT conv_id, list(to_json([role, text])::VARCHAR ORDER BY own, r) AS turns, list(CAST(len(regexp_extract_all(text, '[^ 	-
]+')) AS BIGINT) ORDER BY own, r) AS sizes FROM w GROUP BY conv_id),
e AS (SELECT c.conv_id, coalesce(turns, []) AS turns, coalesce(sizes, []) AS sizes FROM c LEFT JOIN l USING (conv_id)),
m AS (SELECT conv_id, d, len(turns) AS whole, sha256(to_json(turns[1:d])::VARCHAR) AS node, CASE WHEN d > 0 THEN sha256(to_json(turns[1:d - 1])::VARCHAR) END AS up, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS words
      FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM e)),
n AS (SELECT node, any_value(d) AS depth, any_value(up) AS up, any_value(words) AS words, min(conv_id) AS rep, count(*) AS n, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = whole), '')) AS ends FROM m GROUP BY node),
k AS (SELECT up, count(*) AS children FROM n WHERE up IS NOT NULL GROUP BY up),
f AS (SELECT n.*, coalesce(children, 0) AS children FROM n LEFT JOIN k ON k.up = n.node),
s AS (SELECT m.node, CAST(sum((f.n - 1) * f.words) AS BIGINT) AS saved, CAST(sum((f.children = 0)::INT) AS BIGINT) AS leaves FROM f JOIN m ON m.conv_id = f.rep AND m.d <= f.depth GROUP BY m.node)
SELECT f.rep AS conv_id, f.depth, p.rep AS parent_conv_id, f.n AS n_convs, f.children AS n_children, leaves AS n_leaves, saved AS saved_tokens, f.ends AS ends_sha256
FROM f JOIN s USING (node) LEFT JOIN n p ON p.node = f.up
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op2_top_k": OP2_SQL, "op3_exact_dedup": OP3_SQL, "op4_mix_sources": OP4_SQL, "op5_url_filter": op5_sql(), "op10_license_scan": op10_sql(), "op11_sharding": op11_sql(), "op12_fill_in_middle": OP12_SQL, "op13_prefix_trie": OP13_SQL}
