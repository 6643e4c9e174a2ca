"""The queries of this package and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ._util import table
from .exact_dedup import exact_dedup
from .fim import fill_in_middle, restore
from .jaccard_join import jaccard_join
from .line_dedup import page_line_dedup
from .merkle import merkle_manifest
from .mixing import mix
from .near_vectors import near_vectors
from .packing import best_fit_pack
from .quality import classify_quality
from .sharding import shard_by_bytes
from .substring_dedup import repeated_passages
from .token_counts import edited_token_counts
from .topk import exact_topk


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its site's boilerplate lines dropped."""
    return page_line_dedup(table(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token count before and after redaction edits."""
    return edited_token_counts(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of a passage that repeats across documents."""
    ensure_checkpoint_dir(spark)
    return repeated_passages(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", "n_words", "kept", "keep_doc_id")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of eight shards of near equal bytes."""
    return shard_by_bytes(table(spark, sf_dir, "documents"), 8)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of byte-equal texts."""
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix of sources takes from it."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score."""
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 2048 tokens."""
    return best_fit_pack(table(spark, sf_dir, "documents"), special=True)


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest inner products of every hundredth vector."""
    return exact_topk(table(spark, sf_dir, "embeddings"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of links at 90 % shared three-word shingles."""
    return jaccard_join(table(spark, sf_dir, "documents"), 3, 90)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and root; one of seven has its length tampered with."""
    ensure_checkpoint_dir(spark)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    # as a decimal, so the largest length does not overflow
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    return merkle_manifest(table(spark, sf_dir, "documents"), altered=tampered, changes={"n_chars": more})


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links of cosine 0.98 or more inside its label, and their component."""
    ensure_checkpoint_dir(spark)
    return near_vectors(table(spark, sf_dir, "embeddings"), 0.98)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut at two lines and reordered, with digests of the output and of the text rebuilt from it."""
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_line_dedup, op2_token_counts, op3_substring_dedup, op4_sharding, op5_exact_dedup, op6_source_mixing,
    op7_quality_classifier, op8_best_fit_packing, op9_exact_topk, op10_jaccard_join, op11_merkle_manifest,
    op12_embedding_near_dedup, op13_fill_in_middle)}

_WORD = "[^\\x20\\x09-\\x0D]+"

ORACLE: dict[str, str] = {
    "op1_line_dedup": r"""
WITH raw AS (
  SELECT page_id, nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '') AS host,
    regexp_replace(regexp_replace(html, '<(?:script|style)\b.*?</(?:script|style)>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs') AS t FROM pages),
plain AS (
  SELECT page_id, host, regexp_replace(regexp_replace(t,
    '</?(?:p|div|ul|ol|li|h[1-6]|br|hr|tr|td|th|table|nav|article|section|header|footer|title|head|body|html|meta)(?:[\s/][^<>]*)?>', chr(10), 'gi'),
    '<[^<>]*>', '', 'g') AS t FROM raw),
chars AS (
  SELECT page_id, host, replace(replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
    '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS t FROM plain),
body AS (
  SELECT row_number() OVER () AS r, page_id, host, regexp_replace(regexp_replace(regexp_replace(t, '[ \t\r]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'),
    '^[ \n]+|[ \n]+$', '', 'g') AS text FROM chars),
line AS (
  SELECT r, page_id, host, i, string_split(text, chr(10))[i] AS l FROM (
    SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM body)),
total AS (SELECT host, count(*) AS n FROM body WHERE host IS NOT NULL GROUP BY host),
bad AS (
  SELECT host, trim(l) AS l FROM line JOIN total USING (host) WHERE trim(l) <> '' GROUP BY host, trim(l), n
  HAVING count(DISTINCT r) >= 5 AND count(DISTINCT r) > n * 0.1::DOUBLE),
judged AS (SELECT line.*, bad.l IS NOT NULL AS gone FROM line LEFT JOIN bad ON bad.host = line.host AND bad.l = trim(line.l)),
kept AS (
  SELECT r, count(i) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text FROM judged GROUP BY r)
SELECT page_id, host, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
  CASE WHEN body.text IS NOT NULL THEN kept.text END AS text FROM body LEFT JOIN kept USING (r)""",
    "op5_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op6_source_mixing": rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (
  SELECT source, sum(size)::DOUBLE AS words, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS w
  FROM d GROUP BY source),
-- sources fill up in the order of words / w; the level is set by those that stay below their top
f AS (
  SELECT *, 1.5::DOUBLE * sum(words) OVER () AS total,
    coalesce(sum(2 * words) OVER (ORDER BY words / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
    sum(w) OVER (ORDER BY words / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left FROM s),
level AS (SELECT (total - full_before) / weight_left AS c FROM f WHERE 2 * words >= (total - full_before) / weight_left * w ORDER BY words / w, source LIMIT 1),
t AS (SELECT source, words, least(2 * words, coalesce((SELECT c FROM level) * w, 2 * words)) AS target FROM s),
r AS (SELECT *, CASE WHEN words > 0 THEN floor(target / words + 1e-9) ELSE 0 END AS base FROM t),
x AS (
  SELECT d.*, r.words, r.target, r.base, r.target - r.base * r.words AS rest,
    sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2.0::DOUBLE AS middle
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, words::BIGINT AS source_size, target, (size * (base + CASE WHEN middle <= greatest(rest, 0) THEN 1 ELSE 0 END))::BIGINT AS taken FROM x""",
    "op9_exact_topk": """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r, a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.r <> b.r AND len(a.q) = len(b.q)),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 10""",
    "op10_jaccard_join": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT *, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) IN (1, 2)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.c)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(c) AS component_id
FROM w JOIN reach r ON r.doc_id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id""",
    "op11_merkle_manifest": """
WITH RECURSIVE bytes AS (  -- CRC-32 of one byte by its polynomial
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(b))),
d AS (
  SELECT doc_id, lang, n_chars, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') AS front, coalesce(strlen(text) || ':' || text, '-') AS back,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 7 = 0 AS tampered FROM documents, bytes),
leaf AS (
  SELECT doc_id, lang, sha256(front || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || back) AS leaf,
    sha256(front || coalesce(strlen((n_chars::HUGEINT + 1)::VARCHAR) || ':' || (n_chars::HUGEINT + 1), '-') || back) AS changed, tampered FROM d),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaf),
node AS (
  SELECT lang, 0 AS lvl, pos, n, leaf AS digest FROM placed
  UNION ALL SELECT lang, any_value(lvl) + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM node WHERE n > 1 GROUP BY lang, pos // 2),
sub AS (
  SELECT lang, lvl AS height, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM node WHERE n = 1),
upper AS (
  SELECT 0 AS lvl, place AS pos, (SELECT count(*) FROM sub) AS n, subroot AS digest FROM sub
  UNION ALL SELECT any_value(lvl) + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM upper WHERE n > 1 GROUP BY pos // 2),
path AS (  -- every leaf's places on its way up: in its own tree, then in the tree of subroots
  SELECT p.lang, p.pos AS leaf_pos, i AS step, s.digest, node_pos & 1 = 1 AS is_right FROM (
    SELECT lang, pos, unnest(range(0, height)) AS i, pos >> unnest(range(0, height)) AS node_pos FROM placed JOIN sub USING (lang)
    UNION ALL SELECT NULL, pos, unnest(range(0, height)), pos >> unnest(range(0, height)) FROM placed, (SELECT height FROM sub WHERE lang IS NULL) WHERE lang IS NULL) p
  LEFT JOIN node s ON s.lang IS NOT DISTINCT FROM p.lang AND s.lvl = i AND s.pos = xor(node_pos, 1)
  UNION ALL SELECT q.lang, q.pos, height + i, u.digest, up_pos & 1 = 1 FROM (
    SELECT placed.lang, pos, height, unnest(range(0, (SELECT max(lvl) FROM upper))) AS i, place >> unnest(range(0, (SELECT max(lvl) FROM upper))) AS up_pos
    FROM placed JOIN sub ON sub.lang IS NOT DISTINCT FROM placed.lang) q
  LEFT JOIN upper u ON u.lvl = i AND u.pos = xor(up_pos, 1)),
way AS (
  SELECT lang, leaf_pos, list(coalesce(digest, '') ORDER BY step) AS siblings, list(is_right ORDER BY step) AS rights, string_agg(digest, '' ORDER BY step) AS joined
  FROM path GROUP BY lang, leaf_pos),
fold AS (
  SELECT p.*, 0 AS done, CASE WHEN tampered AND n > 0 THEN changed ELSE leaf END AS cur, siblings, rights, sha256(coalesce(joined, '')) AS proof
  FROM placed p LEFT JOIN way w ON w.lang IS NOT DISTINCT FROM p.lang AND w.leaf_pos = p.pos
  UNION ALL SELECT doc_id, lang, leaf, changed, tampered, pos, n, done + 1,
    sha256(CASE WHEN rights[done + 1] THEN siblings[done + 1] || cur ELSE cur || siblings[done + 1] END), siblings, rights, proof
  FROM fold WHERE done < coalesce(len(siblings), 0))
SELECT doc_id, leaf, subroot, (SELECT digest FROM upper WHERE n = 1) AS root, proof AS proof_sha256, cur AS folded_root,
  cur = (SELECT digest FROM upper WHERE n = 1) AS verified
FROM fold JOIN sub ON sub.lang IS NOT DISTINCT FROM fold.lang WHERE done = coalesce(len(siblings), 0)""",
    "op12_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e,
    embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok FROM embeddings),
link AS (
  SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.ok AND b.ok AND a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98::DOUBLE),
reach AS (SELECT r, r AS c FROM v UNION SELECT reach.r, link.b FROM reach JOIN link ON link.a = reach.c),
comp AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.c GROUP BY reach.r),
n AS (SELECT a AS r, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN comp USING (r) LEFT JOIN n USING (r)""",
    "op13_fill_in_middle": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units FROM documents),
h AS (
  SELECT *, len(units)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3,
    ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (
  SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""",
}
