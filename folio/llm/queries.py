"""Queries opN_<name> over the synthetic tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import bpe, chat, chosen_path, collision, factors, fingerprint, merkle, packing, suffixes, toxicity, urlfilter, variants, warc
from folio.llm.common import spread, table


def op1_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, among all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return collision.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op3_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near copies and its number of links."""
    return chosen_path.similar_documents(spread(table(spark, sf_dir, "documents")))


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y, common = p.size AND common = q.size AS equal FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 5 * common >= 4 * (p.size + q.size - common)
  UNION ALL SELECT a.doc_id, b.doc_id, TRUE FROM w a JOIN w b ON len(a.ws) = 0 AND len(b.ws) = 0 AND a.doc_id <> b.doc_id
), r(x, y) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y
), k AS (
  SELECT x AS doc_id, min(y) AS class_id FROM r GROUP BY x
), m AS (
  SELECT x AS doc_id, count(*) AS n_links, count(*) FILTER (equal) AS n_equal FROM l GROUP BY x
)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, coalesce(n_equal, 0) + 1 AS n_copies, doc_id = class_id AS is_representative FROM k LEFT JOIN m USING (doc_id)
"""


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens, as instructions whose first half bears no loss: a sequence has at
    most 64 segments and 3072 tokens that bear loss."""
    limits = packing.Limits(segments=64, loss=3072, padded=False)
    pieces = packing.pack_documents(spread(table(spark, sf_dir, "documents")), public_tokenizers.path("word_bpe_49k.json"), limits=limits, prompt_share=0.5)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded, as digests."""
    coded = bpe.encode_and_decode(spread(table(spark, sf_dir, "documents")), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from the labels of rows that are not held out."""
    out = toxicity.score_documents(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the control case -7, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "\\### Assistant: </turn> ok"
    control = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.summarize(chat.format_conversations(rows.unionByName(control)))


OP6_SQL = r"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' ELSE 'Assistant' END AS label,
         replace(replace(replace(replace(text, '\', '\b'), '#', '\h'), '<', '\l'), ':', '\c') AS escaped
  FROM t
), d AS (
  SELECT conv_id, count(*) AS n_turns,
         sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
         CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
         sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
         CAST(sum(length('### ' || label || ': ' || escaped || ' </turn>' || chr(10))) AS BIGINT) AS formatted_chars
  FROM e GROUP BY conv_id
), o AS (
  SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS n FROM t
), m(state, role, target) AS (
  VALUES ('start', 'system', 'primed'), ('start', 'user', 'asked'), ('primed', 'user', 'asked'), ('asked', 'assistant', 'answered'), ('answered', 'user', 'asked')
), w(conv_id, n, state, error_at) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 'start', CAST(NULL AS BIGINT) FROM t
  UNION ALL
  SELECT w.conv_id, w.n + 1, coalesce(m.target, 'broken'), CASE WHEN w.error_at IS NULL AND m.target IS NULL THEN w.n ELSE w.error_at END
  FROM w JOIN o ON o.conv_id = w.conv_id AND o.n = w.n LEFT JOIN m ON m.state = w.state AND m.role = o.role
)
SELECT d.*, w.error_at IS NULL AND w.state = 'answered' AS valid,
       CAST(CASE WHEN w.error_at IS NULL AND w.state <> 'answered' THEN n_turns ELSE w.error_at END AS INTEGER) AS error_at, w.state
FROM d JOIN w ON w.conv_id = d.conv_id AND w.n = d.n_turns
"""


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, with likenesses."""
    return fingerprint.compare_edited(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through ARC and WARC archives and back."""
    return warc.archive_pages(table(spark, sf_dir, "pages"))


OP8_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN first_id END AS refers_to
FROM f
"""


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes that strings of 100 bytes repeat."""
    out = suffixes.repeated_bytes(spread(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = """
WITH h AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), n AS (
  SELECT doc_id, x, CAST(length(x) // 2 AS BIGINT) AS n_bytes FROM h
), c AS (  -- pieces of 512 starts keep substr() cheap
  SELECT doc_id, 512 * j AS base, least(512, n_bytes - 99 - 512 * j) AS starts, substr(x, 1024 * j + 1, 2 * (512 + 99)) AS piece
  FROM (SELECT doc_id, x, n_bytes, unnest(range(0, (n_bytes - 99 + 511) // 512)) AS j FROM n WHERE n_bytes >= 100)
), w AS (
  SELECT doc_id, base + i AS i, md5_number(substr(piece, 2 * i + 1, 200)) AS k FROM (SELECT doc_id, base, piece, unnest(range(0, starts)) AS i FROM c)
), f AS (
  SELECT k, min((doc_id, i)) AS first FROM w GROUP BY k HAVING count(*) > 1
), d AS (
  SELECT w.doc_id, w.i FROM w JOIN f USING (k) WHERE (w.doc_id, w.i) > f.first
), r AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS last FROM d
), g AS (
  SELECT doc_id, i, sum(CASE WHEN last IS NULL OR i > last + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r
), p AS (
  SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, run
), q AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM p
), kept AS (
  SELECT doc_id, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS x, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans
  FROM q JOIN n USING (doc_id) GROUP BY doc_id
)
SELECT n.doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.x, n.x))) AS kept_sha256 FROM n LEFT JOIN kept USING (doc_id)
"""


def op10_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words that windows of 35 words repeat."""
    out = factors.repeated_words(spread(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), n AS (
  SELECT doc_id, words, CAST(len(words) AS BIGINT) AS n_words FROM w
), x AS (
  SELECT doc_id, i, sha256(array_to_string(words[i:i + 34], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, n_words - 33)) AS i FROM n WHERE n_words >= 35)
), r AS (
  SELECT doc_id, list(i) AS hits FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS c FROM x) WHERE c > 1 GROUP BY doc_id
), k AS (
  SELECT n.doc_id, n_words, words, list_distinct(flatten(list_transform(coalesce(hits, []), lambda i: range(i, i + 35)))) AS gone
  FROM n LEFT JOIN r USING (doc_id)
), m AS (
  SELECT doc_id, n_words, CAST(len(gone) AS BIGINT) AS n_removed, words, list_sort(list_filter(range(1, n_words + 1), lambda j: NOT list_contains(gone, j))) AS kept FROM k
)
SELECT doc_id, n_words, n_removed, sha256(array_to_string(list_transform(kept, lambda j: words[j]), ' ')) AS kept_sha256 FROM m
"""


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the manifest of all, with the leaves of a fifth presented as tampered."""
    docs = table(spark, sf_dir, "documents")
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.leaf([*columns[:4], lowered]))
    rows = docs.select("doc_id", "source", merkle.leaf(columns).alias("leaf"), tampered.alias("presented"))
    return merkle.manifest(rows, "source", "doc_id", "leaf", "presented").drop("source", "presented")


#: crc32 as DuckDB SQL has none: the table-free form, folded over the decimal digits of an id.
_CRC32 = """(
  list_reduce(list_prepend(4294967295, list_transform(range(1, length({s}) + 1), lambda i: CAST(ascii(substr({s}, i, 1)) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [1, 2, 3, 4, 5, 6, 7, 8]), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""

OP11_SQL = r"""
WITH RECURSIVE f AS (
  SELECT doc_id, source, text,
         coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
         || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head
  FROM documents
), l AS (
  SELECT doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(octet_length(encode(text)) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) AS lowered,
         xor({crc}, 4294967295) % 5 = 0 AS tampered
  FROM f
), p AS (
  SELECT *, 1 + dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS nodes FROM l
), up(tree, lvl, pos, nodes, digest) AS (
  SELECT tree, 0, pos, nodes, leaf FROM p
  UNION ALL SELECT tree, lvl + 1, pos // 16, (nodes + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM up WHERE nodes > 1 GROUP BY tree, lvl, pos // 16, nodes
), s AS (
  SELECT tree, lvl, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS nodes FROM up WHERE nodes = 1
), above(lvl, pos, nodes, digest) AS (
  SELECT 0, pos, nodes, digest FROM s
  UNION ALL SELECT lvl + 1, pos // 16, (nodes + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM above WHERE nodes > 1 GROUP BY lvl, pos // 16, nodes
), n AS (
  SELECT tree, lvl, pos, nodes, digest FROM up UNION ALL SELECT 0, lvl, pos, nodes, digest FROM above
), r AS (
  SELECT tree, lvl, pos // 16 AS run, string_agg(digest, '' ORDER BY pos) AS digests FROM n WHERE nodes > 1 GROUP BY ALL
), e AS (  -- a leaf's runs: those of its own tree, then those of the tree of sources
  SELECT p.doc_id, p.tree, r.lvl AS step, CAST(p.pos // CAST(16 ** r.lvl AS BIGINT) % 16 AS BIGINT) AS place, digests
  FROM p JOIN r ON r.tree = p.tree AND r.run = p.pos // CAST(16 ** (r.lvl + 1) AS BIGINT)
  UNION ALL
  SELECT p.doc_id, p.tree, s.lvl + r.lvl, CAST(s.pos // CAST(16 ** r.lvl AS BIGINT) % 16 AS BIGINT), digests
  FROM p JOIN s ON s.tree = p.tree JOIN r ON r.tree = 0 AND r.run = s.pos // CAST(16 ** (r.lvl + 1) AS BIGINT)
), w AS (
  SELECT doc_id, step, substr(digests, 1, 64 * place) AS before, substr(digests, 64 * place + 65) AS after FROM e
), proofs AS (
  SELECT doc_id, string_agg(before || after, '' ORDER BY step) AS proof FROM w GROUP BY doc_id
), folded(doc_id, step, digest) AS (
  SELECT doc_id, 0, CASE WHEN tampered THEN lowered ELSE leaf END FROM p
  UNION ALL SELECT f.doc_id, f.step + 1, sha256(before || digest || after) FROM folded f JOIN w ON w.doc_id = f.doc_id AND w.step = f.step
), z AS (
  SELECT doc_id, arg_max(digest, step) AS folded_root FROM folded GROUP BY doc_id
), root AS (
  SELECT digest AS root FROM above WHERE nodes = 1
)
SELECT p.doc_id, p.leaf, s.digest AS subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM p JOIN s ON s.tree = p.tree JOIN z ON z.doc_id = p.doc_id LEFT JOIN proofs ON proofs.doc_id = p.doc_id, root
""".replace("{crc}", _CRC32.format(s="CAST(doc_id AS VARCHAR)"))


#: The rules of op12: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host and path, the rule that fits its URL, and the verdict; URLs under no listed key are allowed."""
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "url"))
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.judge(pages, rules).drop("url")


OP12_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS host FROM u
), p AS (
  SELECT page_id, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') AS path FROM h
), r(rule_host, rule_path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), f AS (
  SELECT page_id, host, path, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS k
  FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM p LEFT JOIN f ON f.page_id = p.page_id AND f.k = 1
"""


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word of all documents with its near words, the form it is a variant of, and that chain's root."""
    return variants.variants(variants.words_of(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))))


OP13_SQL = r"""
WITH RECURSIVE crc AS (  -- the table of the polynomial, by its rule
  SELECT list_transform(range(0, 256), lambda b: list_reduce(list_prepend(b, range(0, 8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS t
), r AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents
), d AS (
  SELECT id, run, count(*) AS k, list_transform(regexp_extract_all(hex(encode(id || ':' || run)), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM r WHERE length(run) >= 7 GROUP BY id, run
), h AS (
  SELECT run, k, coalesce(xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(t[xor(c, b) % 256 + 1], c // 256)), 4294967295), 1) AS h FROM d, crc
), w AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n
  FROM (SELECT k, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2
), x AS (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)
), p AS (
  SELECT a.word AS a, b.word AS b FROM x a JOIN x b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT x.word, w.word FROM x JOIN w ON w.word = x.cut
  UNION SELECT w.word, x.word FROM x JOIN w ON w.word = x.cut
), g AS (
  SELECT a, count(*) AS n_near, arg_min(b, (-n, b)) AS near, max(n) AS near_n FROM p JOIN w ON w.word = p.b GROUP BY a
), f AS (
  SELECT word, CASE WHEN near_n >= 10 * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n FROM w LEFT JOIN g ON a = word
), c(word, leads_to, depth) AS (
  SELECT word, word, 0 FROM f UNION ALL SELECT c.word, f.form, depth + 1 FROM c JOIN f ON f.word = c.leads_to WHERE f.form IS NOT NULL
)
SELECT f.word, form, arg_max(leads_to, depth) AS root, n, n_near, form_n FROM f JOIN c ON c.word = f.word GROUP BY ALL
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The numbered queries by name."""
    return {
        "op1_collision": op1_collision,
        "op2_packing": op2_packing,
        "op3_chosen_path": op3_chosen_path,
        "op4_bpe": op4_bpe,
        "op5_toxicity": op5_toxicity,
        "op6_chat": op6_chat,
        "op7_fingerprints": op7_fingerprints,
        "op8_warc": op8_warc,
        "op9_suffixes": op9_suffixes,
        "op10_factors": op10_factors,
        "op11_merkle": op11_merkle,
        "op12_url_filter": op12_url_filter,
        "op13_variants": op13_variants,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the numbered queries that SQL expresses."""
    return {"op3_chosen_path": OP3_SQL, "op6_chat": OP6_SQL, "op8_warc": OP8_SQL, "op9_suffixes": OP9_SQL, "op10_factors": OP10_SQL, "op11_merkle": OP11_SQL, "op12_url_filter": OP12_SQL, "op13_variants": OP13_SQL}
