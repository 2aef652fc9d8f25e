"""The registered queries of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewake.llm import conversation_trie, decontamination, exact_dedup, language_crf, lattice_lm, lexical_search, line_quality, mixing, near_dedup, quality_classifier, secret_scan, substring_dedup, warc
from candlewake.llm.common import table
from candlewake.plans.registry import Registry

R = Registry()

_OP1 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), n AS (SELECT greatest(1, ceil(sqrt(count(*)) / 8))::BIGINT AS salts FROM d),
k AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src, size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % n.salts AS salt, length(bin(size)) AS bits
  FROM d, n
), s AS (SELECT src, sum(size)::BIGINT AS source_size FROM k GROUP BY src),
w AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY src) - 1) % 3 + 1)::INT] AS w, 2.0 * source_size AS cap FROM s
), l AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT src, source_size, least(cap, coalesce(max(level) FILTER (level * w < cap) OVER () * w, cap))::DOUBLE AS target FROM l
), r AS (
  SELECT k.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('mix-1' || substr(k.src, 2)), 1, 8))::BIGINT / 4294967296.0 AS off,
         row_number() OVER (PARTITION BY k.src ORDER BY bits * 16 + ((size * 16) >> bits), salt, size, doc_id) AS rank
  FROM k JOIN t USING (src)
)
SELECT doc_id, size, source_size, target,
       CASE WHEN size > 0 THEN least(floor(rank * rate + off) - floor((rank - 1) * rate + off), ceil(rate)) * size ELSE 0 END::BIGINT AS taken
FROM r
"""


@R.add(_OP1)
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    narrow = docs.select("doc_id", "source", mixing.text_size(F.col("text")).alias("size"))
    return mixing.mix(narrow, F.col("size")).select(
        "doc_id",
        "size",
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__copies") * F.col("size")).alias("taken"),
    )


_OP2 = r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents
), p AS (
  SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3
), g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t FROM p),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, t) AS n FROM g),
m AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM c WHERE n > 1) GROUP BY rid),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM w),
lw AS (
  SELECT rid, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
         length(regexp_replace(line, '[^|»›•·]', '', 'g')) AS seps, length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS syms
  FROM l
), d AS (
  SELECT rid, count(*) - count(DISTINCT line) AS dup,
         sum(n) FILTER (regexp_matches(line, '[.!?…。！？]["''”’»)\]]*([\x20\x09-\x0D]|$)')
           AND NOT seps >= greatest(2.0, n * 0.25) AND NOT syms >= greatest(2.0, n * 0.3)
           AND NOT (upper(line) = line AND lower(line) <> line AND n >= 4)
           AND NOT (n <= 25 AND regexp_matches(line, '(?i)(javascript|cookies?\b|terms of (use|service)|privacy policy|all rights reserved|copyright|licen[cs]ed under|released under the|lorem ipsum|click here|subscribe|sign up|log ?in\b|share this)'))
         ) AS kept_words
  FROM lw WHERE n > 0 GROUP BY rid
), r AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(d.dup, 0)::BIGINT AS n_dup_lines,
         coalesce(m.n, 0)::BIGINT AS n_repeat_words, coalesce(d.kept_words, 0) AS kept_words
  FROM w LEFT JOIN d USING (rid) LEFT JOIN m USING (rid)
), f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND kept_words >= 0.7 * n_words AS kept
FROM f
"""


@R.add(_OP2)
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    return judged.select("doc_id", *[F.col(f"__quality.{n}") for n in names])


@R.add()
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", secret_scan.spans(F.col("text")).alias("found"))
    number = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("found", lambda x: x["kind"].isin(*[r.kind for r in secret_scan.BASE]))
    return docs.select(
        "doc_id",
        *[number(r.kind).alias(f"n_{r.kind}") for r in secret_scan.BASE],
        F.sha2(secret_scan.joined(base), 256).alias("base_sha256"),
        secret_scan.joined(F.col("found")).alias("spans"),
    )


_OP8 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f USING (digest)
"""


@R.add(_OP8)
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read(warc.write(table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_OP7 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c.n >= 75 * (p.n + q.n - c.n)),
r AS (SELECT DISTINCT doc_id AS id, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id AND r.root < l.b),
g AS (SELECT id, min(root) AS root FROM r GROUP BY id)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, root AS component_id, doc_id = root AS kept
FROM documents JOIN g ON id = doc_id LEFT JOIN n USING (doc_id)
"""


@R.add(_OP7)
def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


_OP4 = r"""
WITH d AS (
  SELECT doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), b AS (
  SELECT item_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM benchmark
), ds AS (SELECT DISTINCT id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
bs AS (SELECT DISTINCT id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT id, count(*) AS n FROM bs GROUP BY id),
c AS (SELECT ds.id AS doc_id, bs.id AS item_id, count(*) AS n_common FROM ds JOIN bs USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_common, n.n AS n_shingles FROM c JOIN n ON n.id = item_id WHERE 100 * n_common >= 75 * n.n
"""


@R.add(_OP4)
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontamination.contaminated(docs, items).withColumnRenamed("id", "doc_id")


@R.add()
def op5_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@R.add()
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_classifier.classify(docs, labels).withColumnRenamed("id", "doc_id")


@R.add()
def op9_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_crf.identify(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@R.add()
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(table(spark, sf_dir, "documents"))


_OP13 = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


@R.add(_OP13)
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


_OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
), n AS (SELECT rid, doc_id, len(ts) AS n, ts FROM d WHERE len(ts) > 0),
a AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM n),
i AS (
  SELECT row_number() OVER () AS iid, item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM (SELECT DISTINCT item_id, text FROM benchmark)
), q AS (SELECT iid, item_id, term, count(*) AS times FROM (SELECT iid, item_id, unnest(ts) AS term FROM i) GROUP BY ALL),
p AS (
  SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(ts) AS term FROM n)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL
), f AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, a GROUP BY term, docs),
s AS (
  SELECT iid, item_id, rid, doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN f USING (term) JOIN n USING (rid), a GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id ASC NULLS LAST)::INT AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20
"""


@R.add(_OP11)
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return lexical_search.search(docs, items).withColumnRenamed("id", "doc_id")


_OP12 = r"""
WITH RECURSIVE c AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
z AS (
  SELECT c, 0 AS j, 4294967295::BIGINT AS x FROM c
  UNION ALL
  SELECT c, j + 1, CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::BIGINT) ELSE y >> 1 END
  FROM (SELECT c, j, CASE WHEN j % 8 = 0 THEN xor(x, ascii(substr(c::VARCHAR, j // 8 + 1, 1))::BIGINT) ELSE x END AS y FROM z WHERE j < 8 * length(c::VARCHAR))
), t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
         md5(coalesce(role, '')) || md5(coalesce(text, '')) AS key, strlen(coalesce(text, ''))::BIGINT AS size
  FROM conversations WHERE conv_id IS NOT NULL
), len AS (SELECT c AS b, count(*) AS n FROM t GROUP BY c),
i AS (
  SELECT c, h, c - c % 5 AS b, least(h, coalesce(n, 0)) AS k
  FROM (SELECT c, xor(x, 4294967295::BIGINT) % 9 AS h FROM z WHERE j = 8 * length(c::VARCHAR)) LEFT JOIN len ON b = c - c % 5
), r AS (
  SELECT i.c, t.pos AS d, key, size FROM i JOIN t ON t.c = i.b AND t.pos <= i.k
  UNION ALL SELECT i.c, t.pos - h + k, key, size FROM i JOIN t ON t.c = i.c AND t.pos > h
), p AS (
  SELECT c, d, size, string_agg(key, '') OVER (PARTITION BY c ORDER BY d) AS path FROM r
  UNION ALL SELECT c, 0, 0, '' FROM c
), n AS (SELECT path, d, min(c) AS m, count(*) AS n, max(size) AS size FROM p GROUP BY path, d),
u AS (SELECT left(path, 64 * (d - 1)::INT) AS path, count(*) AS k FROM n WHERE d > 0 GROUP BY ALL),
s AS (
  SELECT x.path, sum((y.n - 1) * y.size)::BIGINT AS saved, count(*) FILTER (u.k IS NULL) AS leaves
  FROM n x JOIN n y ON starts_with(y.path, x.path) LEFT JOIN u ON u.path = y.path GROUP BY x.path
), e AS (
  SELECT path, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS sha FROM (SELECT c, path FROM p QUALIFY d = max(d) OVER (PARTITION BY c)) GROUP BY path
)
SELECT n.m AS conv_id, n.d::BIGINT AS depth, q.m AS parent_conv_id, n.n AS n_convs, coalesce(u.k, 0) AS n_children, s.leaves AS n_leaves,
       s.saved AS saved_tokens, coalesce(e.sha, sha256('')) AS ends_sha256
FROM n JOIN s USING (path) LEFT JOIN u USING (path) LEFT JOIN e USING (path) LEFT JOIN n q ON n.d > 0 AND q.path = left(n.path, 64 * (n.d - 1)::INT)
"""


@R.add(_OP12)
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.col("conv") - F.col("conv") % 5
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % 9
    return conversation_trie.trie(table(spark, sf_dir, "conversations"), base, head).drop("ref")
