"""The registered queries of this subpackage, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm import outliers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents, write framed records in doc_id order, and read the files back."""
    from quernel.llm import records

    return records.read_records(records.write_records(table(spark, sf_dir, "documents"), tokenizer_path()))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of at least 40 code points in at least 5 documents stay in the largest doc_id alone."""
    from quernel.llm import linededup

    return linededup.dedup_lines(table(spark, sf_dir, "documents"), least=5, shortest=40, with_text=False)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles have a similarity of at least 0.85."""
    from quernel.llm import bottomk

    return bottomk.near_duplicates(table(spark, sf_dir, "documents"), words=3, similarity=0.85)


def op4_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append all documents as 16 arrivals of small shards, compact them by size, and read the last version."""
    from quernel.llm import compaction
    from quernel.llm._shared import scratch
    from quernel.llm.mixing import unit

    arrival = F.pmod(unit(F.col("doc_id")), F.lit(16))
    store = compaction.ShardStore(spark, scratch(spark, "shards"), fan_in=4, base_bytes=1 << 20, target_bytes=128 << 20)
    store.append_all(table(spark, sf_dir, "documents"), arrival)
    return store.read().select(
        "doc_id", "lang", "source", "n_chars", arrival.alias("arrival"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    )


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draw documents like those labelled good and not toxic, as many as their share of the labels tells."""
    from quernel.llm import resample

    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store all texts as ISO media files, read them back and walk their boxes."""
    from quernel.llm import isomedia

    return isomedia.digests(isomedia.store(table(spark, sf_dir, "documents")))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as WARC records, merge the archives' capture indexes, and read the records back by the merged index."""
    from quernel.llm import warc

    folder, manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(folder, warc.merge_index(spark, folder, manifest)).drop("urlkey", "captured")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Find all windows of 10 words of the benchmark in all documents."""
    from quernel.llm import decontam

    found = decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)
    listed = F.array_join(F.array_sort("items"), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents to the weights 5, 2, 1 of their sources."""
    from quernel.llm import mixing

    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label the words of all documents by a chain of languages learned from documents that are not held out."""
    from quernel.llm import langcrf

    docs = table(spark, sf_dir, "documents")
    return langcrf.identify(docs, langcrf.train(docs))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language differ in their terms, and the terms that mark each source."""
    from quernel.llm import divergence

    return divergence.divergence(table(spark, sf_dir, "documents"), least=10, top=10)


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Align the tokens of two public tokenizers over all texts, and count which ids stand for which."""
    import public_tokenizers

    from quernel.llm import alignment

    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules, then outliers of each language and source by robust Mahalanobis distances."""
    return outliers.outliers(table(spark, sf_dir, "documents")).drop("distance2")


QUERIES = {
    "op1_token_records": op1_token_records,
    "op2_line_dedup": op2_line_dedup,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_compaction": op4_compaction,
    "op5_importance_resampling": op5_importance_resampling,
    "op6_media_columns": op6_media_columns,
    "op7_warc": op7_warc,
    "op8_decontaminate": op8_decontaminate,
    "op9_mixing": op9_mixing,
    "op10_language_id": op10_language_id,
    "op11_source_divergence": op11_source_divergence,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_quality_rules": op13_quality_rules,
}

BLANKS = r"[\x20\x09-\x0D]"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINE_DEDUP_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
k AS (SELECT *, {LOWER.format(f"regexp_replace(regexp_replace(line, '^{BLANKS}+', ''), '{BLANKS}+$', '')")} AS key FROM l),
c AS (SELECT key, count(DISTINCT r) AS n, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5),
m AS (SELECT k.r, k.doc_id, k.line, k.i, c.key IS NOT NULL AND k.doc_id IS DISTINCT FROM c.keeper AS gone FROM k LEFT JOIN c USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""

DECONTAMINATE_SQL = r"""
WITH norm AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS r FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
         FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
places AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM norm, sizes WHERE len(w) >= n)),
hits AS (SELECT places.r, places.i, places.n, wins.item_id FROM places JOIN wins ON wins.win = places.win AND wins.n = places.n),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM norm LEFT JOIN words USING (r) LEFT JOIN named USING (r)
"""

MIXING_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '{BLANKS}+'), lambda x: x <> '')) AS BIGINT) AS size,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS unit FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
l AS (SELECT *, CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS left_over,
             CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest, row_number() OVER o AS place
      FROM w WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST)),
f AS (SELECT min(place) AS p0, arg_min(left_over, place) AS lo, arg_min(rest, place) AS re FROM l WHERE weight * left_over <= 3 * source_size * rest),
t AS (SELECT source, source_size, CASE WHEN p0 IS NULL OR place < p0 THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(weight * lo AS DOUBLE) / re END AS target FROM l, f),
b AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS copies FROM t),
r AS (SELECT d.doc_id, d.source, d.size, b.source_size, b.target, b.copies, CAST(floor(b.target) AS BIGINT) - b.copies * b.source_size AS budget,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.unit RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, size, source_size, target, CAST(size * least(copies + CASE WHEN upto <= budget THEN 1 ELSE 0 END, 3) AS BIGINT) AS taken FROM r
"""

NEAR_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '{BLANKS}+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS s FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.s = b.s AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= 85 * greatest(a.n, b.n)
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, c AS component_id, c = s.doc_id AS kept
FROM s JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) ON a = s.doc_id
"""

WARC_SQL = """
WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages),
o AS (SELECT h, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY h),
m AS (SELECT d.*, CASE WHEN o.first IS NOT NULL AND page_id IS DISTINCT FROM o.first THEN o.first END AS refers_to FROM d LEFT JOIN o USING (h))
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM m
"""

COMPACTION_SQL = """
SELECT doc_id, lang, source, n_chars, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % 16 AS arrival,
       CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, sha256(text) AS text_sha256 FROM documents
"""

DIVERGENCE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, {LOWER.format("coalesce(text, '')")} AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT x.*, 1 + 1000000000 * (x.n + 2) // (sum(x.n) OVER (PARTITION BY x.lang, x.source) + 2 * v.v) AS p, 1 + 1000000000 * (x.lang_n + 2) // (v.total + 2 * v.v) AS q FROM x JOIN v ON v.lang = x.lang),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
u AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
      FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source
      UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 10
"""

STATISTICS_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{BLANKS}+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
wins AS (SELECT r, i, array_to_string(w[i:i + 2], ' ') AS v FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, v) AS n FROM wins) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r)
SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
       CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
       CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines
FROM d JOIN l USING (r) LEFT JOIN covered USING (r)
"""

SQL = {
    "op13_quality_rules": outliers.oracle(STATISTICS_SQL),
    "op11_source_divergence": DIVERGENCE_SQL,
    "op3_near_duplicates": NEAR_SQL,
    "op2_line_dedup": LINE_DEDUP_SQL,
    "op4_compaction": COMPACTION_SQL,
    "op7_warc": WARC_SQL,
    "op8_decontaminate": DECONTAMINATE_SQL,
    "op9_mixing": MIXING_SQL,
}
