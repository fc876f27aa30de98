"""The operators' queries over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archlens.llm import bpe, decontaminate, language, license_scan, line_dedup, ogg, periodic_runs, quality, simhash, spelling, substring_dedup, token_counts, toxicity

#: Files of public tokenizers.
BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), PIECES)


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(table(spark, folder, "documents"), BPE)


def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = license_scan.scan(table(spark, folder, "documents"))
    return found.select("doc_id", "n_windows", F.array_join("licenses", ",").alias("licenses"))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels").filter(~held_out))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(table(spark, folder, "documents"), table(spark, folder, "labels"), F.col("source"), F.col("lang"))
    return judged.select("doc_id", "quality_evidence", "quality_host", "quality_path", "quality_score", (F.col("quality_score") >= 0.5).alias("kept"))


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", F.col("n_hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontaminate.is_contaminated().alias("contaminated"))


def op9_ogg(spark: SparkSession, folder: str) -> DataFrame:
    stored = ogg.store_texts(table(spark, folder, "documents"))
    shape = F.format_string("ogg;pages=%d;packets=%d;seconds=%.6f;mean=%.6f;rms=%.6f;crossings=%d", "n_pages", "n_packets", "duration_s", "mean", "rms", "crossings")
    return stored.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), shape.alias("feature"),
    )


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _doc_hash() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


def with_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text; the words of every tenth document by hash become periodic from some word on."""
    h = _doc_hash()
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")
    chosen = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w")).withColumn("n", F.size("w"))
    chosen = chosen.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    moved = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return chosen.select("doc_id", F.when(F.col("n") > 0, F.array_join(moved, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs.find_runs(with_periods(table(spark, folder, "documents")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    power = F.expr("best.length * 1000 div best.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", power.alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


def op12_language_id(spark: SparkSession, folder: str) -> DataFrame:
    held_out = _doc_hash() % 4 == 2
    docs = table(spark, folder, "documents")
    found = language.identify(docs, language.fit(docs.filter(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def misspelt(doc_id: int | None, word: bytes) -> bytes:
    """A document's word, one in 97 of them without one of its characters."""
    h = zlib.crc32(b"%s:%s" % (str(doc_id).encode(), word))
    if h % 97:
        return word
    letters = word.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, folder, "documents"), misspelt))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_token_counts, op3_line_dedup, op4_bpe, op5_license_scan, op6_toxicity, op7_quality, op8_decontamination, op9_ogg, op10_simhash, op11_periodic_runs, op12_language_id, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL; the other operators are tested against brute force, a library, round trips or held-out accuracy."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    templates = ", ".join(f"({k}, {quote(name)}, {quote(text)})" for k, (name, text) in enumerate(license_scan.TEMPLATES))
    return {"op1_substring_dedup": OP1, "op3_line_dedup": OP3, "op5_license_scan": OP5.replace("{templates}", templates), "op8_decontamination": OP8} | {
        name: sql.replace("{crc_table}", CRC_TABLE).replace("{crc}", CRC.replace("{x}", text)) for name, sql, text in (("op11_periodic_runs", OP11, "CAST(doc_id AS VARCHAR)"), ("op13_spelling_variants", OP13, "x"))
    }


OP1 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS s, w FROM d WHERE len(w) >= 13),
k AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 12], ' ')) AS h FROM g),
m AS (SELECT h, min(doc_id) AS low FROM k GROUP BY h),
c AS (SELECT k.doc_id, unnest(range(s, s + 13)) AS p FROM k JOIN m USING (h) WHERE low < k.doc_id),
r AS (SELECT doc_id, list(DISTINCT p) AS gone FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(coalesce(gone, []), i)), lambda i: w[i]), ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""

OP3 = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents WHERE text IS NOT NULL),
s AS (SELECT *, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM l),
k AS (SELECT doc_id, n, line, w, array_to_string(w, ' ') AS t FROM s),
f AS (SELECT t, min({'d': doc_id, 'n': n}) AS spot, any_value(w) AS w FROM k WHERE t <> '' GROUP BY t),
v AS (SELECT t, spot, 0 AS place, md5(t) AS key FROM f UNION ALL
  SELECT t, spot, p, md5(array_to_string(w[:p - 1] || w[p + 1:], ' ')) FROM (SELECT t, spot, w, unnest(range(1, len(w) + 1)) AS p FROM f WHERE len(w) >= 5)),
near AS (SELECT DISTINCT b.t FROM v a JOIN v b ON a.key = b.key AND (a.place = b.place OR a.place = 0 OR b.place = 0) AND a.spot < b.spot),
j AS (SELECT k.doc_id, k.n, k.line, k.t <> '' AND (f.spot <> {'d': k.doc_id, 'n': k.n} OR near.t IS NOT NULL) AS gone FROM k LEFT JOIN f ON k.t = f.t LEFT JOIN near ON k.t = near.t),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '') AS kept FROM j GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(kept) AS kept_sha256
FROM (SELECT doc_id FROM documents) LEFT JOIN g USING (doc_id)
"""

#: Exact containment in every window, without bands; places and scores as in `license_scan`.
OP5 = r"""
WITH t AS (SELECT id, name, list_filter(regexp_split_to_array(lower(text), '[^0-9a-z]+'), lambda x: x <> '') AS w FROM (VALUES {templates}) v(id, name, text)),
ts AS (SELECT id, name, len(w) - 4 AS long, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM t WHERE len(w) >= 5),
c AS (SELECT id, name, s, len(s) AS n, CAST(ceil(pow(2.0, ceil(2 * log2(long)) / 2)) AS BIGINT) AS cap FROM ts),
z AS (SELECT *, greatest(1, cap // 4) AS stride, cap + greatest(1, cap // 4) - 1 AS size FROM c),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
h AS (SELECT doc_id, pos, s, id FROM p JOIN (SELECT id, unnest(s) AS s FROM z) USING (s)),
x AS (SELECT doc_id, pos, h.s, id, name, n, cap, stride * unnest(range(greatest(0, CAST(floor((pos - size) / stride) AS BIGINT) + 1), pos // stride + 1)) AS low FROM h JOIN z USING (id)),
held AS (SELECT doc_id, id, name, n, cap, low, list(pos) AS spots FROM x GROUP BY ALL HAVING count(DISTINCT s) >= CAST(0.8 AS DOUBLE) * n),
pl AS (SELECT *, list_max(list_transform(spots, lambda a: {'n': len(list_filter(spots, lambda q: q >= a AND q < a + n)), 'low': -a})) AS best FROM held),
e AS (SELECT doc_id, id, name, cap, low, 2 * best.n - n AS score, unnest(list_filter(spots, lambda q: q >= -best.low AND q < n - best.low)) AS pos FROM pl),
r AS (SELECT *, max({'score': score, 'name': name}) OVER (PARTITION BY doc_id, pos) AS top FROM e),
b AS (SELECT doc_id, id, name, cap, low, 2 * count(*) FILTER (top.score > score AND top.name <> name) <= count(*) AS best FROM r GROUP BY ALL),
m AS (SELECT doc_id, count(DISTINCT {'c': cap, 'l': low}) AS n_windows, string_agg(DISTINCT name, ',' ORDER BY name) FILTER (best) AS licenses FROM b GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_windows, 0) AS BIGINT) AS n_windows, coalesce(licenses, '') AS licenses FROM documents LEFT JOIN m USING (doc_id)
"""

OP8 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
i AS (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS t FROM i),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS s, w FROM d, ns WHERE len(w) >= n),
h AS (SELECT doc_id, s, iw.n, item_id FROM (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS t FROM dw) q JOIN iw ON q.n = iw.n AND q.t = iw.t),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY doc_id),
a AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN a USING (doc_id)
"""

#: CRC-32 of a text's UTF-8 bytes, byte by byte: {crc(x)} in the SQL below; `crc_table` has the remainder of each byte.
CRC_TABLE = "SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), b)) AS t"
CRC = "xor(list_reduce(list_transform(range(strlen({x})), lambda k: CAST('0x' || substr(hex({x}), 2 * k + 1, 2) AS BIGINT)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295), 4294967295)"

#: Equal triples of words q apart, gathered to stretches; a stretch of several periods is that of the smallest.
OP11 = r"""
WITH crc_table AS ({crc_table}),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, {crc} AS h FROM documents, crc_table),
e AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN h // 10 % len(w) END AS a, h // 10 % 8 AS g FROM d),
m AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g)) END]) END AS w FROM e),
g AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + 3], ' ') AS t FROM (SELECT doc_id, n, w, unnest(range(n - 2)) AS i FROM m WHERE n >= 6)),
q AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.doc_id = y.doc_id AND x.t = y.t AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM q),
l AS (SELECT doc_id, q, min(i) AS start, count(*) + 2 + q AS length FROM s GROUP BY doc_id, q, island HAVING count(*) + 2 + q >= greatest(6, 4 * q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM l GROUP BY doc_id, start, length),
b AS (SELECT doc_id, count(*) AS n_runs, max({'length': length, 'start': -start, 'period': -period}) AS best,
  string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT doc_id, unnest(w) AS word, unnest(range(n)) AS i FROM m) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(-best.start AS BIGINT) AS start, CAST(best.length AS BIGINT) AS length, CAST(-best.period AS BIGINT) AS period,
  CAST(1000 * best.length // -best.period AS BIGINT) AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM documents LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)
"""

#: Near words: equal without the character at the same place, or equal to the longer word without one.
OP13 = r"""
WITH RECURSIVE crc_table AS ({crc_table}),
o AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
c AS (SELECT doc_id, run, count(*) AS n, doc_id || ':' || run AS x FROM o GROUP BY doc_id, run),
h AS (SELECT run, n, {crc} AS h FROM c, crc_table),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
z AS (SELECT word, p, substr(word, 1, p) || substr(word, p + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS p FROM v)),
x AS (SELECT a.word, b.word AS near FROM z a JOIN z b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word UNION SELECT z.word, v.word FROM z JOIN v ON z.rest = v.word UNION SELECT v.word, z.word FROM z JOIN v ON z.rest = v.word),
y AS (SELECT x.word, count(*) AS n_near, min({'off': -v.n, 'near': near}) AS best FROM x JOIN v ON x.near = v.word GROUP BY x.word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.off >= 2 * n THEN best.near END AS form, CASE WHEN -best.off >= 2 * n THEN -best.off END AS form_n FROM v LEFT JOIN y USING (word)),
r AS (SELECT word, form AS root FROM f WHERE form IS NOT NULL UNION ALL SELECT r.word, f.form FROM r JOIN f ON r.root = f.word WHERE f.form IS NOT NULL),
e AS (SELECT r.word, r.root FROM r JOIN f ON r.root = f.word WHERE f.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM f LEFT JOIN e USING (word)
"""
