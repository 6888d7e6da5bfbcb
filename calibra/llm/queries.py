"""Registered queries of the operators: opN_<name>(spark, sf_dir) over whole tables.

Each reads a table, calls its operator and derives the digest columns.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.llm import (anchors, bpe_scan, content_sort, difference_cover, frequency_trie, latent_retrieval,
                         line_stream, mil_toxicity, mixing_coder, periodic_runs, ri_quality, tensored_minhash,
                         token_count)
from calibra.llm.learning import fold
from calibra.llm.shipping import ship
from calibra.session import scratch_path

RANK_FILE = "byte_bpe_50k.tiktoken"
BPE_FILE = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latent_retrieval.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.remove_repeats(_table(spark, sf_dir, "documents"), window=35).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(RANK_FILE)
    encoded = bpe_scan.encode(_table(spark, sf_dir, "documents"), path)
    return bpe_scan.decode(encoded, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, f"coded-ids-{uuid.uuid4().hex}")
    mixing_coder.write_coded(_table(spark, sf_dir, "documents"), path, public_tokenizers.path(BPE_FILE), end_id=0)
    return mixing_coder.read_sums(spark, path)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensored_minhash.near_duplicates(_table(spark, sf_dir, "documents"), k=3, percent=85)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return difference_cover.remove_later_copies(_table(spark, sf_dir, "documents"), window=100).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(_table(spark, sf_dir, "documents"),
                                    public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = ri_quality.train(docs, _table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 4) != 2)
    return ri_quality.quality(docs, model).select(
        "doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = mil_toxicity.train(docs, _table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    return mil_toxicity.toxicity(docs, model).select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted",
        F.size("offending").alias("n_offending"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.exact_dedup(_table(spark, sf_dir, "documents"))


def drop_letter(doc_id: Column, run: Column) -> Column:
    """A run that loses its code point h mod length where 199 divides h, the crc32 of
    `<doc_id>:<run>` (a null id counts as empty)."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % 199 == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency_trie.variants(frequency_trie.word_counts(
        _table(spark, sf_dir, "documents"), least_chars=6, least_count=5, rewrite=drop_letter), ratio=5)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return line_stream.apply_bitmaps(docs, line_stream.keep_bitmaps(docs, least_chars=20, least_docs=3)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def repeat_tail(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents (crc32 of the id mod 10 is 0) repeat the
    words from place a on with period p; a null id and a wordless text stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = (h % 10 == 0) & (F.size(words) > 0)
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(chosen, words).alias("w"))
    rows = rows.select("doc_id", "text", "w", "g", F.size("w").cast("long").alias("n"))
    rows = rows.select("doc_id", "text", "w", "g", "n", (F.col("g") % F.col("n")).alias("a"))
    rows = rows.select("doc_id", "text", "w", "a", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).alias("p"))
    tail = F.transform("w", lambda word, i: F.when(i < F.col("a"), word).otherwise(
        F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return rows.select("doc_id", F.when(F.col("w").isNotNull(), F.concat_ws(" ", tail)).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    line = lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    listed = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.col("n_runs") > 0, "\n").otherwise(""))
    return found.select("doc_id", "n_runs", "start", "length", "period",
                        F.floor(1000 * F.col("length") / F.col("period")).alias("exponent_milli"),
                        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
                        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = repeat_tail(_table(spark, sf_dir, "documents"))
    return run_digests(periodic_runs.periodic_runs(docs, least=6, periods=4))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_bpe": op3_bpe,
    "op4_token_files": op4_token_files,
    "op5_near_dedup": op5_near_dedup,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_token_count": op7_token_count,
    "op8_quality": op8_quality,
    "op9_toxicity": op9_toxicity,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_line_dedup": op12_line_dedup,
    "op13_periodic_runs": op13_periodic_runs,
}

#: Steps of a list that hold the bits of an ASCII or UTF-8 text, least significant first, and
#: the bitwise CRC-32 over them (DuckDB has no such function).
_CRC32 = """xor(list_reduce(list_transform(flatten(list_transform(range(0, octet_length(encode({0}))),
    lambda i: list_transform(range(0, 8), lambda b: (('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::INT >> b::INT) & 1))), lambda v: v::BIGINT),
    lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295::BIGINT), 4294967295)"""

ORACLE = {
    "op2_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
place AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
win AS (SELECT p.doc_id, p.i, array_to_string(list_slice(d.w, p.i, p.i + 34), ' ') AS s FROM place p JOIN d USING (doc_id)),
rep AS (SELECT doc_id, i FROM win WHERE s IN (SELECT s FROM win GROUP BY s HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM rep),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT w.doc_id, count(g.p) AS n_removed,
                string_agg(w.x, ' ' ORDER BY w.p) FILTER (WHERE g.p IS NULL) AS t
         FROM word w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.p = g.p GROUP BY w.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id""",
    "op5_near_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x20\x09-\x0D]+') AS w FROM documents),
texts AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS s FROM texts
       UNION SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 2),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT u, v FROM common JOIN n nu ON nu.doc_id = u JOIN n nv ON nv.doc_id = v WHERE 100 * c >= 85 * (nu.n + nv.n - c)),
edge AS (SELECT u, v FROM link UNION SELECT v, u FROM link),
reach(a, b) AS (SELECT u, v FROM edge UNION SELECT r.a, e.v FROM reach r JOIN edge e ON r.b = e.u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id,
       d.doc_id <= coalesce(m.b, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) m ON m.a = d.doc_id""",
    "op6_suffix_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
byte AS (SELECT doc_id, h, len(h) // 2 AS n, unnest(range(0, len(h) // 2)) AS p FROM d),
starts AS (SELECT doc_id, n, p, substr(h, 2 * p + 1, 2) AS b,
                  CASE WHEN p + 100 <= n THEN substr(h, 2 * p + 1, 200) END AS s FROM byte),
ranked AS (SELECT doc_id, n, p, b, s IS NOT NULL AND row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1 AS later FROM starts),
cover AS (SELECT doc_id, n, p, b, max(later) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone
          FROM ranked),
edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM cover),
done AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS r, count(*) FILTER (WHERE opens) AS k,
                string_agg(b, '' ORDER BY p) FILTER (WHERE NOT gone) AS t FROM edges GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_bytes, coalesce(r, 0) AS n_removed, coalesce(k, 0) AS n_spans,
       sha256(unhex(coalesce(t, ''))) AS kept_sha256
FROM d LEFT JOIN done USING (doc_id)""",
    "op10_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n""",
    "op11_spelling_variants": r"""
WITH RECURSIVE d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                    '[A-Za-z\x{00C0}-\x{00FF}]+')) AS r FROM documents),
runs AS (SELECT doc_id, r, count(*) AS k FROM d GROUP BY ALL),
hashed AS (SELECT r, k, """ + _CRC32.format("(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r)") + r""" AS h FROM runs),
words AS (SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, CAST(h % length(r) AS INT)) || substr(r, CAST(h % length(r) AS INT) + 2) ELSE r END AS word, k
          FROM hashed),
voc AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM words WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b
        FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM voc)),
near AS (SELECT DISTINCT x.word, y.word AS other, y.n AS other_n FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
         UNION SELECT x.word, y.word, y.n FROM cut x JOIN voc y ON x.a || x.b = y.word
         UNION SELECT y.word, x.word, x.n FROM cut x JOIN voc y ON x.a || x.b = y.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
tab AS (SELECT v.word, CASE WHEN b.other_n >= 5 * v.n THEN b.other END AS form, v.n, coalesce(b.n_near, 0) AS n_near,
               CASE WHEN b.other_n >= 5 * v.n THEN b.other_n END AS form_n FROM voc v LEFT JOIN best b USING (word)),
walk(word, here, form) AS (SELECT word, word, form FROM tab
                         UNION ALL SELECT w.word, t.word, t.form FROM walk w JOIN tab t ON w.form = t.word)
SELECT t.word, t.form, w.here AS root, t.n, t.n_near, t.form_n FROM tab t JOIN walk w ON w.word = t.word AND w.form IS NULL""",
    "op12_line_dedup": r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
line AS (SELECT doc_id, unnest(l) AS x, unnest(range(0, len(l))) AS p FROM d),
keyed AS (SELECT *, translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
          FROM line),
often AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT y.*, o.k IS NOT NULL AND y.doc_id <> o.last AS gone FROM keyed y LEFT JOIN often o ON y.k = o.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(x, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op13_periodic_runs": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  """ + _CRC32.format("CAST(doc_id AS VARCHAR)") + r""" AS h FROM documents),
e AS (SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n, h % 10 = 0 AND len(w) > 0 AS chosen, h // 10 AS g FROM d),
f AS (SELECT doc_id, w, n, chosen, CASE WHEN chosen THEN g % n END AS a, CASE WHEN chosen THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM e),
word AS (SELECT doc_id, n, i, CASE WHEN chosen AND i >= a THEN w[CAST(a + (i - a) % p + 1 AS BIGINT)] ELSE w[i + 1] END AS x
         FROM (SELECT *, unnest(range(0, n)) AS i FROM f)),
eq AS (SELECT u.doc_id, v.i - u.i AS q, u.i FROM word u JOIN word v ON u.doc_id = v.doc_id AND u.x = v.x AND v.i > u.i AND 4 * (v.i - u.i) <= u.n),
isle AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS z FROM eq),
stretch AS (SELECT doc_id, min(i) AS s, count(*) + q AS l, q FROM isle GROUP BY doc_id, q, z HAVING count(*) + q >= greatest(6, 4 * q)),
run AS (SELECT doc_id, s, l, min(q) AS q FROM stretch GROUP BY doc_id, s, l),
lost AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM run),
kept AS (SELECT w.doc_id, string_agg(w.x, ' ' ORDER BY w.i) AS t FROM word w ANTI JOIN lost g ON w.doc_id = g.doc_id AND w.i = g.i GROUP BY w.doc_id),
sums AS (SELECT doc_id, count(*) AS k, first(struct_pack(s, l, q) ORDER BY l DESC, s, q) AS b,
                string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM run GROUP BY doc_id)
SELECT d.doc_id, coalesce(r.k, 0) AS n_runs, r.b.s AS start, r.b.l AS length, r.b.q AS period, 1000 * r.b.l // r.b.q AS exponent_milli,
       sha256(coalesce(r.t, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM d LEFT JOIN sums r USING (doc_id) LEFT JOIN kept k USING (doc_id)""",
}
