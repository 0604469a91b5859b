"""The thin queries over the operators of this subpackage, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, fim, jaccard, langid, lines, lmscore, periodic, quality, setsketch, sharding, substrings, warc
from .storage import new_path


#: Words of a passage whose later copies line dedup deletes, be it on one line; as many as op2 looks for.
PASSAGE = 35


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(_docs(spark, sf_dir))
    return out.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.dedup_substrings(_docs(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    listed = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), listed.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return quality.apply_cascade(docs, quality.plan_cascade(docs)).drop("failed_rule")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")
    out = lmscore.score_documents(_docs(spark, sf_dir), good)
    return out.select("doc_id", "n_tokens", *(F.round(c, 9).alias(c) for c in ("loss_target", "loss_background", "score")))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_path(spark, "warc"))
    out = warc.read_archives(files, with_payload=False)
    number = lambda c: F.col(c).cast("bigint").alias("page_id" if c == "record_id" else c)
    return out.select(number("record_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later copies of runs of three lines, and of one or two that hold PASSAGE words, go."""
    out = lines.dedup_lines(_docs(spark, sf_dir), words=PASSAGE)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("cut").cast("binary"), 256).alias("kept_sha256"))


def op7_single_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7_line_dedup with a guarantee of one line: every later copy of a filled line goes."""
    out = lines.dedup_lines(_docs(spark, sf_dir), guarantee=1, k=1)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("cut").cast("binary"), 256).alias("kept_sha256"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = langid.fit(docs.filter(~held_out))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_docs(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = bpe.round_trip(_docs(spark, sf_dir), path, public_tokenizers.PATTERN)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256)
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(_docs(spark, sf_dir), k=2)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; in every tenth document by its hash, the words from some place on repeat those from there. A null id has no hash."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    g, n = F.expr("h div 10"), F.col("n")
    rows = docs.select("doc_id", "text", h.alias("h"), words.alias("w")).withColumn("n", F.size("w"))
    rows = rows.withColumn("a", F.when(n > 0, g % n).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    rest = F.slice(F.flatten(F.array_repeat(F.expr("slice(w, a + 1, p)"), F.ceil((n - F.col("a")) / F.col("p")).cast("int"))), F.lit(1), n - F.col("a"))
    text = F.when(n > 0, F.array_join(F.concat(F.expr("slice(w, 1, a)"), rest), " ")).otherwise(F.col("text"))
    return rows.select("doc_id", text.alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic.periodic_runs(planted(_docs(spark, sf_dir)))
    top = F.array_min(F.transform("runs", lambda r: F.struct((-r.length / r.period).alias("x"), r.start.alias("start"), r.period.alias("period"), r.length.alias("length"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(F.lit(""))
    told = out.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), top.alias("top"), listed.alias("listed"), "collapsed")
    return told.select(
        "doc_id",
        "n_runs",
        *(F.col(f"top.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("(1000 * top.length) div top.period").alias("exponent_milli"),
        F.sha2(F.col("listed").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.restore(fim.fill_in_middle(_docs(spark, sf_dir)))
    hashed = (F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashed)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it uses the operators of this subpackage, so it comes when they are there

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (pipeline, op1_sharding, op2_substring_dedup, op3_decontamination, op4_quality_rules, op5_lm_scoring, op6_warc, op7_line_dedup, op7_single_lines, op8_language_id, op9_ngram_jaccard, op10_byte_bpe, op11_minhash_near_dedup, op12_periodic_runs, op13_fill_in_middle)}


_W = r"'[^\x20\x09-\x0D]+'"

ORACLE: dict[str, str] = {
    "op2_substring_dedup": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), {_W}) AS w FROM documents),
g AS (SELECT rid, i, sha256(array_to_string(w[i:i+34], ' ')) AS s FROM d, unnest(range(1, greatest(1, len(w) - 33))) AS t(i)),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY s) AS c FROM g),
h AS (SELECT DISTINCT rid, i + j AS p FROM r, range(35) AS t(j) WHERE c > 1),
u AS (SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT rid, string_agg(x, ' ' ORDER BY p) AS kept, count(*) AS n FROM u ANTI JOIN h USING (rid, p) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)""",
    "op3_decontamination": r"""
WITH x AS (SELECT *, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT row_number() OVER () AS rid, doc_id, NULL AS item_id, text FROM documents UNION ALL SELECT NULL, NULL, item_id, text FROM benchmark)),
n AS (SELECT item_id, least(len(w), 10) AS n, i FROM x, unnest(range(1, greatest(2, len(w) - 8))) AS t(i) WHERE rid IS NULL AND len(w) > 0),
b AS (SELECT DISTINCT n.item_id, n.n, array_to_string(w[i:i+n.n-1], ' ') AS s FROM n JOIN x ON x.item_id = n.item_id AND x.rid IS NULL),
g AS (SELECT rid, n, i, array_to_string(w[i:i+n-1], ' ') AS s FROM x, (SELECT DISTINCT n FROM b), unnest(range(1, greatest(1, len(w) - n + 2))) AS t(i) WHERE rid IS NOT NULL),
m AS (SELECT rid, g.n, i, item_id FROM g JOIN b USING (n, s)),
h AS (SELECT rid, count(DISTINCT i + j) AS n_hit FROM m, range(10) AS t(j) WHERE j < n GROUP BY rid),
k AS (SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l FROM (SELECT DISTINCT rid, item_id::VARCHAR AS i FROM m) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM x LEFT JOIN h USING (rid) LEFT JOIN k USING (rid) WHERE rid IS NOT NULL""",
    "op6_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to FROM t""",
    "op9_ngram_jaccard": r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(w[i:i+3], ' ') AS g FROM d, unnest(range(1, greatest(2, len(w) - 2))) AS t(i) WHERE len(w) > 0),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT rid, rid AS other FROM d UNION SELECT r.rid, e.b FROM r JOIN e ON e.a = r.other)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM d LEFT JOIN n USING (rid) JOIN r ON r.rid = d.rid JOIN d o ON o.rid = r.other GROUP BY d.rid, d.doc_id""",
    "op7_line_dedup": r"""
WITH d AS (SELECT doc_id, text, sha256(coalesce(doc_id::VARCHAR, '') || chr(1) || text) AS rid FROM documents),
l AS (SELECT rid, doc_id, i, x, regexp_matches(x, '[^\x20\x09-\x0D]') AS f FROM (SELECT DISTINCT rid, doc_id, text FROM d WHERE text IS NOT NULL),
        unnest(string_split(text, chr(10))) WITH ORDINALITY AS t(x, i)),
n AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY i) AS p, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS m FROM l WHERE f),
v AS (SELECT rid, doc_id, p, x, m, lead(x) OVER o AS x2, lead(x, 2) OVER o AS x3, m + lead(m) OVER o AS m2 FROM n WINDOW o AS (PARTITION BY rid ORDER BY p)),
w AS (SELECT rid, doc_id, p, 3 AS k, x || chr(10) || x2 || chr(10) || x3 AS s FROM v
  UNION ALL SELECT rid, doc_id, p, 1, x FROM v WHERE m >= 35
  UNION ALL SELECT rid, doc_id, p, 2, x || chr(10) || x2 FROM v WHERE m2 >= 35),
r AS (SELECT rid, p, k, row_number() OVER (PARTITION BY k, s ORDER BY doc_id NULLS FIRST, p) AS c FROM w WHERE s IS NOT NULL),
h AS (SELECT DISTINCT rid, p + j AS p FROM r, range(3) AS t(j) WHERE c > 1 AND j < k),
a AS (SELECT l.rid, l.i, l.x, l.f, h.p IS NOT NULL AS g FROM l LEFT JOIN n ON n.rid = l.rid AND n.i = l.i LEFT JOIN h ON h.rid = l.rid AND h.p = n.p),
k AS (SELECT rid, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT g), '') AS kept, count(*) FILTER (f) AS n, count(*) FILTER (g) AS m FROM a GROUP BY rid)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(m, 0)::BIGINT AS n_removed, sha256(kept) AS kept_sha256 FROM d LEFT JOIN k USING (rid)""",
    "op7_single_lines": r"""
WITH d AS (SELECT doc_id, text, sha256(coalesce(doc_id::VARCHAR, '') || chr(1) || text) AS rid FROM documents),
l AS (SELECT rid, doc_id, i, x, regexp_matches(x, '[^\x20\x09-\x0D]') AS f FROM (SELECT DISTINCT rid, doc_id, text FROM d WHERE text IS NOT NULL),
        unnest(string_split(text, chr(10))) WITH ORDINALITY AS t(x, i)),
a AS (SELECT *, f AND row_number() OVER (PARTITION BY f, x ORDER BY doc_id NULLS FIRST, i) > 1 AS g FROM l),
k AS (SELECT rid, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT g), '') AS kept, count(*) FILTER (f) AS n, count(*) FILTER (g) AS m FROM a GROUP BY rid)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(m, 0)::BIGINT AS n_removed, sha256(kept) AS kept_sha256 FROM d LEFT JOIN k USING (rid)""",
    "op4_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_W}) AS w FROM documents),
b AS (SELECT doc_id, text, w, len(w) AS n,
        coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS wc,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS sy,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
        length(regexp_replace(text, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS le,
        len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i-1])) AS st FROM d),
g AS (SELECT doc_id, text, i, array_to_string(w[i:i+7], ' ') AS s FROM b, unnest(range(1, greatest(1, n - 6))) AS t(i)),
r AS (SELECT doc_id, text, i, count(*) OVER (PARTITION BY doc_id, text, s) AS c FROM g),
h AS (SELECT doc_id, text, count(DISTINCT i + j) AS rep FROM r, range(8) AS t(j) WHERE c > 1 GROUP BY ALL),
m AS (SELECT b.*, coalesce(rep, 0) AS rep, len(ls) - len(list_distinct(ls)) AS dl FROM b LEFT JOIN h USING (doc_id, text)),
k AS (SELECT *, n < 20 OR 100 * rep > 30 * n AS bf FROM m)
SELECT doc_id, n::BIGINT AS n_words, wc::BIGINT AS word_chars, sy::BIGINT AS n_symbols, dl::BIGINT AS n_dup_lines,
  rep::BIGINT AS n_repeat_words, bf AS base_failed,
  NOT (bf OR 5 * sy > n OR (2 * dl > len(ls) AND dl >= 4) OR 2 * st > n OR wc < 2 * n OR wc > 20 * n OR 2 * up > le) AS kept FROM k""",
    "op11_minhash_near_dedup": r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(w[i:i+1], ' ') AS g FROM d, unnest(range(1, greatest(2, len(w)))) AS t(i) WHERE len(w) > 0),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT rid, rid AS other FROM d UNION SELECT r.rid, e.b FROM r JOIN e ON e.a = r.other)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id, d.doc_id IS NOT DISTINCT FROM min(o.doc_id) AS kept
FROM d LEFT JOIN n USING (rid) JOIN r ON r.rid = d.rid JOIN d o ON o.rid = r.other GROUP BY d.rid, d.doc_id""",
    "op12_periodic_runs": rf"""
WITH c AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), {_W}) AS w,
    xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [256 + ascii(x), 0, 0, 0, 0, 0, 0, 0, 0]))),
      lambda v, s: CASE WHEN s >= 256 THEN xor(v, (s - 256)::BIGINT) ELSE xor(v >> 1, 3988292384 * (v & 1)) END), 4294967295::BIGINT) AS h FROM documents),
d AS (SELECT rid, doc_id, w, len(w) AS n, h, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM c),
e AS (SELECT rid, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END AS w FROM d),
s AS (SELECT rid, n, i, array_to_string(w[i+1:i+16], ' ') AS x FROM e, unnest(range(greatest(n - 15, 0))) AS t(i)),
m AS (SELECT s.rid, s.n, s.i, z.i - s.i AS q FROM s JOIN s z ON s.rid = z.rid AND s.x = z.x AND s.i < z.i WHERE 3 * (z.i - s.i) <= s.n),
l AS (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS k FROM m),
f AS (SELECT rid, q, min(i) AS b, count(*) + 15 + q AS len FROM l GROUP BY rid, q, k HAVING count(*) + 15 + q >= greatest(24, 3 * q)),
r AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM f y WHERE y.rid = f.rid AND y.q < f.q AND y.b <= f.b AND f.b + f.len <= y.b + y.len)),
t AS (SELECT rid, count(*) AS n_runs, arg_min(struct_pack(s := b, l := len, p := q), (-(len / q), b, q)) AS top, string_agg(b || ',' || len || ',' || q || chr(10), '' ORDER BY b, q) AS listed FROM r GROUP BY rid),
g AS (SELECT DISTINCT rid, unnest(range(b + q, b + len)) AS i FROM r),
u AS (SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM e),
k AS (SELECT rid, string_agg(x, ' ' ORDER BY i) AS kept FROM u ANTI JOIN g USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, top.s::BIGINT AS start, top.l::BIGINT AS length, top.p::BIGINT AS period, (1000 * top.l // top.p)::BIGINT AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM e LEFT JOIN t USING (rid) LEFT JOIN k USING (rid)""",
    "op13_fill_in_middle": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (SELECT *, ('0x' || s[1:8])::BIGINT % (n + 1) AS c1, ('0x' || s[9:16])::BIGINT % (n + 1) AS c2, ('0x' || s[17:24])::BIGINT % 100 AS r, ('0x' || s[25:32])::BIGINT % 100 AS q FROM d),
f AS (SELECT *, least(c1, c2) AS lo, greatest(c1, c2) AS hi,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r >= 90 THEN 'plain' WHEN q < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(text, 1, lo) AS a, substring(text, lo + 1, hi - lo) AS m, substring(text, hi + 1) AS z FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN lo END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || a || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
