"""Text queries: parsers, tokens, grounding, lines, pair checks, statutes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlake.functions import labels, text
from pactlake.operators import entities, geometry, grounding, records, vocabulary
from pactlake.plans.clauses import table
from pactlake.session import ensure_checkpoint_dir


def date_parse(spark, sf_dir):
    """Order dates written in five ways, one of them impossible, and read again."""
    d, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 5
    said = (F.when(k == 0, F.date_format(d, "yyyy/M/d")).when(k == 1, F.concat(F.lit("dated "), F.date_format(d, "MMMM d"), F.lit("th, "), F.date_format(d, "yyyy"), F.lit("."))).when(k == 2, F.concat(F.lit("this "), F.date_format(d, "d"), F.lit("rd day of "), F.date_format(d, "MMM., yyyy")))
            .when(k == 3, F.date_format(d, "M/d/yyyy")).otherwise(F.lit("on 2024-02-30 or March 1, 2024")))
    t = table(spark, sf_dir, "orders").select("o_orderkey", said.alias("t"))
    return t.select("o_orderkey", text.parse_date(F.col("t")).alias("field_date"), text.parse_date(F.col("t"), extended=False).alias("conflict_date"))


def duration_parse(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q")).distinct()
    k = F.col("q") % 4
    t = F.when(k == 0, F.format_string("thirty-odd (%d) days' notice", "q")).when(k == 1, F.format_string("a period of %d Weeks", "q")).when(k == 2, F.format_string("%d months from signature", "q")).otherwise(F.lit("Twelve years"))
    return li.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("line"), "q", text.duration_days(t).alias("days"), text.duration_months(t).alias("months"))


def number_parse(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", text.to_number(F.concat(F.lit("USD -1,0"), F.col("props"))).alias("signed"), text.to_number(F.col("props")).alias("value"))


def json_norm(spark, sf_dir):
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    return table(spark, sf_dir, "events").groupBy(F.get_json_object(text.json_object(fenced), "$.k").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def normalize_entity(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    raw = F.concat(F.lit('The "'), F.col("p_name"), F.lit('" Holdings & Co., Ltd. (Buyer)'))
    return p.select("p_partkey", text.normalize_entity(raw).alias("name"), text.normalize_invoice_party(raw).alias("invoice_name"))


def entity_pairs(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(text.normalize_entity(F.col("p_name")).alias("name")).filter("name <> ''")
    both = names.unionByName(names.select(F.element_at(F.split("name", " "), 1).alias("name"))).distinct()
    return entities.name_pairs(both)


def clean_tokens(spark, sf_dir):
    """How often each cleaned word occurs in all documents."""
    w = table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"[ \t\n\x0B\f\r]+")).alias("w"))
    return w.select(text.clean_token(F.col("w")).alias("token")).filter("token <> ''").groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def evidence_mass(spark, sf_dir):
    """The weight of all distinct words of each document, taken as a page."""
    w = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda x: x != "")).alias("w")).select("doc_id", text.clean_token(F.col("w")).alias("token"))
    c = w.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("c"))
    n = c.groupBy("doc_id").agg(F.sum("c").alias("n"))
    return c.join(n, "doc_id").groupBy("doc_id").agg(F.first("n").alias("n_words"), F.count(F.lit(1)).alias("n_distinct"), F.round(F.sum(grounding.token_weight(F.col("n").cast("double"), F.col("c"))), 6).alias("mass"))


def _split(c: str) -> Column:
    return F.filter(F.split(c, r"[ \t\n\x0B\f\r]+"), lambda x: x != "")


def _threes(words: Column, first: int, less: int) -> Column:
    """The distinct runs of three words from the word `first` on, up to the one `less` before the end."""
    n = F.size(words) - less
    run = F.transform(F.sequence(F.lit(first), n - 3), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.array_distinct(F.when(n - 3 >= first, run).otherwise(F.array().cast("array<string>")))


def _candidates(spark, sf_dir, edge: int) -> DataFrame:
    """Items and the documents that have three words of theirs in succession, `edge` words at either end left out.

    The items' runs are few and are broadcast if they are small enough, so that documents' runs needn't be shuffled.
    """
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("phrase"), _split("text").alias("w"))
    keys = items.select("item_id", F.explode(_threes(F.col("w"), edge, edge)).alias("g"))
    docs = table(spark, sf_dir, "documents").select("doc_id", _split("text").alias("w"))
    met = docs.select("doc_id", F.explode(_threes(F.col("w"), 0, 0)).alias("g")).join(keys, "g").select("item_id", "doc_id").distinct()
    return met.join(items.select("item_id", "phrase"), "item_id")


def grounding_exact(spark, sf_dir):
    """Items that stand in documents, within words too. The inner words of an item of five or more stand there as they are; shorter items are held against every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    place = F.instr(F.col("text"), F.col("phrase")).cast("bigint").alias("place")
    long = _candidates(spark, sf_dir, 1).join(docs, "doc_id").filter(F.contains("text", "phrase")).select("item_id", "doc_id", place)
    few = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("phrase")).filter(F.size(_split("phrase")) < 5)
    short = docs.join(few, F.contains("text", "phrase")).select("item_id", "doc_id", place)
    return long.unionByName(short)


def _pages(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("page_key"), _split("text").alias("words"))


def _found(out: DataFrame) -> DataFrame:
    rounded = (F.round(c, 6).alias(c) for c in ("score", "recall", "mass"))
    return out.select(F.col("page_key").cast("bigint").alias("doc_id"), F.col("phrase_id").alias("item_id"), *rounded, F.col("first").alias("first_word"), F.col("last").alias("last_word"))


def grounding_fuzzy(spark, sf_dir):
    """Every document in which a benchmark passage is found, word for word or nearly."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("phrase_id"), F.col("text").alias("phrase"))
    return _found(grounding.ground_anywhere(_pages(spark, sf_dir), items))


def altered(phrase: Column) -> Column:
    """A phrase as a careless reader has it: of words of five characters or more one in two lacks its third, one in four has its second twice."""
    worse = lambda w, i: F.when((F.length(w) < 5) | (i % 4 == 3), w).when(i % 4 == 1, F.concat(F.substring(w, 1, 2), F.substring(w, 2, 999))).otherwise(F.concat(F.substring(w, 1, 2), F.substring(w, 4, 999)))
    return F.array_join(F.transform(F.filter(F.split(phrase, r"[ \t\n\x0B\f\r]+"), lambda x: x != ""), worse), " ")


def grounding_altered(spark, sf_dir):
    """Every document in which a benchmark passage is found whose words have been altered first."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("phrase_id"), altered(F.col("text")).alias("phrase"))
    return _found(grounding.ground_anywhere(_pages(spark, sf_dir), items))


def _vocabularies(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    words = lambda name, c: table(spark, sf_dir, name).select(F.explode(_split("text")).alias("w")).distinct().select(text.clean_token(F.col("w")).alias(c)).filter(F.col(c) != "").distinct()
    return words("benchmark", "token"), words("documents", "word")


def near_words(spark, sf_dir):
    """The words of documents that nearly are words of the benchmark."""
    out = vocabulary.nearly_equal(*_vocabularies(spark, sf_dir))
    return out.select("token", "word", F.round("ratio", 6).alias("ratio"))


def _lines(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "text"))
    return d.select("doc_id", (F.floor(F.col("p") / 40) + 1).cast("int").alias("page"), (F.col("p") % 40 + 1).cast("int").alias("line"), "text")


def line_offsets(spark, sf_dir):
    out = geometry.line_offsets(_lines(spark, sf_dir))
    return out.select("doc_id", "page", "line_id", "char_start", "char_end")


def page_roles(spark, sf_dir):
    p = _lines(spark, sf_dir).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n_lines"))
    return p.withColumn("role", labels.page_role(F.col("page"), F.max("page").over(Window.partitionBy("doc_id"))))


def _boxes(spark, sf_dir) -> DataFrame:
    """Lines with boxes: 30 high, 50 apart, 10 for each character wide."""
    x = geometry.line_offsets(_lines(spark, sf_dir))
    return x.select("doc_id", "page", "line", "line_id", F.lit(100).alias("x_min"), (F.col("line") * 50).alias("y_min"), (F.lit(100) + 10 * F.length("text")).alias("x_max"), (F.col("line") * 50 + 30).alias("y_max"))


def spatial_anchor(spark, sf_dir):
    """A field for each page, over its second to fourth lines."""
    lines = _boxes(spark, sf_dir)
    fields = lines.select("doc_id", "page").distinct().select("doc_id", "page", F.lit("f").alias("field_id"), F.lit(50).alias("x0"), F.lit(100).alias("y0"), F.lit(400).alias("x1"), F.lit(210).alias("y1"))
    return geometry.anchors(fields, lines).select("doc_id", "page", F.array_join("anchors", ",").alias("anchors"))


def _words(spark, sf_dir) -> DataFrame:
    w = _lines(spark, sf_dir).select("doc_id", "page", "line", F.posexplode(F.filter(F.split("text", " "), lambda x: x != "")).alias("k", "text"))
    return w.select("doc_id", "page", "text", (F.col("k") * 100).alias("x_min"), (F.col("line") * 50 + F.col("k") % 3).alias("y_min"), (F.col("k") * 100 + 90).alias("x_max"), (F.col("line") * 50 + 30 + F.col("k") % 3).alias("y_max"))


def line_fold(spark, sf_dir):
    """Words of whole documents in boxes, folded to lines again."""
    return geometry.fold_lines(_words(spark, sf_dir)).select("doc_id", F.col("page").cast("bigint").alias("page"), F.col("line").cast("bigint").alias("line"), F.sha2("text", 256).alias("sha256"))


def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(records.html_text(F.col("html")), 256).alias("text_sha256"))


def hash_id(spark, sf_dir):
    raw = F.col("text").cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(raw, 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("bytes"), F.hex(F.substring(raw, 1, 8)).alias("magic"))


def statute_applicability(spark, sf_dir):
    """Nations as contracts (type and law by key) against regions as statute chunks."""
    n = table(spark, sf_dir, "nation")
    kinds = F.create_map(*(F.lit(x) for x in (0, "nda", 1, "lease", 2, "msa", 3, "distribution", 4, "other")))
    scope = {"nda": ("nda",), "lease": ("lease", "goods_hire"), "msa": ("services", "other_commercial"), "distribution": ("distribution", "other_commercial"), "employment": ("employment",), "other": ("other_commercial", "ip_agreement")}
    types = F.create_map(*(y for k, v in scope.items() for y in (F.lit(k), F.array(*map(F.lit, v)))))
    law = F.when(F.col("n_nationkey") % 3 == 0, None).when(F.col("n_nationkey") % 3 == 1, "laws of Singapore").otherwise(F.col("n_name"))
    c = n.select("n_nationkey", kinds[F.col("n_nationkey") % 5].alias("kind"), text.jurisdiction(law).alias("gate"))
    r = table(spark, sf_dir, "region")
    status = labels.ai_status(F.when(F.col("r_regionkey") == 4, "dependency_unavailable"), F.when(F.col("r_regionkey") == 1, "case_law_gloss").otherwise("statute_text"), F.array(F.when(F.col("r_regionkey") == 2, "cuad_native").otherwise("none")))
    s = r.select("r_regionkey", status.alias("ai"), F.when(F.col("r_regionkey") % 2 == 0, F.array(F.lit("other_commercial"), F.lit("nda"))).otherwise(F.array(F.lit("lease"), F.lit("services"))).alias("for"))
    both = c.join(F.broadcast(s), F.arrays_overlap(types[F.col("kind")], F.col("for")))  # chunks are a small fixed list
    reason = F.when(F.col("ai") == "NA", "dependency_unavailable").when(F.col("gate") == "excluded", "governing_law_excluded")
    return both.select("n_nationkey", "r_regionkey", F.when(reason.isNotNull(), "NA").otherwise(F.col("ai")).alias("status"), reason.alias("reason"))


def entity_clusters(spark, sf_dir):
    """Parts as mentions of a party by five words and, for each third one, by the first word too, which many share."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("contract_id"), F.lit(0).alias("ord"), F.col("p_name").alias("raw"))
    short = p.filter("contract_id % 3 = 0").select("contract_id", F.lit(1).alias("ord"), F.element_at(F.split("raw", " "), 1).alias("raw"))
    return entities.entity_clusters(p.unionByName(short)).select("cluster", "n_aliases", "n_contracts")


QUERIES = {f.__name__: f for f in (
    date_parse, duration_parse, number_parse, json_norm, normalize_entity, entity_pairs, clean_tokens, evidence_mass, grounding_exact, grounding_fuzzy, grounding_altered, near_words, line_offsets, page_roles, spatial_anchor, line_fold,
    html_text, hash_id, statute_applicability, entity_clusters,
)}

_WS = r"'[ \t\n\x0B\f\r]+'"
_TOKEN = r"lower(regexp_replace(w, '[^\p{L}\p{N}\p{M}_]+', '', 'g'))"
_LINES = "l AS (SELECT doc_id, (i - 1) // 40 + 1 AS page, (i - 1) % 40 + 1 AS line, i, x AS text FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS t(x, i))"

ORACLE = {
    "date_parse": """SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN o_orderdate::DATE END AS field_date, CASE WHEN o_orderkey % 5 < 2 THEN o_orderdate::DATE END AS conflict_date FROM orders""",
    "duration_parse": """SELECT DISTINCT l_orderkey, l_linenumber::BIGINT AS line, l_quantity::INT AS q,
 CASE l_quantity::INT % 4 WHEN 0 THEN l_quantity::INT WHEN 1 THEN 7 * l_quantity::INT WHEN 2 THEN 30 * l_quantity::INT ELSE 12 * 365 END AS days,
 CASE l_quantity::INT % 4 WHEN 2 THEN l_quantity::INT WHEN 3 THEN 144 END AS months FROM lineitem""",
    "number_parse": r"SELECT event_id, regexp_extract(replace('USD -1,0' || props, ',', ''), '-?\d+(?:\.\d+)?')::DOUBLE AS signed, regexp_extract(replace(props, ',', ''), '-?\d+(?:\.\d+)?')::DOUBLE AS value FROM events",
    "json_norm": "SELECT json_extract_string(props, '$.k') AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1",
    "normalize_entity": "SELECT p_partkey, lower(p_name) AS name, 'the ' || lower(p_name) || ' holdings buyer' AS invoice_name FROM part",
    "entity_pairs": """WITH n AS (SELECT DISTINCT lower(p_name) AS x FROM part), a AS (SELECT x FROM n UNION SELECT string_split(x, ' ')[1] FROM n), t AS (SELECT x, list_distinct(string_split(x, ' ')) AS w FROM a)
 SELECT a.x AS a, b.x AS b FROM t a JOIN t b ON a.x < b.x WHERE len(list_intersect(a.w, b.w)) >= greatest(1, least(len(a.w), len(b.w)))""",
    "entity_clusters": """WITH RECURSIVE p AS (SELECT p_partkey AS id, 0 AS o, p_name AS raw FROM part UNION ALL SELECT p_partkey, 1, string_split(p_name, ' ')[1] FROM part WHERE p_partkey % 3 = 0),
 m AS MATERIALIZED (SELECT *, lower(raw) AS name, row_number() OVER (ORDER BY id, o) AS k FROM p), n AS (SELECT DISTINCT name, list_distinct(string_split(name, ' ')) AS w FROM m),
 same AS (SELECT x.name AS x, y.name AS y FROM n x JOIN n y ON x.name = y.name OR len(list_intersect(x.w, y.w)) >= greatest(1, least(len(x.w), len(y.w)))),
 e AS MATERIALIZED (SELECT b.k, list(a.k) FILTER (a.k < b.k) AS earlier FROM m b JOIN same ON x = b.name JOIN m a ON a.name = y GROUP BY b.k),
 r(k, openers) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT e.k, list_append(openers, coalesce(list_min([openers[j] for j in earlier]), e.k)) FROM r JOIN e ON e.k = r.k + 1),
 z AS (SELECT unnest(openers) AS opener, unnest(range(1, len(openers) + 1)) AS k FROM (SELECT openers FROM r ORDER BY k DESC LIMIT 1))
 SELECT c.name AS cluster, count(DISTINCT trim(m.raw)) AS n_aliases, count(DISTINCT m.id) AS n_contracts FROM z JOIN m USING (k) JOIN m c ON c.k = z.opener GROUP BY 1""",
    "clean_tokens": f"SELECT token, count(*) AS n FROM (SELECT {_TOKEN} AS token FROM (SELECT unnest(regexp_split_to_array(text, {_WS})) AS w FROM documents)) WHERE token <> '' GROUP BY 1",
    "evidence_mass": f"""WITH c AS (SELECT doc_id, {_TOKEN} AS token, count(*) AS c FROM (SELECT doc_id, unnest(regexp_split_to_array(text, {_WS})) AS w FROM documents) WHERE w <> '' GROUP BY 1, 2),
 n AS (SELECT doc_id, sum(c)::BIGINT AS n FROM c GROUP BY 1)
 SELECT doc_id, n AS n_words, count(*) AS n_distinct, round(sum(CASE WHEN n <= 1 THEN 1.0 ELSE greatest(0.0, least(1.0, ln(n / (1 + c)) / ln(n))) END), 6) AS mass FROM c JOIN n USING (doc_id) GROUP BY 1, 2""",
    "grounding_exact": "SELECT item_id, doc_id, strpos(d.text, b.text)::BIGINT AS place FROM benchmark b JOIN documents d ON contains(d.text, b.text)",
    "line_offsets": f"""WITH {_LINES} SELECT doc_id, page::INT AS page, 'L' || CASE WHEN i < 10000 THEN lpad(i::VARCHAR, 4, '0') ELSE i::VARCHAR END AS line_id,
 (sum(length(text) + 1) OVER w - length(text) - 1)::BIGINT AS char_start, (sum(length(text) + 1) OVER w - 1)::BIGINT AS char_end FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)""",
    "page_roles": f"WITH {_LINES}, p AS (SELECT doc_id, page::INT AS page, count(*) AS n_lines FROM l GROUP BY 1, 2) SELECT *, CASE WHEN page = 1 THEN 'cover' WHEN page = max(page) OVER (PARTITION BY doc_id) THEN 'signature' ELSE 'operative' END AS role FROM p",
    "spatial_anchor": f"""WITH {_LINES} SELECT doc_id, page::INT AS page, string_agg('L' || CASE WHEN i < 10000 THEN lpad(i::VARCHAR, 4, '0') ELSE i::VARCHAR END, ',' ORDER BY i) AS anchors FROM l WHERE line BETWEEN 2 AND 4 GROUP BY 1, 2""",
    "line_fold": f"""WITH {_LINES}, w AS (SELECT doc_id, page, line, trim(regexp_replace(text, ' +', ' ', 'g'), ' ') AS s FROM l), g AS (SELECT * FROM w WHERE trim(s, ' ') <> '')
 SELECT doc_id, page::BIGINT AS page, row_number() OVER (PARTITION BY doc_id, page ORDER BY line) AS line, sha256(s) AS sha256 FROM g""",
    "html_text": r"SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gis'), '<[^>]*>', ' ', 'gs'), '[ \t\n\r]+', ' ', 'g'), ' ')) AS text_sha256 FROM pages",
    "hash_id": "SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text))::BIGINT AS bytes, left(hex(encode(text)), 16) AS magic FROM documents",
    "statute_applicability": """WITH c AS (SELECT n_nationkey AS k, n_nationkey % 5 AS t, n_nationkey % 3 = 2 AND NOT contains(lower(n_name), 'singapore') AS out FROM nation),
 s AS (SELECT r_regionkey AS r, CASE r_regionkey WHEN 4 THEN 'NA' WHEN 1 THEN 'Inferred' WHEN 2 THEN 'Quoted' ELSE 'Evaluation Required' END AS ai FROM region)
 SELECT k AS n_nationkey, r AS r_regionkey, CASE WHEN ai = 'NA' OR out THEN 'NA' ELSE ai END AS status, CASE WHEN ai = 'NA' THEN 'dependency_unavailable' WHEN out THEN 'governing_law_excluded' END AS reason
 FROM c JOIN s ON CASE WHEN r % 2 = 0 THEN t IN (0, 2, 3, 4) ELSE t IN (1, 2) END""",
}
