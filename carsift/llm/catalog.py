"""Queries of the numbered operators over whole tables, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carsift.llm import bpe, filter_audit, fim, html_main, jaccard, langid, licenses, line_dedup, mixing, quality, substrings, topk, toxicity
from carsift.llm.scratch import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out() -> Column:
    """Rows that no model may learn from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

OP3_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{WORD}') AS w FROM d),
g AS (SELECT doc_id, i, w[i] || chr(0) || w[i + 1] || chr(0) || w[i + 2] AS g FROM w, unnest(range(1, len(w) - 1)) AS u(i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, unnest([0, 1, 2]) AS u(k) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
n AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) AS n_lines FROM l WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w.w)::BIGINT AS n_words, length(regexp_replace(text, '{SPACE}', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n.n_dup_lines, 0)::BIGINT AS n_dup_lines,
        coalesce(c.n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n.n_lines, 0)::BIGINT AS n_lines,
        length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
        length(regexp_replace(text, '[^A-Za-z\x{{C0}}-\x{{10FFFF}}]', '', 'g')) AS n_letters, length(regexp_replace(text, '[^0-9]', '', 'g')) AS n_digits
      FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        10 * n_symbols > 3 * n_words OR (n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines) OR (n_letters >= 50 AND 100 * n_upper > 70 * n_letters)
        OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 100 * n_digits > 50 * word_chars AS more_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR more_failed) AS kept FROM f
"""


@query("op3_quality_rules", OP3_SQL)
def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality.ledger(table(spark, folder, "documents").select("doc_id", "text"), keep_text=False)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       quality.failed(quality.BASE).alias("base_failed"), quality.kept("v1").alias("kept"))


FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _template_rows() -> str:
    rows = []
    for t, (text, label) in enumerate([*licenses.PHRASES, *licenses.NOTICES]):
        w = text.split()
        k = min(3, len(w))
        for i in range(len(w) - k + 1):
            third = f"'{w[i + 2]}'" if k == 3 else "NULL"
            rows.append(f"({t}, {t < len(licenses.PHRASES)}, '{label}', {len(w) - k + 1}, {i}, '{w[i]}', '{w[i + 1]}', {third})")
    return ", ".join(rows)


OP4_SQL = rf"""
WITH tpl(t, exact, label, grams, at_, w0, w1, w2) AS (VALUES {_template_rows()}),
w AS (SELECT doc_id, regexp_extract_all({FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS w0, generate_subscripts(w, 1) - 1 AS i FROM w),
g AS (SELECT doc_id, i, w0, lead(w0, 1) OVER o AS w1, lead(w0, 2) OVER o AS w2 FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT doc_id, t, exact, label, grams, at_, i - at_ AS d FROM g JOIN tpl ON g.w0 = tpl.w0 AND g.w1 = tpl.w1 AND (tpl.w2 IS NULL OR g.w2 = tpl.w2)),
whole AS (SELECT doc_id, label, true AS exact, d, 1.0::DOUBLE AS cover FROM h WHERE exact GROUP BY doc_id, label, grams, t, d HAVING count(DISTINCT at_) = grams),
n0 AS (SELECT DISTINCT doc_id, t, d FROM h WHERE NOT exact),
n1 AS (SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY doc_id, t ORDER BY d) <= {licenses.DRIFT} THEN 0 ELSE 1 END AS fresh FROM n0),
n2 AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, t ORDER BY d) AS span FROM n1),
near AS (SELECT doc_id, label, false AS exact, min(d) AS d, count(DISTINCT at_) / grams AS cover FROM n2 JOIN h USING (doc_id, t, d)
         GROUP BY doc_id, t, label, grams, span HAVING count(DISTINCT at_) / grams >= {licenses.COVER}),
f AS (SELECT * FROM whole UNION ALL SELECT * FROM near),
a AS (SELECT doc_id, count(*) FILTER (exact) AS n_base, min(d) FILTER (exact) AS first_word, max(d) FILTER (exact) AS last_word,
      string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score FROM f GROUP BY doc_id)
SELECT doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM w LEFT JOIN a USING (doc_id)
"""


@query("op4_license_scan", OP4_SQL)
def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents").select("doc_id", "text"))


@query("op8_language_id")
def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~held_out()))
    return langid.predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query("op10_byte_bpe")
def op10_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = bpe.public_vocabulary()
    coded = bpe.encode(table(spark, folder, "documents").select("doc_id", "text"), vocabulary)
    return bpe.decode(coded, vocabulary).select("doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


OP7_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({FOLD}, '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], chr(1)) AS g FROM w, unnest(range(1, greatest(len(w) - 1, 2))) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM k JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 90 * (nx.n + ny.n - k)),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(m.y, doc_id)) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS y FROM r GROUP BY x) m USING (doc_id)
"""


@query("op7_ngram_jaccard_join", OP7_SQL)
def op7_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.classes(table(spark, folder, "documents"), n=3, num=9, den=10)


OP9_SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
v AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM w, unnest(range(1, len(w) - 48)) AS u(i)),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS lo FROM v) WHERE lo < doc_id),
c AS (SELECT DISTINCT doc_id, i + j AS i FROM m, unnest(range(50)) AS u(j)),
p AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept, count(*) AS n FROM p ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""


@query("op9_substring_dedup", OP9_SQL)
def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = substrings.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"), size=50)
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op1_line_dedup")
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.line_classes(table(spark, folder, "documents").select("doc_id", "text")).drop("text_key")


OP2_SQL = """
WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
bad AS (SELECT DISTINCT vec_id FROM e WHERE x IS NULL OR NOT isfinite(x)),
v AS (SELECT vec_id, i, floor(1024 * x)::BIGINT AS x FROM e WHERE vec_id NOT IN (SELECT vec_id FROM bad)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score FROM v q JOIN v c ON q.i = c.i AND q.vec_id <> c.vec_id
      WHERE q.vec_id % 100 = 0 GROUP BY q.vec_id, c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
QUALIFY rank <= 10
"""


@query("op2_exact_topk", OP2_SQL)
def op2_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.search(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query("op5_source_mixing")
def op5_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).drop("text_key")


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels").select("doc_id", "toxic")
    index = toxicity.fit(docs.where(~held_out()), labels.where(~held_out()))
    return toxicity.score(docs, index).select("doc_id", held_out().alias("held_out"), "score", "predicted")


PERMUTATIONS = ", ".join(f"('{''.join(p)}')" for p in permutations("ABCDE"))
OP11_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{WORD}') AS w, min(doc_id) OVER (PARTITION BY text) AS lo FROM t),
f AS (SELECT doc_id, part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
        100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, coalesce(lo < doc_id, false) AS e FROM w),
m AS (SELECT doc_id, part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS bits FROM f),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
g AS (SELECT part, bits, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, bits),
o(filter_order) AS (VALUES {PERMUTATIONS}),
s AS (SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS bit,
        list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65)))::INT AS before FROM o, unnest(range(1, 6)) AS u(step)),
r AS (SELECT part, filter_order, step, bit, sum(n) FILTER (bits & (coalesce(before, 0) | bit) = 0) AS kept,
        sum(n) FILTER (bits & bit > 0 AND bits & coalesce(before, 0) = 0) AS removed, sum(n) FILTER (bits & bit > 0 AND bits & coalesce(before, 0) > 0) AS redundant,
        sum(n) FILTER (bits = bit) AS unique_fails, sum(good) FILTER (bits & bit > 0 AND bits & coalesce(before, 0) = 0) AS good_lost,
        sum(toxic) FILTER (bits & bit > 0 AND bits & coalesce(before, 0) = 0) AS toxic_lost FROM g, s GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley FROM r
"""


@query("op11_filter_audit", OP11_SQL)
def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


# the pages of this table keep their main text in one article element of headings and paragraphs
OP12_SQL = r"""
WITH a AS (SELECT page_id, url, replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '<br>', ' ') AS a FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(a, '</?(?:p|h1)>'), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '\s+', ' ', 'g'))) AS b FROM a),
t AS (SELECT page_id, url, replace(replace(replace(replace(replace(array_to_string(list_filter(b, lambda x: x <> ''), chr(10)), '&lt;', '<'), '&gt;', '>'),
        '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&') AS text FROM b)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t
"""


@query("op12_html_extraction", OP12_SQL)
def op12_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return html_main.extract(pages, html_main.fit(pages, html_main.built_pages(spark, 600)))


OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (SELECT *, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1, n) AS suffix FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""


@query("op13_fill_in_middle", OP13_SQL)
def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    stored = written(fim.store(table(spark, folder, "documents").select("doc_id", "text")), "frames")
    made = fim.digests(fim.transform(stored))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
