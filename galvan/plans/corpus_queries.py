"""Queries of the relational operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.alphabet import PUNCT_PAIRS
from ..operators import corpus as C
from ..sources import files, sinks
from .registry import query, table
from .text_queries import _MASKED, _PAIRED, _WORDS, _frame, _n, lit


def tokens():
    return T.masked_tokens(F.col("text"))


_GATED = "length(text) BETWEEN 200 AND 20000 AND " + " AND ".join(f"{_n(a)} = {_n(b)}" for a, b in PUNCT_PAIRS.items())


@query("j11_vocabulary", f"SELECT token, n FROM (SELECT w AS token, count(*) AS n FROM (SELECT unnest({_MASKED}) AS w FROM documents WHERE {_GATED}) GROUP BY w HAVING count(*) >= 2) ORDER BY n DESC, token LIMIT 100")
def _(spark, d):
    paired = F.lit(True)
    for a, b in PUNCT_PAIRS.items():
        paired = paired & (F.length("text") - F.length(F.replace("text", F.lit(a), F.lit(""))) == F.length("text") - F.length(F.replace("text", F.lit(b), F.lit(""))))
    docs = table(spark, d, "documents").filter(F.length("text").between(200, 20000) & paired)
    return C.top(C.vocabulary(docs, tokens(), 2), 100, F.desc("n"), F.asc("token"))


@query("j12_ngrams", f"SELECT w[i] || ' ' || w[i + 1] AS ngram, count(*) AS n FROM (SELECT w, unnest(range(1, len(w))) AS i FROM (SELECT {_MASKED} AS w FROM documents)) GROUP BY 1 HAVING count(*) >= 3")
def _(spark, d):
    return C.ngram_counts(table(spark, d, "documents"), tokens(), 2, 3)


@query("j12_head_ngrams", f"SELECT w[1] || ' ' || w[2] || ' ' || w[3] AS ngram, count(*) AS n FROM (SELECT {_MASKED} AS w FROM documents) WHERE len(w) >= 3 GROUP BY 1")
def _(spark, d):
    heads = table(spark, d, "documents").select(T.beginning(F.col("text"), 3).alias("text"))
    return C.ngram_counts(heads, tokens(), 3, 1, heads_only=True)


@query("j12_letters", "SELECT c AS letter, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY c")
def _(spark, d):
    return C.letter_counts(table(spark, d, "documents"), F.col("text"))


@query("j13_rollup_share", "SELECT source, lang, total, round(total / sum(total) FILTER (WHERE g = 3) OVER (), 9) AS share FROM (SELECT source, lang, CAST(sum(n_chars) AS BIGINT) AS total, grouping(source, lang) AS g FROM documents GROUP BY ROLLUP (source, lang))")
def _(spark, d):
    return C.shares(table(spark, d, "documents"), "source", "lang", F.col("n_chars")).withColumn("share", F.round("share", 9))


@query("j14_length_histogram", "SELECT b.range AS bin, count(doc_id) AS n FROM range(16) b LEFT JOIN (SELECT doc_id, least(n_chars // 1000, 15) AS bin FROM documents) d ON b.range = d.bin GROUP BY 1")
def _(spark, d):
    return C.histogram(table(spark, d, "documents"), F.col("n_chars"), 1000, 16)


@query("j15_conditional_distinct", "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT CASE WHEN value > 50 THEN user_id END) AS high, round(sum(CASE WHEN value > 50 THEN value ELSE 0 END), 4) AS total FROM events GROUP BY 1")
def _(spark, d):
    high = F.col("value") > 50
    return table(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct(F.when(high, F.col("user_id"))).alias("high"), F.round(F.sum(F.when(high, F.col("value")).otherwise(0)), 4).alias("total"))


@query(
    "j16_run_groups",
    "SELECT user_id, run, min(event_type) AS event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS run FROM (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS s FROM events)) GROUP BY user_id, run",
)
def _(spark, d):
    e = table(spark, d, "events").withColumn("o", F.struct("ts", "event_id"))
    return C.runs(e, ["user_id"], "o", "event_type").groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("j17_sorted_scores", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 1000")
def _(spark, d):
    return C.top(table(spark, d, "events").select("event_id", "value"), 1000, F.desc("value"), F.asc("event_id"))


@query("j18_vocabulary_share", f"WITH a AS (SELECT DISTINCT unnest({_MASKED}) AS w FROM documents), b AS (SELECT DISTINCT unnest({_MASKED}) AS w FROM benchmark) SELECT (SELECT count(*) FROM (SELECT w FROM a INTERSECT SELECT w FROM b)) AS both, (SELECT count(*) FROM (SELECT w FROM a UNION SELECT w FROM b)) AS either, round((SELECT count(*) FROM (SELECT w FROM a INTERSECT SELECT w FROM b)) / (SELECT count(*) FROM (SELECT w FROM a UNION SELECT w FROM b)), 9) AS share")
def _(spark, d):
    words = lambda t: table(spark, d, t).select(F.explode(tokens()).alias("w"))
    return C.jaccard_share(words("documents"), words("benchmark")).withColumn("share", F.round("share", 9))


@query("j19_except", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id").subtract(table(spark, d, "labels").select("doc_id"))


@query("j20_union_all", "SELECT 'document' AS kind, count(*) AS n FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark UNION ALL SELECT text FROM conversations)")
def _(spark, d):
    every = table(spark, d, "documents").select("text").unionByName(table(spark, d, "benchmark").select("text")).unionByName(table(spark, d, "conversations").select("text"))
    return every.agg(F.count("*").alias("n")).select(F.lit("document").alias("kind"), "n")


_LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents)"
_WN = f"len({_WORDS})"


def _gate_sql() -> str:
    simple = rf"regexp_replace(regexp_replace(translate(text, {lit(chr(34) + '«»' + chr(39) + '’()')}, ''), '^\s+|\s+$', '', 'g'), '^[-–—]\s+', '')"
    return rf"{_WN} BETWEEN 3 AND 15 AND {_PAIRED} AND NOT regexp_matches(text, '\p{{Nd}}') AND regexp_matches({simple}, '(?s)^\p{{Lu}}(?:.*[.!?…;:])$') AND len(list_filter({_WORDS}, lambda w: length(w) > 1 AND regexp_matches(w, '^\p{{Lu}}+$'))) = 0"


@query("j21_quality_gate", f"SELECT doc_id, text, count(*) AS n FROM {_LINES} WHERE {_gate_sql()} GROUP BY ALL")
def _(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("text"))
    return lines.filter(C.quality_gate(T.split_words(F.col("text")), F.col("text"))).groupBy("doc_id", "text").agg(F.count("*").alias("n"))


@query("j22_foreign_chars", f"SELECT doc_id, regexp_matches(text, {lit('[^' + T.chars(C.VALID_CHARS)[1:])}) AS foreign_ FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", C.has_foreign_chars(F.col("text")).alias("foreign_"))


@query("j23_word_after", f"SELECT doc_id, CASE WHEN i < len(w) THEN regexp_replace(w[i + 1], '-(?:se|mañ)$', '') END AS word FROM (SELECT doc_id, w, list_position(list_transform(w, lambda x: lower(x) IN ('the', 'der', 'la')), true) AS i FROM (SELECT doc_id, {_WORDS} AS w FROM documents))")
def _(spark, d):
    after = C.word_after(T.split_words(F.col("text")), F.array(F.lit("the"), F.lit("der"), F.lit("la")))
    return table(spark, d, "documents").select("doc_id", after.alias("word"))


@query("j24_sorted_lexicon", "SELECT s_name, s_nationkey FROM supplier ORDER BY s_name")
def _(spark, d):
    return table(spark, d, "supplier").select("s_name", "s_nationkey").orderBy("s_name")


@query("j25_best_by_group", "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def _(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("o_orderkey"))


@query(
    "j26_paragraphs",
    rf"""WITH l AS (SELECT doc_id, CAST(i - 1 AS INT) AS line_no, trim(l[i], ' ') AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
    m AS (SELECT *, line = '' OR (upper(line) = line AND regexp_matches(line, '\p{{Lu}}')) AS breaks FROM l), e AS (SELECT *, regexp_matches(line, '[.?!]$') AND NOT breaks AS ends FROM m),
    p AS (SELECT *, sum(CASE WHEN breaks OR pe THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS p FROM (SELECT *, coalesce(lag(ends) OVER (PARTITION BY doc_id ORDER BY line_no), false) AS pe FROM e))
    SELECT doc_id, min(line_no) AS line_no, string_agg(line, ' ' ORDER BY line_no) AS paragraph FROM p WHERE NOT breaks GROUP BY doc_id, p HAVING bool_or(ends)""",
)
def _(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "l"))
    return C.paragraphs(lines, ["doc_id"], "line_no", "l")


@query(
    "j27_joined_segments",
    r"""WITH RECURSIVE r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, CAST(turn * 3.0 AS DOUBLE) AS s, CAST(turn * 3.0 + 2 AS DOUBLE) AS e, text AS t,
        regexp_matches(text, '^(?:\p{Ll}|\p{Lu}[\p{Lu}\p{Nd}]|\p{Nd})') AS opens, regexp_matches(text, '(?:\p{Ll}|\p{Nd}|[-…,])$') AS open_, regexp_matches(text, '(?s)^\p{Lu}(?:.*[.!?…;:])$') AS full_ FROM conversations),
    j AS (SELECT conv_id, i, 1 AS g, s, e, t, open_, full_ FROM r WHERE i = 1
        UNION ALL SELECT conv_id, i, CASE WHEN x THEN g ELSE g + 1 END, CASE WHEN x THEN s0 ELSE s END, e, CASE WHEN x THEN t0 || ' ' || t ELSE t END, open_, CASE WHEN x THEN full0 AND full_ ELSE full_ END FROM (
            SELECT r.conv_id, r.i, g, j.s AS s0, r.s, r.e, j.t AS t0, r.t, r.open_, r.full_, j.full_ AS full0,
                (j.open_ AND r.opens AND r.s - j.e < 1.5 AND r.e - j.s < 15) OR (j.full_ AND r.full_ AND r.s - j.e < 2 AND r.e - j.s < 6) AS x FROM j JOIN r ON r.conv_id = j.conv_id AND r.i = j.i + 1))
    SELECT conv_id, arg_max(s, i) AS start, arg_max(e, i) AS "end", arg_max(t, i) AS text FROM j GROUP BY conv_id, g""",
)
def _(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", (F.col("turn") * 3.0).alias("start"), (F.col("turn") * 3.0 + 2).alias("end"), "text")
    return C.joined_segments(rows, ["conv_id"])


@query("j29_offsets", 'SELECT conv_id, turn, CAST(length(text) AS INT) AS n, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS "end", CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) AS BIGINT) AS start FROM conversations')
def _(spark, d):
    return C.offsets(table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("n")), ["conv_id"], "turn", "n")


@query("j30_segment_ids", "SELECT l_orderkey, l_linenumber, md5(CAST(l_orderkey AS VARCHAR)) AS h, concat_ws('-', CAST(l_partkey AS VARCHAR), lpad(CAST(CAST(floor(l_quantity * 100) AS BIGINT) AS VARCHAR), 7, '0'), lpad(CAST(CAST(ceil((l_quantity + 0.5) * 100) AS BIGINT) AS VARCHAR), 7, '0')) AS id FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.md5(F.col("l_orderkey").cast("string")).alias("h"), C.segment_id(F.col("l_partkey").cast("string"), F.col("l_quantity"), F.col("l_quantity") + 0.5).alias("id"))


@query("j1_inner_join", "SELECT a.l_orderkey, a.l_linenumber, a.l_quantity AS quantity_a, b.l_quantity AS quantity_b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_partkey = b.l_partkey")
def _(spark, d):
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    a = table(spark, d, "lineitem").select(*keys, F.col("l_quantity").alias("quantity_a"))
    b = table(spark, d, "lineitem").select(*keys, F.col("l_quantity").alias("quantity_b"))
    return a.join(b, keys).drop("l_partkey")


@query("j2_lookup", "SELECT conv_id, turn, gender FROM (SELECT conv_id, turn, role AS speaker FROM conversations) LEFT JOIN (SELECT speaker, arg_min(gender, ord) AS gender FROM (VALUES ('user', 'f', 2), ('user', 'm', 1), ('assistant', 'f', 1)) AS t(speaker, gender, ord) GROUP BY speaker) USING (speaker)")
def _(spark, d):
    people = _frame(spark, [("user", "f", 2), ("user", "m", 1), ("assistant", "f", 1)], "speaker, gender, ord")
    return C.with_gender(table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("speaker")), people).select("conv_id", "turn", "gender")


@query("j3_equi_join", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def _(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("j4_blacklist", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(spark, d):
    return C.without(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").filter("toxic = 1").select("doc_id"), "doc_id")


@query("j5_semi_join", "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(spark, d):
    return C.only(table(spark, d, "documents").select("doc_id", "n_chars"), table(spark, d, "labels").filter("quality = 1").select("doc_id"), "doc_id")


@query("j6_zip_join", "SELECT doc_id, item_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents) JOIN (SELECT item_id, row_number() OVER (ORDER BY item_id) AS r FROM benchmark) USING (r)")
def _(spark, d):
    b = table(spark, d, "benchmark").select("item_id")
    return C.zipped(table(spark, d, "documents").select("doc_id"), "doc_id", b, "item_id")


@query("j8_distinct", "SELECT count(DISTINCT lang) AS langs, count(DISTINCT source) AS sources, count(DISTINCT text) AS texts FROM documents")
def _(spark, d):
    return table(spark, d, "documents").agg(F.count_distinct("lang").alias("langs"), F.count_distinct("source").alias("sources"), F.count_distinct("text").alias("texts"))


@query("j9_dedup_head3", rf"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(array_to_string(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')[1:3], ' ')) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def _(spark, d):
    return C.first_of(table(spark, d, "documents").select("doc_id", C.head_key(F.col("text")).alias("h")), [F.col("h")], F.col("doc_id")).select("doc_id")


@query("j10_dedup_md5", "SELECT min(doc_id) AS doc_id, md5(source || text) AS h FROM documents GROUP BY 2")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5(F.concat("source", "text")).alias("h"))
    return C.first_of(docs, [F.col("h")], F.col("doc_id")).select("doc_id", "h")


@query("a1_lines", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents) WHERE line <> '' AND line NOT LIKE '#%' GROUP BY doc_id")
def _(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.btrim("line"))
    return lines.filter("line <> '' AND NOT startswith(line, '#')").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("a26_articles", r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda b: trim(b, ' ') <> '')) AS INT) AS articles FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(files.articles(F.col("text"))).alias("articles"))


_CODE = "CASE WHEN x = floor(x) THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE rtrim(printf('%.3f', x), '0') END"


@query("b1_b2_ali_lines", f"SELECT l_orderkey, l_linenumber, l_returnflag || ' {{start: ' || {_CODE.replace('x', 'l_quantity')} || '; end: ' || {_CODE.replace('x', '(l_quantity + 1.25)')} || '}}' AS line FROM lineitem".replace("ma(l_quantity)", "max"))
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", sinks.ali_line(F.col("l_returnflag"), F.col("l_quantity"), F.col("l_quantity") + 1.25).alias("line"))


@query("b7_resumed", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber > 3)")
def _(spark, d):
    done = table(spark, d, "lineitem").filter("l_linenumber > 3").select(F.col("l_orderkey").alias("o_orderkey"))
    return sinks.resumed(table(spark, d, "orders").select("o_orderkey"), done, "o_orderkey")


@query("b13_rescaled", 'SELECT conv_id, turn, turn * 2.0 * 1.5 + 0.25 AS start, (turn * 2.0 + 1) * 1.5 + 0.75 AS "end" FROM conversations')
def _(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", (F.col("turn") * F.lit(2.0)).alias("start"), (F.col("turn") * F.lit(2.0) + 1).alias("end"))
    return sinks.rescaled(rows, 1.5, 0.25, 0.75)


@query("b14_replaced_text", "SELECT doc_id, n_chars, b.text FROM documents d JOIN benchmark b ON d.doc_id = b.item_id")
def _(spark, d):
    return sinks.replaced_text(table(spark, d, "documents").select("doc_id", "n_chars", "text"), table(spark, d, "benchmark").withColumnRenamed("item_id", "doc_id"), "doc_id")


@query("b4_kaldi_text", "SELECT concat_ws(' ', role || '-c' || conv_id || '-' || lpad(CAST(turn * 300 AS VARCHAR), 7, '0') || '-' || lpad(CAST(turn * 300 + 200 AS VARCHAR), 7, '0'), text) AS value FROM conversations")
def _(spark, d):
    u = table(spark, d, "conversations").select(F.concat(F.lit("c"), "conv_id").alias("rec"), F.col("role").alias("speaker"), (F.col("turn") * 3.0).alias("start"), (F.col("turn") * 3.0 + 2).alias("end"), "text", F.lit("a.wav").alias("audio"))
    return sinks.kaldi(u, "", _frame(spark, [("user", "female")], "speaker, gender"))["text"]
