"""Functions whose inputs no table has as they are, on inputs that are made of the tables' words and numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import inverse, lexicon, numbers, phonetics, text, tokens
from ..functions.alphabet import FILLERS, LETTERS, ORDINALS, ROMAN_ORDINALS, UNITS
from ..functions.numbers import ROMAN
from ..operators import align as A
from ..operators import metadata as M
from ..sources import files, lexicons, sinks
from .registry import query, scratch, table
from .text_queries import _WORDS, _mutation_sql, _placed, lit

_LEX = lexicon.small()
_MAP_OF = lambda m: "MAP {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in m.items()) + "}"


def _words(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The different words of a table's texts."""
    return table(spark, d, name).select(F.explode(text.split_words(F.col("text"))).alias("s")).distinct()


def _words_sql(name: str) -> str:
    return f"(SELECT DISTINCT unnest({_WORDS}) AS s FROM {name})"


# Characters and words

_BRACKETS_SQL = "(SELECT conv_id, turn, replace(replace(text, ', ', ' ('), '. ', ') ') AS s FROM conversations)"


@query("c7_parentheses", rf"SELECT conv_id, turn, regexp_extract_all(s, '\((.+?)\)', 1) AS inside, md5(regexp_replace(s, '\(.+?\)', '', 'g')) AS rest FROM {_BRACKETS_SQL}")
def _(spark, d):
    s = F.replace(F.replace("text", F.lit(", "), F.lit(" (")), F.lit(". "), F.lit(") "))
    out = text.parentheses(F.col("s"))
    return table(spark, d, "conversations").select("conv_id", "turn", s.alias("s")).select("conv_id", "turn", out["extracted"].alias("inside"), F.md5(out["remaining"]).alias("rest"))


_FORMS_SQL = f"""(SELECT s FROM {_words_sql('conversations')} UNION SELECT q || e FROM (SELECT DISTINCT CAST(l_quantity AS BIGINT) AS q, unnest(['', 'vet', 'e15', 'eur', 'h7', 'h75', 'km', '.000€', '.00€', '%', 'de', 'xyz']) AS e FROM lineitem)
    UNION SELECT substr('XVIVXIIXVXXVIII', p_size % 7 + 1, p_size % 4 + 1) || e FROM (SELECT p_size, unnest(['', 'vet', 'añ', 'x']) AS e FROM part) UNION SELECT s || '·' || s FROM {_words_sql('benchmark')})"""


@query(
    "c14_c15_word_predicates",
    f"""SELECT s, regexp_matches(s, {lit(f"^(?i)['’" + chr(92) + f"-·{LETTERS}]+$")}) AS word, regexp_matches(s, {lit(f"^(?i)['-a{LETTERS[1:]}]+·[-{LETTERS}]+$")}) AS inclusive,
        regexp_matches(s, {lit('^(?:[0-9]{1,3}(?:' + chr(92) + '.[0-9]{3})+|[0-9]+)(?:' + '|'.join(text.re.escape(u) for u in sorted(UNITS, key=lambda u: (-len(u), u))) + ')$')}) AS quantity,
        regexp_matches(s, '^[0-9]+(?:e|h|eur)(?:0*[0-5]?[0-9])?$') AS clock, s IN ({', '.join(map(lit, ORDINALS))}) OR regexp_matches(s, '^[0-9]+vet$') AS ordinal,
        regexp_matches(s, '^[XVI]+$') AS roman, s IN ({', '.join(map(lit, ROMAN_ORDINALS))}) OR regexp_matches(s, '^[XVI]+vet$') AS roman_ordinal FROM {_FORMS_SQL}""",
)
def _(spark, d):
    ends = lambda *x: F.explode(F.array(*[F.lit(e) for e in x]))
    numbered = table(spark, d, "lineitem").select(F.col("l_quantity").cast("bigint").cast("string").alias("q")).distinct().select("q", ends("", "vet", "e15", "eur", "h7", "h75", "km", ".000€", ".00€", "%", "de", "xyz").alias("e"))
    romans = table(spark, d, "part").select(F.expr("substr('XVIVXIIXVXXVIII', p_size % 7 + 1, p_size % 4 + 1)").alias("q"), ends("", "vet", "añ", "x").alias("e"))
    forms = numbered.union(romans).select(F.concat("q", "e").alias("s")).union(_words(spark, d, "conversations")).union(_words(spark, d, "benchmark").select(F.concat("s", F.lit("·"), "s")))
    c = F.col("s")
    return forms.distinct().select(
        "s", text.is_word(c).alias("word"), text.is_inclusive_word(c).alias("inclusive"), text.is_unit_number(c).alias("quantity"), text.is_time(c).alias("clock"), text.is_ordinal(c).alias("ordinal"), text.is_roman_number(c).alias("roman"), text.is_roman_ordinal(c).alias("roman_ordinal")
    )


@query("c17_reverse_mutation", f"SELECT s, array_to_string({_mutation_sql()}, ',') AS candidates FROM {_words_sql('documents')}")
def _(spark, d):
    return _words(spark, d, "documents").select("s", F.array_join(text.reverse_mutation(F.col("s")), ",").alias("candidates"))


_NOUNS_SQL = f"(SELECT DISTINCT lower(s) AS w, CASE WHEN length(s) % 2 = 0 THEN 'm' ELSE 'f' END AS g FROM {_words_sql('benchmark')})"


@query("c18_noun_gender", f"SELECT s, coalesce(bool_or(g = 'f'), false) AS feminine, coalesce(bool_or(g = 'm'), false) AS masculine FROM (SELECT s, unnest([s] || {_mutation_sql()}) AS w FROM (SELECT DISTINCT lower(s) AS s FROM {_words_sql('documents')}) WHERE length(s) > 1) LEFT JOIN {_NOUNS_SQL} USING (w) GROUP BY s")
def _(spark, d):
    """Which words are nouns, the nouns being those of another table."""
    words = _words(spark, d, "documents").select(F.lower("s").alias("s")).distinct().filter("length(s) > 1")
    nouns = _words(spark, d, "benchmark").select(F.lower("s").alias("w"), F.when(F.length("s") % 2 == 0, "m").otherwise("f").alias("g")).distinct()
    each = words.select("s", F.explode(F.concat(F.array("s"), text.reverse_mutation(F.col("s")))).alias("w"))
    return each.join(nouns, "w", "left").groupBy("s").agg(F.coalesce(F.bool_or(F.col("g") == "f"), F.lit(False)).alias("feminine"), F.coalesce(F.bool_or(F.col("g") == "m"), F.lit(False)).alias("masculine"))


@query("c24_contractions", f"SELECT conv_id, turn, md5(array_to_string({_WORDS.replace('text', 'replace(' * len(text.CONTRACTIONS) + 's' + ''.join(f', {lit(a)}, {lit(b)})' for a, b in text.CONTRACTIONS))}, ' ')) AS split FROM (SELECT conv_id, turn, replace(replace(text, ' the ', ' me ''meus '), ' a ', ' eñ ''neus ') AS s FROM conversations)")
def _(spark, d):
    s = F.replace(F.replace("text", F.lit(" the "), F.lit(" me 'meus ")), F.lit(" a "), F.lit(" eñ 'neus "))
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(text.split_contractions(s)).alias("split"))


@query("d1_raw_tokens", r"SELECT conv_id, turn, unnest(regexp_extract_all(s, '\{[^{}]*\}|[^\s{}]+')) AS data, unnest(list_transform(regexp_extract_all(s, '\{[^{}]*\}|[^\s{}]+'), lambda x: CASE WHEN x LIKE '{%' THEN 'METADATA' WHEN regexp_full_match(x, '<[A-Z'']+>') THEN 'SPECIAL_TOKEN' ELSE 'RAW' END)) AS type FROM (SELECT conv_id, turn, '{spk: ' || role || '} ' || replace(regexp_replace(text, '[{}]', '', 'g'), '. ', ' <NTT> ') || ' {?}' AS s FROM conversations)")
def _(spark, d):
    s = F.concat(F.lit("{spk: "), "role", F.lit("} "), F.replace(F.regexp_replace("text", "[{}]", ""), F.lit(". "), F.lit(" <NTT> ")), F.lit(" {?}"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.explode(tokens.raw_tokens(s)).alias("t")).select("conv_id", "turn", "t.data", "t.type")


# Lexicons made of the words of a table

_ORD = "conv_id * 1000000 + turn * 10000 + pos"
_EACH_SQL = f"(SELECT conv_id, turn, {_ORD} AS ord, pos, w FROM (SELECT conv_id, turn, unnest({_WORDS}) AS w, generate_subscripts({_WORDS}, 1) - 1 AS pos FROM conversations))"


def _each(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(text.split_words(F.col("text"))).alias("pos", "w")).withColumn("ord", F.expr(_ORD))


_PLAIN_SQL = f"(SELECT ord, pos, regexp_replace(w, '#', '', 'g') AS w FROM {_EACH_SQL} WHERE regexp_replace(w, '#', '', 'g') <> '')"
_LINES_SQL = f"(SELECT ord, w || CASE pos % 5 WHEN 0 THEN '' WHEN 1 THEN ' ' || left(w, 2) || ' # said' ELSE ' ' || left(w, 1) || ' ' || pos % 3 END AS line FROM {_PLAIN_SQL})"


@query(
    "a9_lexicon",
    f"""WITH x AS (SELECT ord, split_part(b, ' ', 1) AS word, nullif(trim(substr(b, length(split_part(b, ' ', 1)) + 1)), '') AS pron FROM (SELECT ord, trim(split_part(line, '#', 1)) AS b FROM {_LINES_SQL})),
    c AS (SELECT word, max(CASE WHEN pron IS NULL THEN ord END) AS cleared FROM x GROUP BY word), k AS (SELECT word, pron, min(ord) AS o FROM x JOIN c USING (word) WHERE pron IS NOT NULL AND ord > coalesce(cleared, -1) GROUP BY word, pron)
    SELECT word, coalesce(string_agg(pron, '|' ORDER BY o), '') AS prons FROM c LEFT JOIN k USING (word) GROUP BY word""",
)
def _(spark, d):
    w = F.regexp_replace("w", "#", "")
    said = F.when(F.col("pos") % 5 == 0, "").when(F.col("pos") % 5 == 1, F.concat(F.lit(" "), F.substring(w, 1, 2), F.lit(" # said"))).otherwise(F.concat(F.lit(" "), F.substring(w, 1, 1), F.lit(" "), (F.col("pos") % 3).cast("string")))
    rows = _each(spark, d).select("ord", F.concat(w, said).alias("line"), w.alias("w")).filter("w <> ''")
    return files.lexicon(rows).select("word", F.array_join("prons", "|").alias("prons"))


_TABBED_SQL = f"(SELECT ord, lower(w) || CASE WHEN pos % 3 = 0 THEN ' ' || left(lower(w), 1) ELSE '' END AS k, CASE WHEN pos % 4 = 0 THEN '' ELSE w || ' ' || pos % 2 END AS v FROM {_EACH_SQL})"


def _tabbed(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat(F.lower("w"), F.when(F.col("pos") % 3 == 0, F.concat(F.lit(" "), F.substring(F.lower("w"), 1, 1))).otherwise(""))
    value = F.when(F.col("pos") % 4 == 0, "").otherwise(F.concat(F.lit("\t"), "w", F.lit(" "), (F.col("pos") % 2).cast("string")))
    return _each(spark, d).select("ord", F.concat(key, value).alias("line"))


@query("a10_a19_keyed_lexicons", f"SELECT k AS key, arg_max(v, ord) AS value FROM {_TABBED_SQL} GROUP BY k")
def _(spark, d):
    return files.keyed(_tabbed(spark, d))


@query("a18_ngram_table", f"SELECT CAST(len(string_split(k, ' ')) AS INT) AS n, k AS key, arg_max(v, ord) AS sub FROM {_TABBED_SQL} GROUP BY k")
def _(spark, d):
    t = files.ngram_table(_tabbed(spark, d))
    return t.select("n", F.array_join("key", " ").alias("key"), F.array_join("sub", " ").alias("sub"))


_NAMES_SQL = f"(SELECT s AS word, upper(left(s, 1)) || ' ' || length(s) AS prons FROM {_words_sql('documents')} WHERE regexp_full_match(s, '[A-Z][a-z]+'))"


@query(
    "c20_mutated_names",
    f"SELECT word, arg_max(prons, o) AS prons FROM (SELECT word, prons, 0 AS o FROM {_NAMES_SQL} UNION ALL SELECT m[word[1]] || substr(word, 2), m[word[1]] || substr(prons, 2), 1 FROM {_NAMES_SQL}, (SELECT MAP {{'P': 'B', 'B': 'V', 'M': 'V', 'K': 'G', 'T': 'D'}} AS m) WHERE word[1] IN ('P', 'B', 'M', 'K', 'T')) GROUP BY word",
)
def _(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.split("text", text.SPACE + "+")).alias("s"))
    names = words.filter("s RLIKE '^[A-Z][a-z]+$'").distinct().select(F.col("s").alias("word"), F.array(F.concat(F.upper(F.substring("s", 1, 1)), F.lit(" "), F.length("s").cast("string"))).alias("prons"))
    return files.mutated_names(names).select("word", F.array_join("prons", "|").alias("prons"))


@query("d16_reverse_dictionary", f"SELECT left(s, 3) AS word, string_agg(s, ', ' ORDER BY s) AS keys FROM {_words_sql('benchmark')} GROUP BY left(s, 3)")
def _(spark, d):
    return files.reversed_rules(_words(spark, d, "benchmark").select(F.col("s").alias("pattern"), F.substring("s", 1, 3).alias("repl")))


_CAPITALS_SQL = f"(SELECT s FROM {_words_sql('benchmark')} WHERE regexp_matches(s, '^[A-Z]'))"


@query("c19_names", f"SELECT s AS word, len(list_filter(string_split(s, '-'), lambda p: NOT list_contains(n, p))) = 0 AS name FROM {_words_sql('documents')}, (SELECT list(s) AS n FROM {_CAPITALS_SQL})")
def _(spark, d):
    """Words of the documents whose parts are all among the capitalised words of another table."""
    names = _words(spark, d, "benchmark").filter("s RLIKE '^[A-Z]'").select(F.col("s").alias("word"))
    return lexicons.named(_words(spark, d, "documents").select(F.col("s").alias("word")), "word", names)


_RULE_SQL = f"array_to_string(list_filter(list_transform(regexp_extract_all('.' || lower(s) || '.', {lit(f'(?s){phonetics._GRAPHEMES}|.')}), lambda p: {_MAP_OF(phonetics.SAID)}[p]), lambda p: p IS NOT NULL), ' ')"


@query(
    "f1_phonetized",
    f"""SELECT s AS word, coalesce({_MAP_OF({k: '|'.join(v) for k, v in phonetics.LETTER_NAMES.items()})}[s], CASE WHEN s IN (SELECT s FROM {_words_sql('benchmark')}) THEN 'S ' || s END, {_MAP_OF(FILLERS)}[lower(s)], {_RULE_SQL} || CASE WHEN length(s) % 4 = 0 AND s IN (SELECT s FROM {_words_sql('conversations')}) THEN '|ALSO' ELSE '' END) AS said FROM {_words_sql('documents')} WHERE s NOT LIKE '%-%'""",
)
def _(spark, d):
    """Words of the documents by a lexicon made of two other tables, and by rule."""
    places = _words(spark, d, "benchmark").select(F.lit("places").alias("kind"), F.col("s").alias("word"), F.array(F.concat(F.lit("S "), "s")).alias("said"))
    also = _words(spark, d, "conversations").filter("length(s) % 4 = 0").select(F.lit("said_also").alias("kind"), F.col("s").alias("word"), F.array(F.lit("ALSO")).alias("said"))
    found = lexicons.phonetized(_words(spark, d, "documents").filter("NOT contains(s, '-')").select(F.col("s").alias("word")), "word", places.union(also))
    return found.select("word", F.array_join("variants", "|").alias("said"))


_ENTRIES_SQL = f"""(SELECT 'nouns_m' AS kind, s AS word, [] AS said FROM {_words_sql('benchmark')} WHERE length(s) % 2 = 0 AND regexp_full_match(s, '[A-Za-z.,]+') UNION ALL SELECT 'acronyms', s, [left(s, 1) || ' X', left(s, 1) || ' Y'] FROM {_words_sql('benchmark')} WHERE regexp_full_match(s, '[A-Za-z.,]+')
    UNION ALL SELECT 'corrected', s, [left(s, 2), 'new'] FROM {_words_sql('benchmark')} WHERE length(s) % 3 = 0 AND regexp_full_match(s, '[A-Za-z.,]+'))"""


@query("a11_a17_lexicons", f"SELECT kind, word, array_to_string(said, '|') AS said FROM {_ENTRIES_SQL}")
def _(spark, d):
    """Lexicons written as files and scanned in one pass."""
    path = scratch(spark, "lexicons")
    w = _words(spark, d, "benchmark").filter("s RLIKE '^[A-Za-z.,]+$'")
    line = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("value"))
    letter = F.substring("s", 1, 1)
    both = F.concat("s", F.lit(" "), letter, F.lit(" X # first\n"), "s", F.lit("\t"), letter, F.lit(" Y\n"), "s", F.lit(" "), letter, F.lit(" X"))
    rows = F.array(F.when(F.length("s") % 2 == 0, line("nouns_m", F.concat(F.lit("  "), "s", F.lit("  ")))), line("acronyms", F.concat(F.lit("# a comment\n\n"), "s", F.lit("\n"), both)), F.when(F.length("s") % 3 == 0, line("corrected", F.concat("s", F.lit("\told one\n"), "s", F.lit("\t"), F.substring("s", 1, 2), F.lit(" new")))))
    w.select(F.explode(F.array_compact(rows)).alias("r")).select("r.*").write.partitionBy("kind").text(path)
    return lexicons.scan(spark, path, "*.txt").select("kind", "word", F.array_join("said", "|").alias("said"))


@query("f4_vocabulary", f"SELECT s AS word, count(*) AS n FROM (SELECT unnest({_WORDS}) AS s FROM conversations) WHERE lower(s) NOT IN (SELECT lower(s) FROM {_words_sql('benchmark')} WHERE length(s) % 2 = 0 UNION SELECT lower(s) FROM {_words_sql('documents')} WHERE length(s) = 3) GROUP BY s")
def _(spark, d):
    """Words that a speller made of a dictionary and interjections doesn't know."""
    dictionary = _words(spark, d, "benchmark").filter("length(s) % 2 = 0").select(F.lit("words").alias("kind"), F.col("s").alias("word"), F.array().cast("array<string>").alias("said"))
    cries = _words(spark, d, "documents").filter("length(s) = 3").select(F.lit("interjections").alias("kind"), F.col("s").alias("word"), F.array().cast("array<string>").alias("said"))
    speller = lexicons.only(dictionary.union(cries), "words", "interjections").select(F.lower("word").alias("known")).distinct()
    words = _each(spark, d).groupBy(F.col("w").alias("word")).agg(F.count("*").alias("n"))
    return words.join(speller, F.lower("word") == F.col("known"), "left_anti")


# Files of other kinds

@query("a6_segments", "SELECT l_orderkey * 7 / 1000 AS start, (l_orderkey * 7 + l_linenumber * 250) / 1000 AS \"end\" FROM lineitem")
def _(spark, d):
    path = scratch(spark, "segments")
    a = F.col("l_orderkey") * 7
    table(spark, d, "lineitem").select(F.concat_ws(" ", a, a + F.col("l_linenumber") * 250).alias("value")).write.text(path)
    return files.segments(spark, path)


@query("a25_script", r"SELECT role AS speaker, trim(regexp_replace(text, '\s+', ' ', 'g')) AS utterance FROM conversations WHERE turn % 3 < 2")
def _(spark, d):
    path = scratch(spark, "script")
    line = F.concat("role", F.when(F.col("turn") % 3 < 2, "\t").otherwise(" - "), F.regexp_replace("text", r"\s+", " "))
    table(spark, d, "conversations").select(line.alias("value")).write.text(path)
    return files.script(spark, path)


@query("b15_printed", "SELECT conv_id, turn, CASE WHEN role <> 'user' THEN trim(regexp_replace(s, '<(?:/?[^/BIbi<>][^<>]*|/?[BIbi][^<>]+)>', '', 'g')) END AS shown FROM (SELECT conv_id, turn, role, replace(replace(text, ' the ', ' <i>the</i> '), '. ', '.<c>x</c> ') AS s FROM conversations)")
def _(spark, d):
    s = F.replace(F.replace("text", F.lit(" the "), F.lit(" <i>the</i> ")), F.lit(". "), F.lit(".<c>x</c> "))
    return table(spark, d, "conversations").select("conv_id", "turn", sinks.printed(s, F.when(F.col("role") == "user", "false").otherwise("true")).alias("shown"))


@query("f10_latest_model", "SELECT p_brand AS type, arg_max('m' || p_partkey, {'v': [CAST(p_size AS BIGINT), p_partkey % 50], 'n': 'm' || p_partkey}) AS name FROM part GROUP BY p_brand")
def _(spark, d):
    rows = table(spark, d, "part").select(F.concat(F.lit("m"), "p_partkey").alias("name"), F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 50).cast("string")).alias("version"), F.col("p_brand").alias("type"))
    return files.latest(rows, "type")


@query("a30_sibling_audio", "SELECT f.file, arg_min(a.file, a.r) AS audio FROM (SELECT DISTINCT 'x/c' || conv_id || '.ali' AS file, 'x/c' || conv_id AS stem FROM conversations) f LEFT JOIN (SELECT 'x/c' || conv_id || '.' || e AS file, 'x/c' || conv_id AS stem, list_position(['wav', 'mp3', 'm4a', 'ogg', 'mp4', 'mkv'], e) AS r FROM (SELECT DISTINCT conv_id, ['txt', 'mkv', 'ogg', 'mp3', 'wav'][(conv_id + turn) % 5 + 1] AS e FROM conversations WHERE turn < 2) WHERE e <> 'txt') a USING (stem) GROUP BY 1")
def _(spark, d):
    rows = table(spark, d, "conversations")
    name = F.concat(F.lit("x/c"), "conv_id", F.lit("."))
    kinds = F.element_at(F.array(*[F.lit(e) for e in ("txt", "mkv", "ogg", "mp3", "wav")]), ((F.col("conv_id") + F.col("turn")) % 5 + 1).cast("int"))
    return files.with_audio(rows.select(F.concat(name, F.lit("ali")).alias("file")).distinct(), rows.filter("turn < 2").select(F.concat(name, kinds).alias("file")).distinct())


# Transcripts

@query("a4_a7_carried", r"SELECT 'c' || conv_id AS file, turn AS line, trim(text) AS text, role AS speaker, last_value(CASE WHEN turn % 2 = 1 THEN 'm' END IGNORE NULLS) OVER w AS gender, last_value(CASE WHEN turn % 3 = 0 THEN 'p' || turn END IGNORE NULLS) OVER w AS parser FROM (SELECT conv_id, turn, role, regexp_replace(text, '[{}]', '', 'g') AS text FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def _(spark, d):
    """What braces say is carried on through the lines of plain transcripts."""
    braces = F.concat(F.lit(" {spk: "), "role", F.when(F.col("turn") % 2 == 1, "; gender: m").otherwise(""), F.lit("}"), F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" {parser: p"), "turn", F.lit("}"))).otherwise(""))
    rows = table(spark, d, "conversations").select(F.concat(F.lit("c"), "conv_id").alias("file"), F.col("turn").alias("line"), F.concat(F.regexp_replace("text", "[{}]", ""), braces).alias("text"))
    return files.carried(rows)


@query("g5_extracted_metadata", "SELECT conv_id, turn, trim(s) AS text, role AS speaker, 'a,b_c' AS tags, CAST(turn AS VARCHAR) AS start, [CAST(2 AS INT)] AS unknown FROM (SELECT conv_id, turn, role, 'un dra {?} ' || trim(regexp_replace(text, '[{}]', '', 'g')) AS s FROM conversations)")
def _(spark, d):
    """Legacy lines, with an unknown word, by themselves."""
    s = F.concat(F.lit("un dra {?} "), F.btrim(F.regexp_replace("text", "[{}]", "")), F.lit(" {tags: a, b c; spk: "), "role", F.lit("} {start: "), "turn", F.lit("}"))
    x = M.extracted(s)
    return table(spark, d, "conversations").select("conv_id", "turn", x["text"].alias("text"), x["meta"]["speaker"].alias("speaker"), x["meta"]["tags"].alias("tags"), x["meta"]["start"].alias("start"), x["unknown"].alias("unknown"))


_REGION_SQL = r"(SELECT conv_id, turn, role, trim(regexp_replace(regexp_replace(text, '[{}#]', '', 'g'), '\s+', ' ', 'g')) AS t, CASE WHEN turn % 4 = 3 THEN 'fr' ELSE 'br' END AS lang FROM conversations)"


@query(
    "g2_g6_squeezed",
    f"SELECT 'c' || conv_id AS file, t || '  pell' AS text, role AS speaker, CAST(turn AS DOUBLE) AS start FROM (SELECT *, coalesce(lag(lang) OVER (PARTITION BY conv_id ORDER BY turn), 'br') AS was FROM {_REGION_SQL}) WHERE t <> '' AND lang = 'br' AND was = 'br' AND turn % 5 < 4",
)
def _(spark, d):
    """Regions of each line in one, but for lines with another language or that are not for training."""
    plain = F.btrim(F.regexp_replace(F.regexp_replace("text", "[{}#]", ""), r"\s+", " "))
    train = F.when(F.col("turn") % 5 < 4, "true").otherwise("false")
    line = F.concat(F.lit("{train: "), train, F.lit("}"), plain, F.lit(" {spk: "), "role", F.lit("; lang: "), F.when(F.col("turn") % 4 == 3, "fr").otherwise("br"), F.lit("} pell {start: "), "turn", F.lit("; end: "), F.col("turn") + 1, F.lit("}"))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("x"))
    whole = rows.select(F.concat(F.lit("c"), "conv_id").alias("file"), F.concat(F.lit("{lang: br}\n"), F.array_join(F.transform("x", lambda x: x["line"]), "\n")).alias("text"))
    found = M.utterances(M.parsed(whole, unwanted={"train": "false"}))
    s = M.squeezed(F.col("regions"), "br")
    return found.select("file", s.alias("s"), "start").filter("s IS NOT NULL").select("file", "s.text", F.col("s.meta")["speaker"].alias("speaker"), "start")


@query("a8_header", r"SELECT 'c' || conv_id AS file, 's' || conv_id AS source, 'br' AS lang FROM (SELECT DISTINCT conv_id FROM conversations)")
def _(spark, d):
    line = F.concat(F.regexp_replace(F.regexp_replace("text", "[{}#]", ""), r"\s+", " "), F.lit(" {lang: fr; source: other} {start: "), "turn", F.lit("; end: "), F.col("turn") + 1, F.lit("}"))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("x"))
    whole = rows.select(F.concat(F.lit("c"), "conv_id").alias("file"), F.concat(F.lit("{source: s"), "conv_id", F.lit("}\n# note\n{lang: br}\n"), F.array_join(F.transform("x", lambda x: x["line"]), "\n")).alias("text"))
    return files.header(M.parsed(whole)).select("file", F.col("meta")["source"].alias("source"), F.col("meta")["lang"].alias("lang"))


# Numbers

_GROUPS_SQL = "(SELECT DISTINCT CAST(l_quantity AS BIGINT) AS q, l_partkey % 999 + 1 AS k, l_suppkey % 999 + 1 AS s FROM lineitem)"


def _groups(spark: SparkSession, d: str) -> DataFrame:
    """Sentences with quantities, groups of digits, shares and units, of the numbers of the table."""
    rows = table(spark, d, "lineitem").select(F.col("l_quantity").cast("bigint").alias("q"), (F.col("l_partkey") % 999 + 1).alias("k"), (F.col("l_suppkey") % 999 + 1).alias("s")).distinct()
    return rows.withColumn("text", F.concat_ws("", "q", F.lit(" kazh, "), "k", F.lit(" 000 euro, "), "q", F.lit("% hag "), "s", F.lit("km.")))


@query(
    "d6_numerals",
    f"SELECT q, k, s, unnest([q || ' kazh', k || '000 euro', q || '%', s || 'km']) AS data, unnest([q || '', k || '000', q || '', s || '']) AS number, unnest(['kazh', 'euro', '%', 'km']) AS unit, 'QUANTITY' AS type FROM {_GROUPS_SQL}",
)
def _(spark, d):
    kinds = ("NUMBER", "QUANTITY", "ORDINAL", "ROMAN_NUMBER", "ROMAN_ORDINAL", "TIME", "UNIT")
    found = tokens.with_tokens(_groups(spark, d), ["q", "k", "s"], F.col("text"), _LEX, ("data", "number", "unit", "type"), only=kinds)
    return found.select("q", "k", "s", F.explode("tokens").alias("t")).select("q", "k", "s", "t.data", "t.number", "t.unit", "t.type")


def _noun_sql(n: str, noun: str) -> str:
    """A number below 1000 with a noun."""
    w = f"t[{n} + 1]"
    return _placed(f"CASE WHEN {n} % 10 = 1 THEN replace({w}, 'unan', '{'un' if noun[0] in 'adehinot' else 'ur'}') ELSE {w} END", f"'{noun}'")


@query(
    "e8_e9_normalized",
    f"SELECT q, k, s, {_noun_sql('q', 'kazh')} || ', ' || CASE WHEN k = 1 THEN 'mil' WHEN k = 2 THEN 'daou vil' ELSE t[k + 1] || ' mil' END || ' euro, ' || t[q + 1] || ' dre gant hag ' || {_noun_sql('s', 'kilometr').replace(chr(39) + 'kilometr' + chr(39), 'CASE WHEN s % 10 = 1 AND s % 100 <> 11 THEN ' + lit(chr(99) + chr(39) + 'hilometr') + ' ELSE ' + lit('kilometr') + ' END')} || '.' AS said FROM {_GROUPS_SQL}, {numbers.lists_sql()}",
)
def _(spark, d):
    """The same sentences with their numbers in words."""
    return _groups(spark, d).select("q", "k", "s", tokens.normalized(F.col("text"), _LEX).alias("said"))


@query("e10_number_values", "SELECT DISTINCT l_partkey * 50 + CAST(l_quantity AS BIGINT) AS n, l_partkey * 50 + CAST(l_quantity AS BIGINT) AS worth FROM lineitem")
def _(spark, d):
    worth = F.pandas_udf(lambda s: s.map(lambda x: inverse.value(x.split())), "bigint")
    return table(spark, d, "lineitem").select((F.col("l_partkey") * 50 + F.col("l_quantity").cast("bigint")).alias("n")).distinct().select("n", worth(numbers.number_words(F.col("n"))).alias("worth"))


_ROMAN_MAP = _MAP_OF(ROMAN)
_RANKS_SQL = f"(SELECT DISTINCT CAST(l_quantity AS BIGINT) AS n, list_extract(map_keys({_ROMAN_MAP}), CAST(l_quantity AS INT) % {len(ROMAN)} + 1) AS r FROM lineitem)"
@query("e6_e7_ordinals", f"SELECT n, r, coalesce({_MAP_OF(ORDINALS)}[n || 'vet'], t[n + 1] || 'vet') AS ordinal, {_ROMAN_MAP}[r] AS roman, coalesce({_MAP_OF(ROMAN_ORDINALS)}[r || 'vet'], {_ROMAN_MAP}[r] || 'vet') AS roman_ordinal FROM {_RANKS_SQL}, {numbers.lists_sql()}")
def _(spark, d):
    romans = F.array(*[F.lit(r) for r in ROMAN])
    rows = table(spark, d, "lineitem").select(F.col("l_quantity").cast("bigint").alias("n")).distinct().withColumn("r", F.element_at(romans, (F.col("n") % len(ROMAN) + 1).cast("int")))
    ranked = lambda c: F.concat(c, F.lit("vet"))
    return rows.select("n", "r", numbers.ordinal_words(ranked(F.col("n").cast("string"))).alias("ordinal"), numbers.roman_words(F.col("r")).alias("roman"), numbers.roman_ordinal_words(ranked(F.col("r"))).alias("roman_ordinal"))


_READ_SQL = """CASE WHEN f THEN [a || ' ' || CASE WHEN w LIKE 'k%' THEN 'g' || substr(w, 2) WHEN w LIKE 'p%' THEN 'b' || substr(w, 2) WHEN w LIKE 't%' THEN 'd' || substr(w, 2) WHEN w LIKE 'gw%' THEN 'w' || substr(w, 3) WHEN w LIKE 'g%' THEN 'c''h' || substr(w, 2) WHEN w LIKE 'b%' OR w LIKE 'm%' THEN 'v' || substr(w, 2) ELSE w END] ELSE [] END"""


@query("e3_e4_articles", f"SELECT w AS noun, unnest(CASE WHEN m THEN [a || ' ' || CASE WHEN w LIKE 'k%' THEN 'c''h' || substr(w, 2) ELSE w END] ELSE [] END || {_READ_SQL}) AS reading FROM (SELECT w, length(w) % 2 = 0 AS m, length(w) % 3 > 0 AS f, CASE WHEN w LIKE 'l%' THEN 'al' WHEN regexp_matches(w, '^[adehinot]') THEN 'an' ELSE 'ar' END AS a FROM (SELECT DISTINCT lower(s) AS w FROM {_words_sql('conversations')}) WHERE regexp_full_match(w, '[a-z]+') AND w <> 'dor')")
def _(spark, d):
    words = _words(spark, d, "conversations").select(F.lower("s").alias("noun")).distinct().filter("noun RLIKE '^[a-z]+$' AND noun <> 'dor'")
    return words.select("noun", F.explode(numbers.article_noun(F.col("noun"), "ar", F.length("noun") % 2 == 0, F.length("noun") % 3 > 0)).alias("reading"))


# Tokens of whole texts

_MARKED = r"regexp_extract_all(text, '[^\s.,]+|[.,]+')"


@query("d2_d4_tokens", rf"SELECT conv_id, turn, md5(array_to_string(list_transform({_MARKED}, lambda x: CASE WHEN x = '.' THEN '.|' ELSE x END), ' ')) AS h FROM (SELECT conv_id, turn, regexp_replace(regexp_replace(text, '[^a-z., ]', ' ', 'g'), '[.,]\s*[.,]+', '. ', 'g') AS text FROM conversations)")
def _(spark, d):
    """Plain letters, full stops and commas of all texts: the chunks' parts, with a bar for each end of a sentence."""
    plain = F.regexp_replace(F.regexp_replace("text", r"[^a-z., ]", " "), r"[.,]\s*[.,]+", ". ")
    found = tokens.with_tokens(table(spark, d, "conversations"), ["conv_id", "turn"], plain, _LEX, ("data", "type"))
    shown = F.array_join(F.transform("tokens", lambda x: F.when(x["type"] == "END_OF_SENTENCE", "|").otherwise(x["data"])), " ")
    return found.select("conv_id", "turn", F.md5(F.replace(shown, F.lit(". |"), F.lit(".|"))).alias("h"))


# Alignment, without SQL: tests hold these against plain versions.

def _heard(spark: SparkSession, d: str) -> DataFrame:
    """Words of benchmark items and, as heard, without a word in seven and with each eleventh changed."""
    words = text.split_words(F.col("text"))
    h = lambda w, i: F.pmod(F.xxhash64(w, i, F.col("item_id")), F.lit(77))
    kept = F.filter(words, lambda w, i: h(w, i) % 7 > 0)
    return table(spark, d, "benchmark").select("item_id", words.alias("a"), F.transform(kept, lambda w, i: F.when(h(w, i) % 11 == 0, F.concat(F.lit("x"), F.substr(w, F.lit(2)))).otherwise(w)).alias("b"))


@query("h10_word_alignment")
def _(spark, d):
    return _heard(spark, d).select("item_id", "a", "b", A.word_alignment(F.col("a"), F.col("b")).alias("pairs"))


@query("h10_documents")
def _(spark, d):
    """Benchmark items against the documents of their numbers, whole texts of both."""
    both = table(spark, d, "benchmark").select("item_id", text.split_words(F.col("text")).alias("a")).join(table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), text.split_words(F.col("text")).alias("b")), "item_id")
    pairs = both.select("item_id", A.word_alignment(F.col("a"), F.col("b")).alias("p"))
    count = lambda f: F.size(F.filter("p", f))
    return pairs.select("item_id", count(lambda x: x["reference"] == x["hypothesis"]).alias("same"), count(lambda x: x["hypothesis"].isNull()).alias("missing"), count(lambda x: x["reference"].isNull()).alias("added"))


def _halves(spark: SparkSession, d: str) -> DataFrame:
    """Two halves of each item and the words of both, in their form for alignment."""
    n = F.floor(F.size("a") / 2).cast("int")
    form = lambda c: text.align_form(F.array_join(c, " "))
    return _heard(spark, d).filter("size(b) > 1").select("item_id", form(F.slice("a", F.lit(1), n)).alias("left"), form(F.slice("a", n + 1, F.size("a"))).alias("right"), F.transform("b", lambda w: text.align_form(w)).alias("words"), n.alias("n"))


@query("h6_best_cut")
def _(spark, d):
    return _halves(spark, d).select("item_id", "left", "right", "words", A.best_cut(F.col("left"), F.col("right"), F.col("words")).alias("cut"))


@query("h7_resolved")
def _(spark, d):
    """Halves that share two words."""
    cut = F.size("words") - F.floor(F.size("words") / 2).cast("int")
    h = _halves(spark, d).filter("size(words) > 6").withColumn("cut", cut)
    first = h.select("item_id", F.lit(0).alias("sentence"), F.col("left").alias("text"), F.lit(0).alias("lo"), (F.col("cut") + 1).alias("hi"), F.slice("words", F.lit(1), F.col("cut") + 1).alias("words"))
    second = h.select("item_id", F.lit(1).alias("sentence"), F.col("right").alias("text"), (F.col("cut") - 1).alias("lo"), F.size("words").alias("hi"), F.slice("words", F.col("cut"), F.size("words")).alias("words"))
    return A.resolved(first.union(second), "item_id")
