"""Secret scans with multipart credential linking, in DataFrame operations only.

Base spans, leftmost and non-overlapping per kind, in code points: assign, access and hex (see ASSIGN, ACCESS, HEX).
Multipart linking adds weak spans, which mean nothing alone: identifiers (client, user or account ids), weak secrets (keys
under other names, and long mixed tokens) and endpoints (URLs and host:port). Spans are cut into scopes: bins of `reach` code
points of one document. An interval join links parts: a weak identifier or weak secret is reported only if a secret part,
respectively an identifier or endpoint, lies within `reach` code points; an endpoint only if both an identifier and a
secret do. Distances count from the end of the span before to the start of the one behind. The join is an equi-join on document
and bin, where a weak span meets all bins within reach of its start and end, with the first start and last end of each role in
a bin, so thousands of parts in one text never make pairs; as a bin is no longer than the reach, that is exact.

Defined results: a null or empty text has no spans and the hash of the empty string; a null doc_id is a row like others; repeated doc_ids
are told apart by the hash of their texts and are scanned each, repeated rows give a row each; ties in start are ordered by kind as
listed; a text of many thousand spans takes time in proportion; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import content_key, fresh, packed, table, written

ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: Greedy runs, so that asking for the least length in the pattern drops the same matches as asking afterwards.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Weak parts: kind, pattern, role.
WEAK = (
    ("client", r"(?i:client_?id|access_?key_?id|account_?id|user_?name|login)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@+/_.=-]{4,}", "identifier"),
    ("key", r"(?i:private_?key|access_?key|auth_?key|client_?key|credential|passphrase)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{8,}", "secret"),
    ("blob", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]*[0-9])(?=[A-Za-z0-9+/_=-]*[A-Z])(?=[A-Za-z0-9+/_=-]*[a-z])[A-Za-z0-9+/_=-]{40,}", "secret"),
    ("url", r"(?i:https?|postgres|mysql|mongodb|redis|amqp|ftp|ssh)://[A-Za-z0-9.:@/_-]+", "endpoint"),
    ("host", r"(?i:host|endpoint|server)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.-]+(?::[0-9]+)?", "endpoint"),
)
ORDER = ["assign", "access", "hex", *(k for k, _, _ in WEAK)]
#: Roles of the base kinds in links.
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret"} | {k: r for k, _, r in WEAK}
REACH = 300
SPAN = "array<struct<start:bigint,rank:int,end:bigint>>"


#: Pieces whose lengths are summed together, and code points of a text that are masked together.
STEP, PART = 64, 4096


def bound(x: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.transform(F.array(x), f)[0]


def placed(cut: Column, rank: int) -> Column:
    """The matches in a text that is cut before each of them, each ended by \x02. The lengths before a match are summed by blocks, so
    that thousands of matches take time in proportion: a fold that appends copies what it has at each step."""
    from_to = lambda lengths, at, n: F.aggregate(F.slice(lengths, at + 1, n), F.lit(0).cast("bigint"), lambda a, x: a + x)
    numbers = lambda n: F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))

    def match(p, i, lengths, before):
        # i pieces and what stands before the first one come before this piece; each of the pieces has a \x02
        at = i + 1
        start = F.element_at(before, F.floor(at / STEP).cast("int") + 1) + from_to(lengths, at - at % STEP, at % STEP) - i
        m = F.substring_index(p, "\x02", 1)
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(m)).alias("end"), m.alias("m"))

    blocks = lambda lengths: F.transform(numbers(F.ceil(F.size(lengths) / STEP).cast("int")), lambda k: from_to(lengths, k * STEP, F.lit(STEP)))
    before = lambda sums: F.transform(numbers(F.size(sums)), lambda k: from_to(sums, F.lit(0), k))
    found = lambda lengths, sums: F.transform(F.slice(cut, 2, F.size(cut)), lambda p, i: match(p, i, lengths, sums))
    lengths = F.transform(cut, lambda x: F.length(x).cast("bigint"))
    return bound(lengths, lambda n: bound(blocks(n), lambda s: bound(before(s), lambda x: found(n, x))))


def spans(text: Column, kind: str, pattern: str, keep: Column | None = None, gate: str | None = None) -> Column:
    """(start, rank of the kind, end) of all matches. The text is cut at its matches, whose lengths give the places.
    keep: a condition on the match m, by its text."""
    marked = F.regexp_replace(F.translate(text, "\x01\x02", "\x03\x03"), pattern, "\x01$0\x02")
    found = bound(F.split(marked, "\x01"), lambda cut: placed(cut, ORDER.index(kind)))
    if keep is not None:
        found = F.filter(found, keep)
    found = F.transform(found, lambda s: F.struct(s["start"], s["rank"], s["end"]))
    return F.when(text.rlike(gate or pattern), found).otherwise(F.array().cast(SPAN))


def masked(text: Column, found: Column) -> Column:
    """The text with each span replaced by its kind in brackets, at its start; overlapping spans are one. Parts of PART code points are
    masked apart, so that no long text is copied for each span."""
    names = F.array(*[F.lit(k) for k in ORDER])

    def part(p, k):
        begin = k.cast("bigint") * PART
        own = F.filter(found, lambda s: (s["start"] < begin + PART) & (s["end"] > begin))

        def step(a, s):
            fresh = s["start"] >= a["at"]
            shown = F.concat(F.substr(p, (a["at"] - begin + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit("["), F.element_at(names, s["rank"] + 1), F.lit("]"))
            return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], F.when(fresh, shown).otherwise("")).alias("out"))

        start = F.struct(begin.alias("at"), F.lit("").alias("out"))
        return F.aggregate(own, start, step, lambda a: F.concat(a["out"], F.when(a["at"] < begin + PART, F.substr(p, (a["at"] - begin + 1).cast("int"))).otherwise("")))

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)), part), "")


def shown(s: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in ORDER])
    return F.array_join(F.transform(F.array_sort(s), lambda x: F.concat_ws(":", F.element_at(names, x["rank"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def parsed(docs: DataFrame) -> DataFrame:
    """doc_id, base spans by kind, all weak spans."""
    text = F.coalesce(F.col("text"), F.lit(""))
    long_value = lambda s: F.length(F.regexp_extract(s["m"], ASSIGN, 1)) >= 8
    weak = [spans(F.col("t"), k, p) for k, p, _ in WEAK]
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("t")).select(
        "doc_id",
        F.xxhash64("t").alias("row"),
        spans(F.col("t"), "assign", ASSIGN, long_value).alias("assign"),
        spans(F.col("t"), "access", ACCESS).alias("access"),
        spans(F.col("t"), "hex", HEX).alias("hex"),
        F.concat(*weak).alias("weak"),
    )


def linked(found: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, row, start, rank, end of the weak spans that complementary parts stand by."""
    roles = F.array(*[F.lit(ROLES[k]) for k in ORDER])
    parts = (
        found.filter(F.size("weak") > 0)
        .select("doc_id", "row", F.explode(F.concat("assign", "access", "hex", "weak")).alias("s"))
        .select("doc_id", "row", "s.*")
        .select("*", F.element_at(roles, F.col("rank") + 1).alias("role"))
    )
    # what a span of a role must have near it: (role, needed role)
    needs = {"identifier": ["secret"], "secret": ["identifier|endpoint"], "endpoint": ["identifier", "secret"]}
    cover = parts.select("doc_id", "row", "role", "start", "end", F.explode(F.sequence(F.expr(f"start div {reach}"), F.expr(f"(end - 1) div {reach}"))).alias("bin"))
    bins = cover.groupBy("doc_id", "row", "bin", "role").agg(F.min("start").alias("first"), F.max("end").alias("last"))
    by_role = bins.groupBy("doc_id", "row", "bin").agg(*[f(F.when(F.col("role") == r, F.col(c))).alias(f"{r}_{c}") for r in ("identifier", "secret", "endpoint") for f, c in ((F.min, "first"), (F.max, "last"))])
    base = len(ORDER) - len(WEAK)
    # a weak span meets every bin that a span within reach of its start or end has a code point in; `end` is exclusive
    met = F.sequence(F.expr(f"greatest(start - {reach} - 1, 0) div {reach}"), F.expr(f"(end + {reach}) div {reach}"))
    weak = parts.filter(F.col("rank") >= base).select("*", F.explode(met).alias("bin"))
    close = lambda r: (F.col(f"{r}_first") <= F.col("end") + reach) & (F.col(f"{r}_last") >= F.col("start") - reach)
    seen = weak.join(by_role, ["doc_id", "row", "bin"]).groupBy("doc_id", "row", "start", "rank", "end", "role").agg(*[F.max(F.coalesce(close(r), F.lit(False))).alias(f"has_{r}") for r in ("identifier", "secret", "endpoint")])
    ok = F.lit(False)
    for role, wanted in needs.items():
        every = F.lit(True)
        for w in wanted:
            any_of = F.lit(False)
            for x in w.split("|"):
                any_of = any_of | F.col(f"has_{x}")
            every = every & any_of
        ok = ok | ((F.col("role") == role) & every)
    return seen.filter(ok).select("doc_id", "row", "start", "rank", "end")


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """One row a document: counts of base spans, the hash of the base spans, all spans as a string and as an array."""
    found = written(parsed(docs), "secrets").withColumn("id", F.col("doc_id")).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
    more = linked(found, reach).groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", F.col("rank").cast("int").alias("rank"), "end")).alias("linked"))
    base = F.concat("assign", "access", "hex")
    out = packed(found.join(more, ["doc_id", "row"], "left"), found.count(), 100_000).withColumn("every", F.array_sort(F.concat(base, F.coalesce("linked", F.array().cast(SPAN)))))
    count = lambda c: F.size(c).cast("bigint")
    return out.select(F.col("id").alias("doc_id"), count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("every")).alias("spans"), F.size(F.coalesce("linked", F.array().cast(SPAN))).cast("bigint").alias("n_linked"), F.col("every").alias("found"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("found")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; each secret span is replaced by its kind in brackets, and n_chars follows. Overlapping spans are masked as one."""
    key, spans, shut = fresh(docs, "key", "spans", "masked")
    keyed = docs.withColumn(key, content_key(docs, "text"))
    found = scan(keyed.select(F.col(key).alias("doc_id"), "text")).filter(F.size("found") > 0).groupBy(F.col("doc_id").alias(key)).agg(F.min("found").alias(spans))
    out = keyed.join(found, key, "left").withColumn(shut, masked(F.col("text"), F.col(spans)))
    hit = F.col(spans).isNotNull()
    kept = {c: F.col(c) for c in docs.columns} | {"text": F.when(hit, F.col(shut)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        kept["n_chars"] = F.when(hit, F.length(shut)).otherwise(F.col("n_chars")).cast("bigint")
    return packed(out.select(*[kept[c].alias(c) for c in docs.columns]), docs.count(), 8_000)
