"""Main text of web pages by wrappers: union-free regular expressions that same-host pages are aligned to.

A page is a balanced stream of tags and texts (implied end tags are put in, stray ones dropped, inline markup is part of its text).
A wrapper is an expression over such streams: elements in order, each optional and repeated or not, texts as slots, and repeated
groups of optional elements; an element's content never names a child twice, so a stream is parsed without backtracking.

Inference: a page's stream is folded into an expression of its own (neighbours of one name become a repeated element, a name that
comes back later a repeated group), and the expressions of a host are aligned pair by pair. Children that both have, in the same
order, are merged; what one side lacks becomes optional; what stands in another order becomes a repeated group; texts become a
slot that remembers how much text it held, how much of it in links, and whether it was always the same. The result accepts all that
either side accepts. Each task folds its pages host by host; the tasks' wrappers are merged by a tree, FAN at a time, so a host with
a third of all pages is never in one task.

A wrapper then says which slots hold the main text: those below `article` or `main`, without what lies below menus, headers, footers,
sidebars, notices, adverts, forms and comments (by tag, or by a word of class, id or role). A page that has no such element takes the
container that holds most of its host's text outside links, without slots that always hold the same text or mostly links.

Defined results: a null or empty html gives an empty text; a null url or one without a host is of the host ''; rows of equal page_id are
rows of their own; a null page_id is kept; no rows make no rows. A comment, script or style without its end reaches to the end of the
page; `<` before anything but a tag is text. White space is what Unicode calls so (a decoded no-break space too). A line break is
white space. Elements nested deeper than DEPTH separate blocks, but have no slots of their own; nothing is dropped or capped. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, written

#: Wrappers merged by a task, hosts that a task holds, nesting with slots of its own, differently named children of an element.
FAN, HOSTS, DEPTH, WIDE = 64, 5000, 64, 64
#: Bytes of rules that are broadcast; hosts that may be joined by broadcast otherwise.
BROADCAST_BYTES, HOT_HOSTS, HOT_PAGES = 32 << 20, 10_000, 100_000
#: Least share of the text that a container must hold to be chosen; texts after which a slot that never changed is boilerplate.
SHARE, SAME = 0.7, 3

# Names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math meter output q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
RAW = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>|\Z", re.I) for name in "script style textarea title xmp iframe noembed noframes".split()}
BLOCKS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
IMPLIED = {name: frozenset({"p"}) for name in BLOCKS} | {
    "li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}), "option": frozenset({"option"}), "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"}),
    "tr": frozenset({"tr", "td", "th", "p"}), "thead": frozenset({"tr", "td", "th"}), "tbody": frozenset({"thead", "tbody", "tr", "td", "th"}), "tfoot": frozenset({"thead", "tbody", "tr", "td", "th"}), "body": frozenset({"head"}),
}
REGIONS = frozenset({"article", "main"})
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr td th pre blockquote figure #".split())
# What is never main text, by tag and by word of class, id and role.
NOISE_TAGS = frozenset("head nav header footer aside form menu dialog button select option datalist fieldset template noscript svg canvas object audio video".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner breadcrumb breadcrumbs byline comment comments consent contentinfo cookie cookies dialog disqus footer form gdpr header login masthead menu modal nav navbar navigation"
    " newsletter notice notices notification outbrain pager pagination paywall popup promo promoted promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe taboola"
    " toolbar widget widgets complementary search alert".split()
)
NEGATED = frozenset({"has", "with", "no", "without", "is", "not"})

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


@lru_cache(4096)
def symbol(tag: str, attributes: str) -> str:
    """The element's name in wrappers: tag, its first class of letters only, and ! if a word says that it is no main text."""
    plain, noise = "", False
    for kind, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        for token in value.split():
            words = re.findall("[a-z]+", token)
            noise |= any(w in NOISE_WORDS and (i == 0 or words[i - 1] not in NEGATED) for i, w in enumerate(words))
            if kind.lower() == "class" and not plain and re.fullmatch("[a-z]{3,}(-[a-z]{3,})*", token):
                plain = token
        if kind.lower() == "role" and value.strip() == "main" and tag not in INLINE:
            return "main"
    if tag in REGIONS or tag in ("html", "body"):
        return tag
    return tag + (f".{plain}" if plain else "") + ("!" if noise else "")


def events(page: str) -> Iterator[tuple[str, str, bool]]:
    """("open" | "close", name, whether it separates blocks), ("text", text, whether in a link) and ("break", "", True)."""
    stack: list[tuple[str, str]] = []
    count: dict[str, int] = {}
    at, links, size = 0, 0, len(page)

    def pop() -> tuple[str, str, bool]:
        tag, name = stack.pop()
        count[tag] -= 1
        return ("close", name, tag not in INLINE) if name else ("break", "", True)

    while at < size:
        m = _TOKEN.search(page, at)
        start = m.start() if m else size
        if start > at:
            text = page[at:start]
            yield "text", entities.unescape(text) if "&" in text else text, links > 0
        if m is None:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        end, attributes = m[1] or m[4], m[3] or m[6] or ""
        if tag == "br":
            yield "text", " ", False
        elif tag in RAW and not end:
            at = RAW[tag].search(page, at).end()
        elif tag in VOID:
            if tag == "hr":
                while stack and stack[-1][0] == "p":
                    yield pop()
                yield "break", "", True
        elif end:
            if tag in INLINE and tag == "a":
                links = max(0, links - 1)
            if count.get(tag):
                while stack[-1][0] != tag:
                    yield pop()
                yield pop()
            elif tag not in INLINE:
                yield "break", "", True
        else:
            name = symbol(tag, attributes if re.search("class|id|role", attributes, re.I) else "")
            if tag == "a":
                links += 1
            if tag in INLINE and not name.endswith("!"):
                continue
            closes = IMPLIED.get(tag, ())
            while stack and stack[-1][0] in closes:
                yield pop()
            deep = len(stack) >= DEPTH
            stack.append((tag, "" if deep else name))
            count[tag] = count.get(tag, 0) + 1
            yield ("break", "", True) if deep else ("open", name, tag not in INLINE)
    while stack:
        yield pop()


# Expressions. A leaf is [name, content, optional, repeated]: the content of a text "#" is what its slot held, [texts, characters, characters in
# links, smallest and largest hash]; that of an element is a list of leaves and groups. A group is ["*", leaves]: any number of any of them.


def leaves(content: list) -> Iterator[list]:
    for unit in content:
        if unit[0] == "*":
            yield from unit[1]
        else:
            yield unit


def merged_leaf(a: list, b: list) -> list:
    if a[0] == "#":
        (n, c, l, lo, hi), (m, d, k, low, high) = a[1], b[1]
        return ["#", [n + m, c + d, l + k, min(lo, low), max(hi, high)], a[2] or b[2], a[3] or b[3]]
    return [a[0], merged(a[1], b[1]), a[2] or b[2], a[3] or b[3]]


def group(units: list) -> list:
    """A repeated group of all leaves of the units, each optional."""
    members: dict[str, list] = {}
    for x in leaves(units):
        members[x[0]] = merged_leaf(members[x[0]], x) if x[0] in members else x
    return ["*", [[name, content, True, False] for name, content, _, _ in members.values()]]


def folded(children: list) -> list:
    """The content that a sequence of leaves makes: runs of a name are one repeated leaf; a span that begins and ends with a name, with
    others between, is a group."""
    runs: list = []
    for x in children:
        if runs and runs[-1][0] == x[0]:
            last = runs[-1]
            runs[-1] = [*merged_leaf(last, x)[:2], last[2] and x[2], True]
        else:
            runs.append(x)
    last = {x[0]: i for i, x in enumerate(runs)}
    if len(last) == len(runs):
        return narrowed(runs)
    out, i = [], 0
    while i < len(runs):
        j = end = i
        while j <= end:
            end = max(end, last[runs[j][0]])
            j += 1
        out.append(runs[i] if end == i else group(runs[i : end + 1]))
        i = end + 1
    return narrowed(out)


def optional(unit: list) -> list:
    return unit if unit[0] == "*" else [unit[0], unit[1], True, unit[3]]


def merged(a: list, b: list) -> list:
    """The alignment of two contents."""
    if len(a) == len(b) and all(x[0] == y[0] != "*" for x, y in zip(a, b, strict=True)):
        return [merged_leaf(x, y) for x, y in zip(a, b, strict=True)]
    where = {x[0]: j for j, unit in enumerate(b) for x in leaves([unit])}
    spans = []
    for unit in a:
        at = [where[x[0]] for x in leaves([unit]) if x[0] in where]
        spans.append((min(at), max(at)) if at else None)
    later = [len(b)] * (len(a) + 1)  # the first unit of b that the rest of a meets
    for i in range(len(a) - 1, -1, -1):
        later[i] = min(later[i + 1], spans[i][0]) if spans[i] else later[i + 1]
    out, i, j = [], 0, 0
    while i < len(a):
        if spans[i] is None:
            out.append(optional(a[i]))
            i += 1
            continue
        end, (lo, hi) = i, spans[i]
        while later[end + 1] <= hi:  # what follows meets the same units or earlier ones: no order holds for both
            end += 1
            if spans[end]:
                lo, hi = min(lo, spans[end][0]), max(hi, spans[end][1])
        out += map(optional, b[j:lo])
        left, right = a[i : end + 1], b[lo : hi + 1]
        out.append(merged_leaf(left[0], right[0]) if len(left) == len(right) == 1 and "*" not in (left[0][0], right[0][0]) else group(left + right))
        i, j = end + 1, hi + 1
    return narrowed(out + [optional(x) for x in b[j:]])


def narrowed(content: list) -> list:
    """Of more than WIDE children, those that no word marks lose their class, so that generated class names don't let wrappers grow."""
    every = list(leaves(content))
    if len(every) <= WIDE or len({x[0] for x in every if x[0].endswith("!") or "." not in x[0]}) == len(every):
        return content
    bare = [[x[0] if x[0].endswith("!") else x[0].partition(".")[0], x[1], x[2], x[3]] for x in every]
    return [group(bare)] if any(unit[0] == "*" for unit in content) else folded(bare)


def expression(page: str) -> list:
    """The page's own expression: the content of its root."""
    names, contents = [], [[]]
    for kind, value, flag in events(page):
        if kind == "text":
            text = " ".join(value.split())
            if text:
                h = zlib.crc32(text.encode("utf-8", "surrogatepass"))
                contents[-1].append(["#", [1, len(text), len(text) * flag, h, h], False, False])
        elif kind == "open":
            names.append(value)
            contents.append([])
        elif kind == "close":
            content = folded(contents.pop())
            contents[-1].append([names.pop(), content, False, False])
    return folded(contents[0])


def pattern(content: list) -> str:
    """The expression as text."""
    out = []
    for unit in content:
        if unit[0] == "*":
            out.append("(" + "".join(pattern([x]) for x in unit[1]) + ")*")
            continue
        name, inner, opt, many = unit
        body = "#" if name == "#" else f"<{name}>{pattern(inner)}</{name.partition('.')[0].rstrip('!')}>"
        out.append(f"({body}){'*' if opt else '+'}" if many else f"({body})?" if opt else body)
    return "".join(out)


def rule(content: list) -> dict:
    """Which slots of a wrapper hold main text: a tree of names with flags `m` (1: below an article, 2: otherwise) and `r` (an article)."""

    def weigh(content: list) -> int:
        """Characters outside links, noise and articles."""
        return sum(x[1][1] - x[1][2] if x[0] == "#" else 0 if _noise(x[0]) or x[0] in REGIONS else weigh(x[1]) for x in leaves(content))

    def changing(content: list) -> bool:
        return any(_varies(x[1]) if x[0] == "#" else not _noise(x[0]) and x[0] not in REGIONS and changing(x[1]) for x in leaves(content))

    def build(content: list, inside: int, strict: bool) -> dict:
        node: dict = {}
        for name, inner, _, _ in leaves(content):
            if name == "#":
                if inside == 1 or inside == 2 and 2 * inner[2] <= inner[1] and (_varies(inner) or not strict):
                    node["m"] = inside
            elif not _noise(name):
                at = 1 if name in REGIONS or inside == 1 else 2 if inside == 2 or id(inner) == chosen else 0
                child = build(inner, at, strict)
                if name in REGIONS:
                    child["r"] = 1
                node.setdefault("c", {})[name] = child
        return node

    best = content
    while True:
        inner = [x for x in leaves(best) if x[0] not in FLOW and x[0] not in REGIONS and not _noise(x[0])]
        top = max(inner, key=lambda x: weigh(x[1]), default=None)
        if top is None or not weigh(top[1]) or weigh(top[1]) < SHARE * weigh(best):
            break
        best = top[1]
    chosen = id(best)
    return build(content, 2 if best is content else 0, changing(best))


def _noise(name: str) -> bool:
    return name.endswith("!") or name.partition(".")[0] in NOISE_TAGS


def _varies(slot: list) -> bool:
    return slot[3] != slot[4] or slot[0] < SAME


def main_text(page: str, tree: dict) -> str:
    """The page's main text by its host's rule, blocks joined by line ends."""
    found: dict[int, list[str]] = {1: [], 2: []}
    stack, part, region = [tree], [], False

    def flush() -> None:
        kind = {1: "", 2: ""}
        for m, text in part:
            kind[m] += text
        part.clear()
        for m, text in kind.items():
            if line := " ".join(text.split()):
                found[m].append(line)

    for event, value, flag in events(page):
        if event == "text":
            if m := stack[-1].get("m"):
                part.append((m, value))
            continue
        if flag:
            flush()
        if event == "open":
            children = stack[-1].get("c", {})
            stack.append(children.get(value) or children.get(value.partition(".")[0]) or {})
            region |= "r" in stack[-1]
        elif event == "close":
            stack.pop()
    flush()
    return "\n".join(found[1] if region else found[2])


def keyed(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    host = F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    return pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), F.coalesce(host, F.lit("")).alias("host"))


def infer(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """host, n_pages and its wrapper (JSON; `pattern` gives it as text) of every host."""
    small_batches(pages.sparkSession)
    rows = keyed(pages, page_id, url, html).select("host", "html").filter("html <> ''")
    schema = "host string, task bigint, n_pages bigint, wrapper string"
    arrow = pa.schema([("host", pa.string()), ("task", pa.int64()), ("n_pages", pa.int64()), ("wrapper", pa.string())])

    def out(held: dict, task: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"host": h, "task": task, "n_pages": n, "wrapper": json.dumps(w, separators=(",", ":"))} for h, (n, w) in sorted(held.items())], schema=arrow)

    def of_task(batches):
        from pyspark import TaskContext

        task, held = TaskContext.get().partitionId(), {}
        for batch in batches:
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
                n, w = held.get(host, (0, None))
                own = expression(page.as_py())
                held[host] = (n + 1, own if w is None else merged(w, own))
            if len(held) > HOSTS:
                yield out(held, task)
                held = {}
        if held:
            yield out(held, task)

    def of_group(part: pa.Table) -> pa.Table:
        n, w, first = 0, None, part.sort_by([("task", "ascending"), ("wrapper", "ascending")])
        for row in first.to_pylist():
            n, own = n + row["n_pages"], json.loads(row["wrapper"])
            w = own if w is None else merged(w, own)
        return pa.Table.from_batches([out({row["host"]: (n, w)}, row["task"] // FAN)])

    found = rows.mapInArrow(of_task, schema)
    tasks = rows.rdd.getNumPartitions()
    while True:
        tasks = -(-tasks // FAN)
        found = written(found.groupBy("host", F.floor(F.col("task") / FAN)).applyInArrow(of_group, schema), "wrappers")
        if tasks <= 1:
            return found.select("host", "n_pages", "wrapper")


def extract(pages: DataFrame, wrappers: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row, by the wrappers of the hosts."""
    small_batches(pages.sparkSession)

    def rules_of(batches):
        for batch in batches:
            found = [json.dumps(rule(json.loads(w)), separators=(",", ":")) for w in batch.column("wrapper").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("n_pages"), pa.array(found, pa.string())], names=["host", "n_pages", "rule"])

    rules = written(wrappers.mapInArrow(rules_of, "host string, n_pages bigint, rule string"), "rules")
    size, total = rules.agg(F.coalesce(F.sum(F.length("rule") + F.length("host")), F.lit(0)), F.coalesce(F.sum("n_pages"), F.lit(0))).first()
    rows, plain = keyed(pages, page_id, url, html), rules.drop("n_pages")
    if size <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(plain), "host", "left")
    else:
        # the few hosts with very many pages stay where they are; no other host has many rows to shuffle
        many = F.col("n_pages") > max(HOT_PAGES, total // HOT_HOSTS)
        hot = rules.filter(many & (F.length("rule") <= BROADCAST_BYTES // HOT_HOSTS)).drop("n_pages")
        first = rows.join(F.broadcast(hot), "host", "left")
        joined = first.filter("rule IS NOT NULL").unionByName(first.filter("rule IS NULL").drop("rule").join(plain.hint("shuffle_hash"), "host", "left"))
    arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        trees: dict[str, dict] = {}
        for batch in batches:
            texts = []
            for page, found in zip(batch.column("html"), batch.column("rule").to_pylist(), strict=True):
                if found and found not in trees:
                    if len(trees) > HOSTS:
                        trees.clear()
                    trees[found] = json.loads(found)
                texts.append(main_text(page.as_py() or "", trees[found]) if found else "")
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=arrow)

    return joined.select("page_id", "url", "html", "rule").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, infer(pages))
