"""Secret scan with a trigram inverted index, in DataFrame operations only.

From each rule's regular expression a Boolean query is derived: alternatives, each a set of trigrams that a match
must contain. Postings (trigram, doc_id) are built for the trigrams of all queries; intersecting them gives the
candidates of each rule, and only these are verified with the regular expression. A rule with an alternative
that has no mandatory trigram is verified on every document.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _parser as parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkflow.llm.common import BROADCAST_KEYS, cut, table, text_hash


@dataclass(frozen=True)
class Rule:
    """``regex``: for Java's engine. A match counts if group ``group`` has ``least`` characters or more; ``base`` rules come first."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0
    base: bool = True


#: Fixed patterns. The first three are the base; hexadecimal runs have no mandatory trigram.
RULES = (
    Rule("assign", "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", "[0-9a-f]+", 0, 32),
    Rule("github", "gh[oprsu]_[A-Za-z0-9]{36,}", base=False),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", base=False),
    Rule("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", base=False),
)
MASK = "[SECRET]"
#: Matches of a text that one fold goes over; a text with more is taken in pieces of so many.
PIECE = 512


def trigram_query(regex: str, most: int = 256) -> list[frozenset[str]] | None:
    """Alternatives of lower-case trigrams of which every match has one whole; None if a match may have none."""
    alternatives = _walk(parser.parse(regex), [("", frozenset())], most)
    sets = {grams | _grams(run) for run, grams in alternatives}
    if not all(sets):
        return None
    return sorted((s for s in sets if not any(t < s for t in sets)), key=sorted)


def _grams(run: str) -> frozenset[str]:
    return frozenset(run[i : i + 3] for i in range(len(run) - 2))


def _ended(paths):
    return list({("", grams | _grams(run)) for run, grams in paths})


def _walk(items, paths, most):
    """Extends each path, the literal run at its end and the trigrams before that, by what ``items`` may match."""
    for op, arg in items:
        name = str(op)
        if name == "LITERAL" and arg < 128:
            paths = [(run + chr(arg).lower(), grams) for run, grams in paths]
        elif name == "IN" and len(arg) <= 8 and all(str(o) == "LITERAL" and v < 128 for o, v in arg):
            paths = [(run + c, grams) for run, grams in paths for c in dict.fromkeys(chr(v).lower() for _, v in arg)]
        elif name == "SUBPATTERN":
            paths = _walk(arg[3], paths, most)
        elif name == "BRANCH":
            paths = [p for branch in arg[1] for p in _walk(branch, paths, most)]
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[:2] == (0, 1):
            paths = paths + _walk(arg[2], paths, most)
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            for _ in range(min(arg[0], 40)):
                paths = _walk(arg[2], paths, most)
            paths = paths if arg[0] == arg[1] <= 40 else _ended(paths)
        elif name != "AT":
            paths = _ended(paths)
        if len(paths) > most:
            paths = _ended(paths)
            if len(paths) > most:  # too many to follow: nothing is held to be mandatory
                paths = [("", frozenset())]
    return paths


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index: (trigram, doc_id, text_hash) for each of ``trigrams`` in each lower-cased text."""
    lowered = docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"), F.lower("text").alias("text"))
    held = F.array_compact(F.array(*[F.when(F.contains("text", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)]))
    return lowered.select(F.explode(held).alias("trigram"), "doc_id", "text_hash")


def candidates(index: DataFrame, trigrams: list[str], rules: list[tuple[str, list[frozenset[str]]]]) -> DataFrame:
    """(doc_id, text_hash, one Boolean per rule): the intersected postings, united over a rule's alternatives."""
    at = {t: i for i, t in enumerate(trigrams)}
    held = index.groupBy("doc_id", "text_hash").agg(F.collect_set("trigram").alias("held"))

    def one(need: frozenset[str]) -> Column:
        return F.size(F.array_except(F.array(*[F.lit(at[t]) for t in sorted(need)]), "held")) == 0

    flags = {kind: F.exists(F.array(*map(one, query)), lambda x: x) for kind, query in rules}
    found = held.select("doc_id", "text_hash", *[c.alias(k) for k, c in flags.items()])
    return found.where(F.exists(F.array(*[F.col(k) for k in flags]), lambda x: x))


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is named there."""
    return F.transform(F.array(value), use)[0]


def matches(text: Column, rule: Rule, place: int) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, place, kind, end>>, in code points, end exclusive.

    Lengths of the gaps between matches and of the matches are added up piece by piece, so a text with very many of them costs
    in proportion to their number.
    """
    regex = F.lit(rule.regex)
    kind = "array<struct<start:int,place:int,kind:string,end:int>>"
    parts = F.arrays_zip(F.split(text, rule.regex, -1).alias("gap"), F.regexp_extract_all(text, regex, F.lit(0)).alias("hit"), F.regexp_extract_all(text, regex, F.lit(rule.group)).alias("part"))
    length = lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda n, x: n + length(x))

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), F.lit(place).alias("place"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        return F.when(x["hit"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.when(F.length(x["part"]) >= rule.least, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out")))

    def piece(xs, before):
        start = F.struct(F.aggregate(before, F.lit(0), lambda n, x: n + x).alias("at"), F.array().cast(kind).alias("out"))
        return F.aggregate(xs, start, step, lambda acc: acc["out"])

    cut = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / PIECE).cast("int")), lambda i: F.slice(p, i * PIECE + 1, F.lit(PIECE)))
    summed = lambda ps: F.struct(ps.alias("pieces"), F.transform(ps, total).alias("totals"))
    spans = lambda z: F.flatten(F.transform(z["pieces"], lambda xs, i: piece(xs, F.slice(z["totals"], F.lit(1), i))))
    return F.when(F.regexp_like(text, regex), once(once(once(parts, cut), summed), spans)).otherwise(F.array().cast(kind))


def quick(rule: Rule) -> Rule:
    """Runs of one class that are too short never overlap a longer one, so they need not be found at all."""
    tail = {"access": ("[A-Z0-9]+", 12), "hex": ("[0-9a-f]+", 32)}.get(rule.kind)
    return Rule(rule.kind, rule.regex.replace(tail[0], f"{tail[0][:-1]}{{{tail[1]},}}"), base=rule.base) if tail and rule.least else rule


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc, spans) per document: ``doc`` holds the document's own columns, ``spans`` its matches by start, then rule.

    Null and empty texts have no spans; texts of any length are scanned whole; matches of equal start come in the order of the
    rules. A row is known to the index by its doc_id and text; rows alike in both share their postings. Columns of any other name
    pass through unread. An empty table gives an empty result.
    """
    queries = {r.kind: trigram_query(r.regex) for r in rules}
    sieved = [(k, q) for k, q in queries.items() if q]
    trigrams = sorted({t for _, q in sieved for s in q for t in s})
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), text_hash(F.col("text")).alias("_text"))
    if sieved:
        c = candidates(postings(docs, trigrams), trigrams, sieved)
        c = cut(c.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.struct(*[F.col(k) for k, _ in sieved]).alias("may")))
        # Few texts are candidates; their flags go to the texts as long as they are known to be few, else both are shuffled.
        c = F.broadcast(c) if c.count() <= BROADCAST_KEYS else c.hint("shuffle_hash")
        d = d.join(c, d["doc"]["doc_id"].eqNullSafe(c["_id"]) & (d["_text"] == c["_hash"]), "left")
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    none = F.array().cast("array<struct<start:int,place:int,kind:string,end:int>>")
    found = [matches(text, quick(r), i) if queries[r.kind] is None else F.when(F.col("may")[r.kind], matches(text, quick(r), i)).otherwise(none) for i, r in enumerate(rules)]
    return d.select("doc", F.array_sort(F.concat(*found)).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with every stretch that spans cover replaced by one mask; a span that overlaps the last one joins it."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        apart = (s["start"] >= acc["at"]) & ((s["start"] > acc["at"]) | (acc["at"] == 0))
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(MASK))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(apart, more).otherwise(acc["out"]).alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every secret masked, with their own columns; n_chars, where it is there, follows the text.

    Null and empty texts, and those without a secret, stay as they are; texts of any length are masked whole; rows that repeat are
    masked alike; spans that touch or overlap get one mask. An empty table gives an empty result.
    """
    s = scan(docs)
    hit = F.size("spans") > 0
    text = F.when(hit, masked(F.col("doc.text"), F.col("spans"))).otherwise(F.col("doc.text"))
    s = s.select("doc", text.alias("masked"), hit.alias("hit"))
    own = {"text": F.col("masked")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.col("hit"), F.length("masked").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc.n_chars"))
    return s.select(*[own.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [r.kind for r in RULES if r.base]
    spelled = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of_kind = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    own = F.filter("spans", lambda x: x["place"] < len(base))
    return s.select("doc.doc_id", *[of_kind(k).alias(f"n_{k}") for k in base], F.sha2(spelled(own), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))


def _sql_spans(kind: str, place: int, regex: str, group: int, least: int) -> str:
    """Spans of one rule in DuckDB: the gaps between matches and the matches, added up."""
    quoted = regex.replace("'", "''")
    return f"""list_filter(list_transform(range(1, len(h_{kind}) + 1), lambda i: {{
        'start': list_sum(list_transform(g_{kind}[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(h_{kind}[1:i - 1], lambda x: len(x))), 0), 'place': {place}, 'kind': '{kind}',
        'stop': list_sum(list_transform(g_{kind}[1:i], lambda x: len(x))) + list_sum(list_transform(h_{kind}[1:i], lambda x: len(x))),
        'size': len(regexp_extract_all(h_{kind}[i], '{quoted}', {group})[1])}}), lambda y: y.size >= {least})"""


def _sql() -> str:
    """All rules, each over every text: no index, so that the index is checked too. Letters of either case are spelled out."""
    either = lambda r: r.replace("(?i:password|passwd|secret|token|api_?key)", "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")))
    quote = lambda r: either(r).replace("'", "''")
    split = ", ".join(f"string_split_regex(t, '{quote(r.regex)}') AS g_{r.kind}, regexp_extract_all(t, '{quote(r.regex)}') AS h_{r.kind}" for r in RULES)
    spans = " || ".join(_sql_spans(r.kind, i, either(r.regex), r.group, r.least) for i, r in enumerate(RULES))
    text = lambda x: f"array_to_string(list_transform({x}, lambda y: y.kind || ':' || y.start::BIGINT || ':' || y.stop::BIGINT), ',')"
    base = [r.kind for r in RULES if r.base]
    counts = ", ".join(f"len(list_filter(s, lambda x: x.kind = '{k}'))::BIGINT AS n_{k}" for k in base)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
cut AS (SELECT doc_id, {split} FROM d),
spans AS (SELECT doc_id, list_sort({spans}) AS s FROM cut)
SELECT doc_id, {counts}, sha256({text(f"list_filter(s, lambda x: x.place < {len(base)})")}) AS base_sha256, {text("s")} AS spans FROM spans
"""


OP2_SQL = _sql()
