"""URL filters by a path-template tree.

Paths are first written by shape (segments with digits or hexadecimal runs by what they are made of) and summed per host, so a host of any
size becomes a list of its distinct shapes. Then the tree is built level by level: the rare children of a node that has many
are generalised to a wildcard; labelled sibling branches whose labels are statistically alike are merged. A
template is rejected if the share of blocked pages among its labelled ones reaches a limit, smoothed towards what
is known of the same wildcard path elsewhere: on the hosts of the registered domain, and these towards all hosts, where
each host that has labelled pages of the path counts once; without any the prior is even. Labels come from rules of hosts and
paths, which also overrule the templates where they fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkflow.llm.common import cut, table

#: Fixed rules: host and path prefix, and the verdict.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Children of a node from which it is generalised; levels after which shapes that are alone below their node are finished at once.
MANY, LEVELS = 12, 6
#: Pseudo-pages that smooth a template, pseudo-hosts that smooth a domain and all hosts, the share of blocked ones that rejects, and the z
#: score up to which branches are alike.
PRIOR, HOSTS, REJECT, ALIKE = 8.0, 2.0, 0.9, 1.96
#: Pages from which a branch is frequent: so many, all blocked, reach REJECT against the prior.
RARE = 32
WILD = "*"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null and without ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "^[\\s\\S]*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "^[\\s\\S]*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule whose host is the host or above it and whose path begins the path; else null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + start))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def shape(path: Column) -> Column:
    """Segments of the path; those with digits by what they are made of: number, hexadecimal, mixed; file endings stay."""
    def one(s):
        stem, ending = F.regexp_replace(s, "\\.[A-Za-z]{1,5}$", ""), F.regexp_extract(s, "(\\.[A-Za-z]{1,5})$", 1)
        kind = F.when(F.rlike(stem, F.lit("^[0-9]+$")), F.lit("<n>")).when(F.rlike(stem, F.lit("^(?=.*[0-9])[0-9a-fA-F-]{8,}$")), F.lit("<x>")).when(F.rlike(stem, F.lit("[0-9]")), F.lit("<m>")).otherwise(stem)
        return F.concat(kind, ending)

    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), one)


def domain_of(host: Column) -> Column:
    """The last two labels of the host."""
    return F.regexp_extract(host, "([^.]*\\.?[^.]*)$", 1)


def templates(shapes: DataFrame, many: int = MANY, levels: int = LEVELS) -> DataFrame:
    """``shapes(host, segments, n, bad, good)`` with ``template``, the segments as the tree of their host has them, and ``wild``, with its wildcards alone."""
    t = shapes.withColumns({"template": F.array().cast("array<string>"), "wild": F.array().cast("array<string>")})
    level = 0
    while not t.where(F.size("segments") > F.size("template")).isEmpty():
        if level >= levels:
            t = _finished(t, level)
        here = F.when(F.size("template") == level, F.get("segments", F.lit(level)))
        child = t.where(here.isNotNull()).groupBy("host", "template", here.alias("segment")).agg(
            F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("good").alias("good"),
            F.avg(F.size("segments") - level).alias("depth"), F.max(F.get("segments", F.lit(level + 1)).isNull()).alias("leaf"))
        # Sums of a node are made before its children meet them, so that a node of any width is no task of its own.
        node = child.groupBy("host", "template").agg(F.count(F.lit(1)).alias("children"), F.sum("bad").alias("all_bad"), F.sum(F.col("bad") + F.col("good")).alias("all"))
        child = child.join(node, ["host", "template"])
        # Two-sample z score of a branch's blocked share against that of its siblings together.
        own, rest = F.col("bad") + F.col("good"), F.col("all") - F.col("bad") - F.col("good")
        pooled = (F.col("all_bad") + 1) / (F.col("all") + 2)
        z = F.abs((F.col("bad") + pooled) / (own + 1) - (F.col("all_bad") - F.col("bad") + pooled) / (rest + 1)) / F.sqrt(pooled * (1 - pooled) * (1 / (own + 1) + 1 / (rest + 1)))
        # Frequent branches of a wide node stay: from RARE pages on, one could be rejected by itself.
        variable = (F.col("children") > many) & (F.col("n") < RARE)
        # Labelled branches that are alike in labels and shape (same depth, leaf or not) form one class below the node; without labels each stays.
        merged = F.concat(F.lit("{l"), F.round("depth").cast("string"), F.when(F.col("leaf"), F.lit("$")).otherwise(F.lit("")), F.lit("}"))
        name = F.when(variable, F.lit(WILD)).when((F.col("children") > 1) & (z <= ALIKE) & (own > 0), merged).otherwise(F.col("segment"))
        named = child.select(F.col("host").alias("_host"), F.col("template").alias("_template"), F.col("segment").alias("_segment"), name.alias("name"))
        t = t.join(named, (F.col("host") == F.col("_host")) & (F.col("template") == F.col("_template")) & (here == F.col("_segment")), "left")
        longer = lambda c, x: F.when(F.col("name").isNotNull(), F.array_append(c, x)).otherwise(F.col(c)).alias(c)
        t = cut(t.select("host", "segments", "n", "bad", "good", longer("template", F.col("name")), longer("wild", F.when(F.col("name") == WILD, F.col("name")).otherwise(F.col("_segment")))))
        level += 1
    return t


def _finished(t: DataFrame, level: int) -> DataFrame:
    """Shapes that are the only one to go on below their node have no siblings at any level to come: each segment is a node."""
    going = F.size("segments") > F.size("template")
    alone = t.where(going).groupBy("host", "template").count().where("count = 1").select(F.col("host").alias("_host"), F.col("template").alias("_template"))
    t = t.join(alone, going & (F.col("host") == F.col("_host")) & (F.col("template") == F.col("_template")), "left")
    rest = lambda c: F.when(F.col("_host").isNotNull(), F.concat(c, F.slice("segments", level + 1, F.size("segments")))).otherwise(F.col(c)).alias(c)
    return cut(t.select("host", "segments", "n", "bad", "good", rest("template"), rest("wild")))


def purities(t: DataFrame) -> DataFrame:
    """``templates`` with ``purity``: the smoothed share of blocked pages of the template, backed off to domain and all hosts."""
    t = t.withColumn("domain", domain_of(F.col("host")))
    own = t.groupBy("host", "template").agg(F.sum("bad").alias("own_bad"), F.sum(F.col("bad") + F.col("good")).alias("own"))
    hosts = t.groupBy("host", "domain", "wild").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where("bad <> good")
    domain = hosts.groupBy("domain", "wild").agg(F.count(F.when(F.col("bad") > F.col("good"), 1)).alias("domain_bad"), F.count(F.lit(1)).alias("domain_hosts"))
    domain = cut(domain)
    everywhere = domain.groupBy("wild").agg(F.sum("domain_bad").alias("all_bad"), F.sum("domain_hosts").alias("all_hosts"))
    t = t.join(own, ["host", "template"]).join(domain, ["domain", "wild"], "left").join(everywhere, ["wild"], "left")
    t = t.fillna(0, ["domain_bad", "domain_hosts", "all_bad", "all_hosts"])
    of_all = (F.col("all_bad") + HOSTS / 2) / (F.col("all_hosts") + HOSTS)
    of_domain = (F.col("domain_bad") + HOSTS * of_all) / (F.col("domain_hosts") + HOSTS)
    return t.select("host", "segments", "template", ((F.col("own_bad") + PRIOR * of_domain) / (F.col("own") + PRIOR)).alias("purity"))


def filter_urls(pages: DataFrame, rules=RULES, labels: DataFrame | None = None) -> DataFrame:
    """One row per row of ``pages(page_id, url)``: page_id, host, path, rule, verdict, template, purity.

    A null url, or one without ://, has an empty host and path; it is judged by its template like any other. Where no rule
    fits, the verdict is block if the template's smoothed purity reaches REJECT, else allow. Hosts of which as many pages
    of a path are blocked as allowed say nothing to others. ``labels(page_id, bad)`` adds labelled pages to those that rules
    fit; rows without an id or a value, and all but the worst of an id, are left out. Urls of any length are read whole and
    paths of any depth have a node for each segment. Repeated rows are judged alike. Other columns are not read; an empty table gives an empty result.
    """
    verdicts = dict(rules)
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    p = p.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    ruled = F.lit(None).cast("string")
    for rule, verdict in verdicts.items():
        ruled = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(ruled)
    p = p.withColumns({"ruled": ruled, "segments": shape(F.col("path")), "bad": F.lit(None).cast("int")})
    if labels is not None:
        known = labels.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").cast("int").alias("bad"))
        p = p.drop("bad").join(known, "page_id", "left")
    p = cut(p.withColumn("marked", F.coalesce((F.col("ruled") == "block").cast("int"), F.col("bad"))).drop("bad"))
    shapes = p.groupBy("host", "segments").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("marked") == 1, 1)).alias("bad"), F.count(F.when(F.col("marked") == 0, 1)).alias("good"))
    out = p.join(purities(templates(shapes)), ["host", "segments"], "left")
    verdict = F.coalesce("ruled", F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity")


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


#: Levels of the tree that the SQL spells out.
SQL_LEVELS = 8


def _sql() -> str:
    """The same in SQL, a few relations per level of the tree; as many levels as paths are deep, SQL_LEVELS at most."""
    af, aa = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host, rules = f"translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), '{af}', '{aa}')", sorted(RULES, key=lambda r: -len(r[0]))
    fits = lambda r: f"(host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}')"
    rule, ruled = " ".join(f"WHEN {fits(r)} THEN '{r}'" for r, _ in rules), " ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in rules)
    stem, ending = "regexp_replace(s, '\\.[A-Za-z]{1,5}$', '')", "regexp_extract(s, '(\\.[A-Za-z]{1,5})$', 1)"
    kind = f"CASE WHEN regexp_full_match({stem}, '[0-9]+') THEN '<n>' WHEN regexp_full_match({stem}, '[0-9a-fA-F-]{{8,}}') AND regexp_matches({stem}, '[0-9]') THEN '<x>' WHEN regexp_matches({stem}, '[0-9]') THEN '<m>' ELSE {stem} END || {ending}"
    out = [
        f"p0 AS (SELECT page_id, {host} AS host, regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages)",
        f"p1 AS (SELECT *, CASE {rule} END AS rule FROM p0)",
        f"p AS (SELECT *, CASE {ruled} END AS ruled, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: {kind}) AS segments FROM p1)",
        "t0 AS (SELECT host, segments, count(*) AS n, count(*) FILTER (ruled = 'block') AS bad, count(*) FILTER (ruled = 'allow') AS good, []::VARCHAR[] AS template, []::VARCHAR[] AS wild FROM p GROUP BY host, segments)",
    ]
    for k in range(SQL_LEVELS):
        pooled, own, rest = "((all_bad + 1) / (al + 2)::DOUBLE)", "(bad + good)", "(al - bad - good)"
        z = f"abs((bad + {pooled}) / ({own} + 1) - (all_bad - bad + {pooled}) / ({rest} + 1)) / sqrt({pooled} * (1 - {pooled}) * (1 / ({own} + 1)::DOUBLE + 1 / ({rest} + 1)::DOUBLE))"
        merged = "'{l' || round(depth, 0)::DOUBLE::VARCHAR || CASE WHEN leaf THEN '$' ELSE '' END || '}'"
        out += [
            f"c{k} AS (SELECT host, template, segments[{k + 1}] AS segment, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad, sum(good)::BIGINT AS good, avg(len(segments) - {k}) AS depth, bool_or(segments[{k + 2}] IS NULL) AS leaf FROM t{k} WHERE len(segments) > {k} GROUP BY ALL)",
            f"s{k} AS (SELECT *, count(*) OVER w AS children, (sum(bad) OVER w)::BIGINT AS all_bad, (sum(bad + good) OVER w)::BIGINT AS al FROM c{k} WINDOW w AS (PARTITION BY host, template))",
            f"n{k} AS (SELECT host, template, segment, CASE WHEN children > {MANY} AND n < {RARE} THEN '{WILD}' WHEN children > 1 AND bad + good > 0 AND {z} <= {ALIKE}::DOUBLE THEN {merged} ELSE segment END AS name FROM s{k})",
            f"t{k + 1} AS (SELECT t.host, t.segments, t.n, t.bad, t.good, CASE WHEN name IS NOT NULL THEN list_append(t.template, name) ELSE t.template END AS template, CASE WHEN name IS NOT NULL THEN list_append(t.wild, CASE WHEN name = '{WILD}' THEN name ELSE t.segments[{k + 1}] END) ELSE t.wild END AS wild FROM t{k} t LEFT JOIN n{k} m ON t.host = m.host AND t.template = m.template AND t.segments[{k + 1}] = m.segment)",
        ]
    out += [
        f"t AS (SELECT host, regexp_extract(host, '([^.]*\\.?[^.]*)$', 1) AS domain, segments, bad, good, template, wild FROM t{SQL_LEVELS})",
        "u AS (SELECT host, template, sum(bad)::BIGINT AS own_bad, sum(bad + good)::BIGINT AS own FROM t GROUP BY host, template)",
        "h AS (SELECT host, domain, wild, sum(bad) AS b, sum(good) AS g FROM t GROUP BY ALL HAVING sum(bad) <> sum(good))",
        "e AS (SELECT domain, wild, count(*) FILTER (b > g) AS db, count(*) AS dn FROM h GROUP BY ALL)",
        "a AS (SELECT wild, sum(db)::BIGINT AS ab, sum(dn)::BIGINT AS an FROM e GROUP BY ALL)",
        f"v AS (SELECT t.host, segments, t.template, (own_bad + {PRIOR}::DOUBLE * ((coalesce(db, 0) + {HOSTS}::DOUBLE * ((coalesce(ab, 0) + {HOSTS / 2}::DOUBLE) / (coalesce(an, 0) + {HOSTS}::DOUBLE))) / (coalesce(dn, 0) + {HOSTS}::DOUBLE))) / (own + {PRIOR}::DOUBLE) AS purity FROM t JOIN u ON t.host = u.host AND t.template = u.template LEFT JOIN e ON t.domain = e.domain AND t.wild = e.wild LEFT JOIN a ON t.wild = a.wild)",
    ]
    last = f"SELECT page_id, p.host, path, rule, coalesce(ruled, CASE WHEN purity >= {REJECT}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict, '/' || array_to_string(v.template, '/') AS template, purity FROM p JOIN v ON p.host = v.host AND p.segments = v.segments"
    return "WITH " + ",\n".join(out) + "\n" + last


OP1_SQL = _sql()
