"""The path-template tree against plain Python, and what it decides."""

import math
import re
from collections import Counter, defaultdict

from inkflow.llm import urls

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def plain(pages):
    """page_id -> (verdict, rule, purity), level by level over whole tables held in memory."""
    read = {}
    for i, url in pages:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
        fits = [r for r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        rule = max(fits, key=len) if fits else None
        segments = []
        for s in filter(None, path.split("/")):
            ending = (re.search(r"\.[A-Za-z]{1,5}$", s) or [""])[0]
            stem = s[: len(s) - len(ending)]
            kind = "<n>" if re.fullmatch("[0-9]+", stem) else "<x>" if re.fullmatch("[0-9a-fA-F-]{8,}", stem) and re.search("[0-9]", stem) else "<m>" if re.search("[0-9]", stem) else stem
            segments.append(kind + ending)
        read[i] = host, tuple(segments), rule
    n, bad, good = Counter(), Counter(), Counter()
    for host, segments, rule in read.values():
        n[host, segments] += 1
        bad[host, segments] += rule is not None and RULES[rule] == "block"
        good[host, segments] += rule is not None and RULES[rule] == "allow"
    template, wild = {k: () for k in n}, {k: () for k in n}
    for level in range(max((len(k[1]) for k in n), default=0)):
        nodes = defaultdict(lambda: defaultdict(list))
        for k in n:
            if len(k[1]) > level:
                nodes[k[0], template[k]][k[1][level]].append(k)
        for children in nodes.values():
            total = {s: (sum(n[k] for k in ks), sum(bad[k] for k in ks), sum(good[k] for k in ks)) for s, ks in children.items()}
            all_bad, everything = sum(b for _, b, _ in total.values()), sum(b + g for _, b, g in total.values())
            for s, ks in children.items():
                pages_, b, g = total[s]
                own, rest, pooled = b + g, everything - b - g, (all_bad + 1) / (everything + 2)
                z = abs((b + pooled) / (own + 1) - (all_bad - b + pooled) / (rest + 1)) / math.sqrt(pooled * (1 - pooled) * (1 / (own + 1) + 1 / (rest + 1)))
                depth = sum(len(k[1]) - level for k in ks) / len(ks)
                name = s
                if len(children) > 12 and pages_ < 32:
                    name = "*"
                elif len(children) > 1 and own and z <= 1.96:
                    name = f"{{l{math.floor(depth + 0.5)}{'$' if any(len(k[1]) == level + 1 for k in ks) else ''}}}"
                for k in ks:
                    template[k], wild[k] = (*template[k], name), (*wild[k], "*" if name == "*" else s)
    own, host = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for k in n:
        for t in (own[k[0], template[k]], host[k[0], wild[k]]):
            t[0] += bad[k]
            t[1] += good[k]
    domain = lambda h: ".".join(h.split(".")[-2:])
    near, far = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for (h, w), (b, g) in host.items():
        if b != g:
            for t in (near[domain(h), w], far[w]):
                t[0] += b > g
                t[1] += 1
    out = {}
    for i, (h, segments, rule) in read.items():
        k = h, segments
        (b, g), (db, dn), (ab, an) = own[h, template[k]], near[domain(h), wild[k]], far[wild[k]]
        purity = (b + 8 * ((db + 2 * ((ab + 1) / (an + 2))) / (dn + 2))) / (b + g + 8)
        out[i] = RULES[rule] if rule else "block" if purity >= 0.9 else "allow", rule, round(purity, 9)
    return out


def test_tree(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    pages = spark.read.parquet(f"{big}/pages.parquet").select("page_id", "url").collect()
    got = {r["page_id"]: (r["verdict"], r["rule"], round(r["purity"], 9)) for r in urls.op1_urls(spark, big).collect()}
    assert got == plain([tuple(r) for r in pages])


def test_a_made_up_site(spark):
    given = [f"http://h{i % 9}.example.{'net' if i % 2 else 'org'}/{s}/{'a/' * (i % 9)}{i if i % 3 else 'x' * (i % 20)}" for i in range(600) for s in ("de", f"s{i % 15}", "wiki/" + "abcdefghijklmnopqrstuvwxyz"[i % 26])]
    pages = list(enumerate([*given, None, "none", "://", "http://localhost/de/1", "http://x.y/"]))
    d = spark.createDataFrame(pages, "page_id long, url string").repartition(5)
    got = {r["page_id"]: (r["verdict"], r["rule"], round(r["purity"], 9)) for r in urls.filter_urls(d).collect()}
    assert got == plain(pages)


def test_templates_decide_for_hosts_without_rules(spark):
    """/spam/ is blocked on every host with a rule, /en/ allowed on most: hosts that no rule fits follow."""
    given = [f"http://a{i}.example.net/{s}/{i}" for i in range(40) for s in ("spam", "en")] + [f"http://b{i}.site.io/{s}/{i}" for i in range(10) for s in ("spam", "en", "other")]
    pages = spark.createDataFrame(list(enumerate(given)), "page_id long, url string")
    got = urls.filter_urls(pages).where("rule is null").select("path", "verdict", "purity").collect()
    for section, verdict in (("spam", "block"), ("en", "allow"), ("other", "allow")):
        own = [r for r in got if r["path"].startswith(f"/{section}/")]
        assert len(own) == 10 and all(r["verdict"] == verdict and (section == "other") == (r["purity"] == 0.5) for r in own)
