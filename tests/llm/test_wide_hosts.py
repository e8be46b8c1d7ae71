"""Hosts of more sections than a node keeps apart."""

from inkflow.llm import urls


def test_a_blocked_section_does_not_take_others_along(spark):
    given = [(f"http://example.com/{s}/page", 40) for s in ("de", *(f"sec{chr(97 + i)}" for i in range(14)))] + [(f"http://example.com/once{chr(97 + i)}/page", 1) for i in range(20)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(u for u, n in given for _ in range(n))], "page_id long, url string")
    got = urls.filter_urls(pages).select("path", "verdict", "template").distinct().collect()
    assert {r["path"] for r in got if r["verdict"] == "block"} == {"/de/page"}
    assert all(r["template"].startswith("/*/") == r["path"].startswith("/once") for r in got)
