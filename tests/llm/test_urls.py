"""Rules and path templates against plain Python."""

import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from aftershock.llm import url_templates as u
from aftershock.llm.queries import QUERIES, URL_RULES

RULES = [u.Rule.of(r) for r in URL_RULES]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule_of(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: (len(r.name), len(r.host)), default=None)


def templates(rows):
    """Template of each (host, path), level by level."""
    segs = [[s for s in p.replace("*", "%2A").split("/") if s] for _, p in rows]
    out = [""] * len(rows)
    for level in range(max(map(len, segs), default=0)):
        nodes = defaultdict(Counter)
        for k, (host, _) in enumerate(rows):
            if len(segs[k]) > level:
                nodes[host, out[k]][segs[k][level]] += 1
        new = list(out)
        for k, (host, _) in enumerate(rows):
            if len(segs[k]) > level:
                seen = nodes[host, out[k]]
                n = seen[segs[k][level]]
                stays = n >= u.LEAST_PAGES and n >= u.LEAST_SHARE * sum(seen.values())
                new[k] = f"{out[k]}/{segs[k][level] if stays else '*'}"
        out = new
    return out


ODD = [
    None, "", "no scheme", "http://", "http://ORG/", "https://A.Example.ORG/es/x?y#z", "http://example.org/en/1", "x://y://z/a",
    "http://example.org?x", "http://example.org#f", "http://badexample.org/es/", "http://xcom/fr/", "http://a.com/fr/", "http://com/de/\n2",
    "http://É.com/fr/", "http://h/a/b/c/d/e/f/g", "http://h/*/x", "http://h//x",
]


def test_parts_and_rules(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "page_id long, url string")
    df = df.withColumns({c: F.lit(1) for c in ("host", "path", "rule", "verdict", "label", "template")})
    rows = {r["page_id"]: r for r in u.judge_urls(df, RULES).collect()}
    assert len(rows) == len(ODD)
    for k, url in enumerate(ODD):
        host, path = parts(url)
        rule = rule_of(host, path)
        assert (rows[k]["host"], rows[k]["path"]) == (host, path)
        assert rows[k]["rule"] == (rule and rule.name)
        assert rule is None or rows[k]["verdict"] == rule.verdict


def test_given_pages(spark):
    sf = "/root/testdata/sf0.1"
    rows = QUERIES["op4_url_templates"](spark, sf).collect()
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()}
    assert len(rows) == len(urls)
    where = [parts(urls[r["page_id"]]) for r in rows]
    assert [(r["host"], r["path"]) for r in rows] == where
    assert [r["template"] for r in rows] == templates(where)
    for r in rows:
        rule = rule_of(r["host"], r["path"])
        assert r["rule"] == (rule and rule.name)
        assert r["verdict"] == (rule.verdict if rule else "block" if r["purity"] >= u.REJECT else "allow")


def test_templates_that_differ_far_down(spark):
    """Pages of one host that differ in their sixth segment, single long paths, and stars in paths."""
    urls = [f"http://deep.org/en/2024/{m}/{d}/list/{kind}/{d * m}/x" for m in (1, 2) for d in range(1, 30) for kind in ("casino", "news")]
    urls += ["http://deep.org/" + "/".join("abcdefghijkl"), "http://deep.org/en/2024", "http://h/*/x", "http://h/a", "http://h"] * 2
    urls += [f"http://bad.com/de/a/b/c/d/spam/{i}" for i in range(9)] + [f"http://bad.com/fr/a/b/c/d/fine/{i}" for i in range(9)]
    rules = [u.Rule.of(r) for r in ("block bad.com/de/", "allow bad.com/fr/")]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(4)
    rows = sorted(u.judge_urls(df, rules).collect(), key=lambda r: r["page_id"])
    assert [r["template"] for r in rows] == templates([parts(x) for x in urls])
    shown = {r["template"] for r in rows if r["host"] == "deep.org"}
    deep = {f"/en/2024/{m}/*/list/{kind}/*/x" for m in (1, 2) for kind in ("casino", "news")}
    assert deep | {"/en/2024", "/*" * 12} == shown


def test_purity_merges_like_shares_and_leans_on_other_hosts(spark):
    rows = []
    for host, template, blocked, allowed in (
        ("a", "/x/*", 50, 0), ("a", "/y/*", 49, 1), ("a", "/z/*", 0, 50), ("b", "/x/*", 0, 0), ("b", "/z/*", 0, 0), ("b", "/q/*", 0, 0),
    ):
        rows += [(host, template, 1)] * blocked + [(host, template, 0)] * allowed + [(host, template, None)] * 3
    df = spark.createDataFrame(rows, "host string, template string, label int")
    found = {(r["host"], r["template"]): r for r in u.template_purities(df).collect()}
    assert found["a", "/x/*"]["merged"] == found["a", "/y/*"]["merged"] != found["a", "/z/*"]["merged"]
    share = 100 / 152
    prior = {"/x/*": (50 + 4 * share) / 54, "/z/*": 4 * share / 54, "/q/*": share}
    assert abs(found["a", "/x/*"]["purity"] - (99 + 4 * prior["/x/*"]) / 104) < 1e-12
    for t, p in prior.items():
        assert abs(found["b", t]["purity"] - p) < 1e-12


def test_no_pages(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert u.judge_urls(df, RULES).count() == 0
