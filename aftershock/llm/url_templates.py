"""URL filter: rules first, then a tree of path templates for each host.

The segments of a host's paths form a tree.  A segment that makes up enough of
its parent stays as it is; all others of a parent are variable and become one
wildcard.  Templates of one form whose shares of blocked pages do not differ
statistically are merged.  A template is rejected by the share of its labelled
pages that are blocked, smoothed towards the share of the same template over
all hosts, and that towards the share over all pages.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aftershock.llm.common import ascii_lower, join_measured, store

# A segment stays if it makes up this share of its parent's pages, and so many of them.
LEAST_SHARE, LEAST_PAGES = 0.02, 4
# Templates are merged below this difference in standard deviations.
SIMILAR = 1.96
# Pages that a smoothed share's prior counts as, and the share from which a template is rejected.
PRIOR_PAGES, REJECT = 4.0, 0.6


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @staticmethod
    def of(text: str) -> Rule:
        """From text like ``block example.org/de/``."""
        verdict, _, name = text.partition(" ")
        host, slash, path = name.partition("/")
        return Rule(verdict, host, slash + path)

    def fits(self, host: Column, path: Column) -> Column:
        own = (host == self.host) | host.endswith("." + self.host)
        return own & path.startswith(self.path)


def with_host_and_path(pages: DataFrame, url: Column) -> DataFrame:
    """Adds ``host`` (A-Z in lower case) and ``path``; both are empty without a ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return pages.withColumns(
        {"host": ascii_lower(F.regexp_extract(url, pattern, 1)), "path": F.regexp_extract(url, pattern, 2)}
    )


def longest_rule(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, of equal ones the one with the longer host; else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), len(r.host), r.name, r.verdict)):
        fits = rule.fits(host, path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def with_templates(rows: DataFrame) -> DataFrame:
    """Adds ``template`` to rows with ``host`` and ``path``.

    The tree is grown over different paths with their numbers of pages.  Each
    level counts the segments below a node, decides which of them stay, and moves
    every path one segment down, until none has a segment left.  Below a node with
    too few pages for any segment to stay, all that is left are wildcards at once.
    """
    segments = F.filter(F.split(F.replace("path", F.lit("*"), F.lit("%2A")), "/"), lambda s: s != "")
    paths = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("_n"))
    open_ = store(paths.withColumns({"_rest": segments, "template": F.lit("")}), "paths")
    done = open_.filter("size(_rest) = 0").select("host", "path", "template")
    level = 0
    while True:
        left = open_.filter(F.size("_rest") > level).withColumn("_seg", F.get("_rest", F.lit(level)))
        counts = store(left.groupBy("host", "template", "_seg").agg(F.sum("_n").alias("_pages")), "segments")
        if counts.isEmpty():
            break
        nodes = counts.groupBy("host", "template").agg(F.sum("_pages").alias("_all"))
        kept = counts.join(nodes.filter(F.col("_all") >= LEAST_PAGES), ["host", "template"])
        stays = (F.col("_pages") >= LEAST_PAGES) & (F.col("_pages") >= LEAST_SHARE * F.col("_all"))
        kept = kept.select("host", "template", "_seg", stays.alias("_stays"))
        moved = join_measured(left, kept, ["host", "template", "_seg"], "left")
        rest = F.repeat(F.lit("/*"), (F.size("_rest") - level).cast("int"))
        shown = F.concat("template", F.lit("/"), F.when(F.col("_stays"), F.col("_seg")).otherwise("*"))
        last = F.col("_stays").isNull() | (F.size("_rest") == level + 1)
        template = F.when(F.col("_stays").isNull(), F.concat("template", rest)).otherwise(shown)
        moved = moved.select("host", "path", "_n", "_rest", template.alias("template"), last.alias("_last"))
        moved = store(moved, "tree-level")
        done = done.unionByName(moved.filter("_last").select("host", "path", "template"))
        open_ = moved.filter("NOT _last").drop("_last")
        level += 1
    return join_measured(rows, done, ["host", "path"])


def template_purities(rows: DataFrame) -> DataFrame:
    """``host, template, merged, purity`` from rows with ``host, template, label``.

    ``label`` is 1 for blocked pages, 0 for allowed ones, null for others.
    ``merged`` numbers the templates of a host and form that are judged together.
    """
    counts = rows.groupBy("host", "template").agg(
        F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("blocked")
    )
    counts = store(counts, "templates")
    total = F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")
    everywhere = counts.agg(*total).first()
    share = ((everywhere["blocked"] or 0) + 1) / ((everywhere["labelled"] or 0) + 2)
    shared = counts.groupBy("template").agg(*total)
    prior = (F.col("blocked") + PRIOR_PAGES * share) / (F.col("labelled") + PRIOR_PAGES)
    shared = shared.select("template", prior.alias("prior"))

    # Neighbours in the order of their shares are merged while they do not differ.
    form = F.regexp_replace("template", r"[^/*]+", "a")
    rate = F.col("blocked") / F.greatest(F.col("labelled"), F.lit(1))
    marked = counts.withColumns({"_form": form, "_known": F.col("labelled") > 0, "_rate": rate})
    line = Window.partitionBy("host", "_form", "_known").orderBy("_rate", "template")
    before = lambda c: F.lag(c).over(line)
    pooled = (F.col("blocked") + before("blocked")) / (F.col("labelled") + before("labelled"))
    spread = F.sqrt(pooled * (1 - pooled) * (1 / F.col("labelled") + 1 / before("labelled")))
    alike = F.col("_known") & (F.abs(F.col("_rate") - before("_rate")) <= SIMILAR * spread)
    marked = marked.withColumn("_new", F.when(F.coalesce(alike, F.lit(False)), 0).otherwise(1))
    marked = marked.withColumn("merged", F.sum("_new").over(line))
    group = Window.partitionBy("host", "_form", "_known", "merged")
    marked = marked.withColumns(
        {"_labelled": F.sum("labelled").over(group), "_blocked": F.sum("blocked").over(group)}
    ).join(shared, "template")
    purity = (F.col("_blocked") + PRIOR_PAGES * F.col("prior")) / (F.col("_labelled") + PRIOR_PAGES)
    return marked.select("host", "template", "merged", purity.alias("purity"))


def judge_urls(
    pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", reject: float = REJECT
) -> DataFrame:
    """A verdict for every page.

    Columns: ``page_id``, ``host``, ``path``, ``rule`` (the longest that fits, else
    null), ``verdict`` (the rule's, else ``block`` if the purity of the page's
    template reaches ``reject``, else ``allow``), ``template``, ``purity``.  The
    pages that a rule judges are the labels from which templates learn.  Null
    urls and urls without a host count as one host with an empty name; every row
    yields one row; other columns are not read; an empty table gives no rows.
    """
    rows = with_host_and_path(pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("_url")), F.col("_url"))
    rule, verdict = longest_rule(rules, F.col("host"), F.col("path"))
    label = F.when(F.col("_verdict") == "block", 1).when(F.col("_verdict") == "allow", 0)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("_verdict"))
    rows = with_templates(rows.withColumn("label", label))
    judged = join_measured(rows, template_purities(rows), ["host", "template"])
    learnt = F.when(F.col("purity") >= reject, "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", "rule", F.coalesce("_verdict", learnt).alias("verdict"), "template", "purity"
    )
