"""Rows and cells out of stored web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aftershock.operators.ordered import WINDOW_ROWS, largest_group, running_min, running_total

# What is no markup, though it may hold angle brackets.
_ASIDE = r"(?is)<!--.*?(-->|$)|<(script|style)\b.*?</\2\s*>"


def extract_page_rows(
    pages: DataFrame, row_regex: str, cell_regexes: dict[str, str], html: str = "html"
) -> DataFrame:
    """One row per match of ``row_regex``: page_id, pos and the cells.

    A cell is the first group of its pattern inside the row, or an empty text.
    """
    rows = F.regexp_extract_all(F.col(html), F.lit(row_regex), F.lit(1))
    cells = [F.regexp_extract("row", pattern, 1).alias(name) for name, pattern in cell_regexes.items()]
    return pages.select("page_id", F.posexplode(rows).alias("pos", "row")).select(
        "page_id", "pos", *cells
    )


def scan_page_rows(
    pages: DataFrame,
    tag: str,
    cell_regexes: dict[str, str],
    html: str = "html",
    id_col: str = "page_id",
    limit: int = WINDOW_ROWS,
) -> DataFrame:
    """One row for each outermost element ``tag``: page_id, pos and the cells.

    The page is cut into tags, and a running sum over these tells how many elements
    of the kind are open.  So an element may run over lines, have attributes, and
    hold further elements of its own kind, which stay a part of it.  Tags count in
    either case; end tags without a begin do not count; an element that is not
    closed ends with its page; comments, scripts and styles are left out.  A cell is
    the first group of its pattern inside the element, over lines too, or an empty
    text.  A page without such elements, or without text, gives no rows; repeated
    pages give theirs each.  Pages longer than ``limit`` tags are
    summed in ranges.
    """
    text = F.regexp_replace(F.coalesce(F.col(f"`{html}`"), F.lit("")), _ASIDE, "")
    plain = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.monotonically_increasing_id().alias("_page"), text.alias("_text"))
    tokens = plain.select("page_id", "_page", F.posexplode(F.split("_text", "<")).alias("_at", "_token"))
    name = F.lower(F.regexp_extract("_token", r"^/?([A-Za-z][A-Za-z0-9]*)", 1))
    own = (name == tag.lower()) & (F.col("_at") > 0) & ~F.col("_token").rlike(r"(?s)^[^>]*/>")
    step = F.when(own & F.col("_token").startswith("/"), -1).when(own, 1).otherwise(0).cast("long")
    tokens = tokens.withColumn("_step", step)

    page, order = ["page_id", "_page"], ["_at"]
    longest = largest_group(tokens, page)
    summed = running_total(tokens, page, order, F.col("_step"), "_sum", limit, longest)
    summed = summed.withColumn("_sum", F.col("_sum") + F.col("_step"))
    # Below zero there is nothing to close.
    least = running_min(summed, page, order, F.col("_sum"), "_least", limit, longest)
    depth = F.col("_sum") - F.least(F.col("_least"), F.lit(0))
    marked = least.withColumn("_depth", depth)
    begins = (F.col("_step") == 1) & (F.col("_depth") == 1)
    marked = marked.withColumn("_begins", begins.cast("long"))
    numbered = running_total(marked, page, order, F.col("_begins"), "_row", limit, longest)
    inside = numbered.filter((F.col("_depth") > 0)).withColumn("_row", F.col("_row") + F.col("_begins") - 1)
    piece = F.when(F.col("_begins") == 1, F.regexp_replace("_token", r"(?s)^[^>]*>?", "")).otherwise(
        F.concat(F.lit("<"), F.col("_token"))
    )
    rows = inside.groupBy(*page, "_row").agg(F.array_sort(F.collect_list(F.struct("_at", piece.alias("_piece")))).alias("_pieces"))
    body = F.array_join(F.col("_pieces")["_piece"], "")
    cells = [F.regexp_extract("_body", f"(?s){pattern}", 1).alias(n) for n, pattern in cell_regexes.items()]
    return rows.withColumn("_body", body).select("page_id", F.col("_row").cast("int").alias("pos"), *cells)
