"""Near-duplicate lines, removed by an exact set-similarity join in DataFrame functions.

A line is the set of its words.  Words are ordered by rarity; of each line the
rarest ones, its prefix, are cut into pairs of neighbours in that order.  A word
that only one of two lines has parts two pairs of its own line and one of the
other's, so two similar lines share a pair if the prefixes are long enough
(``_keys``).  Lines meet by these pairs, of which most belong to one line only and
go first; pairs of lines are thinned out by length, by the words' position and by
parities of the words, and the rest is verified on all words.  Equal lines are one
class from the start.  Keys of many lines are first used to compare those lines
with the earliest one; only lines without a match there are compared with the
others.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aftershock.llm import common
from aftershock.llm.common import store

# Counts of words are kept in as many cells.
CELLS = 1 << 16
# Keys with more lines than this are used with the earliest line first.
CROWD = 8
# White space beside blanks and the line feeds at which texts are cut.
_SPACES = "\t\x0b\x0c\r"
# Bits of the short number of a word, and of a key.
_WORD_BITS, _KEY_BITS = 32, 40
# Lines with fewer words have parities in 64 bits instead of 128.
_LONG = 80
# Bytes of a table that is sent to all tasks, at most.
FEW_BYTES = 1 << 20
# The same of maps that have a bit for each line or text.
MARK_BYTES = 64 << 20
# Bits for each text or line that is looked for, and bits of all at most.
_SPARSE, _MOST_BITS = 16, 1 << 28
# Words that two similar lines share in their prefixes, at least, where these are not cut
# into pairs; one where different lines can be similar by a single common word.
SHARED = 2
# Numbers of words and of a line's place are kept in this many bits.
_COUNT_BITS, _MOST = 16, (1 << 16) - 1


def word_levels(lines: DataFrame) -> list[int]:
    """Binary logarithm of the number of lines with the words in each cell; ``t`` has a line's words."""
    words = lines.select(F.explode("t").alias("w"))
    cells = words.groupBy(_cell(F.col("w")).alias("cell")).count().collect()  # at most CELLS rows
    levels = [0] * CELLS
    for cell, n in cells:
        levels[cell] = int(math.log2(n))
    return levels


def _cell(word: Column) -> Column:
    return word.bitwiseAND(F.lit(CELLS - 1))


def _words(line: Column) -> Column:
    """Sorted numbers of 64 bits of a line's distinct words; of white space the line has blanks only."""
    # Java parts strings at a single blank without a pattern; none of its parts is null.
    numbers = F.transform(F.split(F.lower(line), " "), lambda w: F.xxhash64(w))
    return F.sort_array(F.array_remove(F.array_distinct(numbers), F.xxhash64(F.lit(""))))


def _rare_first(t: Column, levels: list[int]) -> Column:
    """A line's short numbers with their levels, rare words first."""
    # A text that becomes one constant array when the query is planned.
    level_of = F.from_json(F.lit(json.dumps(levels, separators=(",", ":"))), "array<tinyint>")
    mask = F.lit((1 << _WORD_BITS) - 1)

    def with_level(x: Column) -> Column:
        level = F.get(level_of, _cell(x)).cast("long")
        # Never null, but only numbers that are known not to be are sorted without objects.
        return F.shiftleft(F.coalesce(level, F.lit(0).cast("long")), _WORD_BITS).bitwiseOR(x.cast("long").bitwiseAND(mask))

    return F.sort_array(F.transform(t, with_level))


def _keys(words: Column, n: Column, percent: int) -> tuple[Column, int]:
    """Keys of a line of ``n`` words, rare ones first, and how many of them similar lines share, at least.

    If ``a`` of a line's words are missing in a similar one, which has ``b`` others, then
    (100 - percent) n >= 100 a + percent b, so at most 2 a + b <= (100 - percent) n / 50 pairs of
    neighbours are parted, and the next one is shared.  Lines have that many pairs if common
    words are more than twice the others; else keys are single words.
    """
    key = lambda *x: F.xxhash64(*x).bitwiseAND(F.lit((1 << _KEY_BITS) - 1))
    if 3 * percent > 200:
        k = F.least(n - 1, F.floor(n * (100 - percent) / 50).cast("int") + 1)
        return F.zip_with(F.slice(words, 1, k), F.slice(words, 2, k), lambda x, y: key(x, y)), 1
    shared = SHARED if percent > 50 else 1
    # Lines with fewer words in common than this are not similar.
    least = F.ceil(n * percent / 100)
    return F.transform(F.slice(words, 1, (n - least + shared).cast("int")), lambda x: key(x)), shared


def _texts(docs: DataFrame) -> DataFrame:
    """``id``, ``th`` (hash of the text) and ``text``."""
    return docs.select(
        F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"),  # no id comes before all ids
        F.xxhash64("text").alias("th"),
        "text",
    )


def _lines(texts: DataFrame, *keep: str) -> DataFrame:
    """``no`` and ``line``, with blanks for other white space, beside other columns; no line of null texts."""
    text, blank = F.col("text"), F.lit(False)
    for space in _SPACES:
        blank = blank | F.contains(text, F.lit(space))
    text = F.when(blank, F.regexp_replace(text, f"[{_SPACES}]", " ")).otherwise(text)
    return texts.select(*keep, F.posexplode(F.split(text, "\n")).alias("no", "line"))


def _packed(no: Column, n: Column, pos: Column) -> Column:
    """A line's place, its number of words and a word's position in one number."""
    few = lambda x: F.least(x, F.lit(_MOST)).cast("long")
    return (
        F.shiftleft(no.cast("long"), 2 * _COUNT_BITS)
        .bitwiseOR(F.shiftleft(few(n), _COUNT_BITS))
        .bitwiseOR(few(pos))
    )


def _parities(t: Column) -> tuple[Column, Column]:
    """2 x 64 bits, each whether an odd number of the words has its place; unlike marks they don't fill up on long lines.

    Both halves over each other are the parities in 64 bits, and these, beside 0, are all that short lines have.
    """
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")

    def with_word(bits: Column, x: Column) -> Column:
        return bits.bitwiseXOR(F.call_function("shiftleft", one, x.bitwiseAND(F.lit(63)).cast("int")))

    both = F.aggregate(t, none, with_word)
    second = F.aggregate(F.filter(t, lambda x: x.bitwiseAND(F.lit(64)) != 0), none, with_word)
    return both, F.when(F.size(t) >= _LONG, second).otherwise(none)


def _marks(rows: DataFrame, number: Column) -> DataFrame:
    """Maps with a bit for each number, which must be 0 or more; stored."""
    rows = rows.select(F.bitmap_bucket_number(number).alias("_map_no"), F.bitmap_bit_position(number).alias("_bit"))
    # A map is made in one task, or each task would send its own.
    maps = rows.repartition("_map_no").groupBy("_map_no").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    return store(maps, "marks")


def _with_mark(df: DataFrame, number: Column, marks: DataFrame) -> DataFrame:
    """Adds ``_marked``, whether a row's number has a bit in ``marks``."""
    if common.measured_bytes(marks) <= MARK_BYTES:
        marks = F.broadcast(marks)
    bit = F.bitmap_bit_position(number).cast("int")
    byte = F.conv(F.hex(F.substring("_map", (F.shiftright(bit, 3) + 1), F.lit(1))), 16, 10).cast("int")
    marked = F.call_function("shiftright", byte, bit.bitwiseAND(F.lit(7))).bitwiseAND(F.lit(1)) == 1
    joined = df.join(marks, F.bitmap_bucket_number(number) == F.col("_map_no"), "left")
    return joined.withColumn("_marked", F.coalesce(marked, F.lit(False))).drop("_map_no", "_map")


def find_repeated_lines(
    docs: DataFrame, percent: int, min_words: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, th, no`` of the lines that are similar to an earlier one; stored."""
    plain = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")
    )
    texts, n = _texts(plain), F.size("s")
    both, second = _parities(F.col("s"))
    lines = store(
        # No filter here: it would be pushed below the words, which would be made twice.
        _lines(texts, "id", "th").select("id", "th", "no", _words(F.col("line")).alias("s")).select(
            F.monotonically_increasing_id().alias("row"), "id", "th", "no",
            F.xxhash64("s").alias("c"), n.alias("n"), both.alias("bits"), second.alias("more"),
            # A shorter number of each word: two words of one number only meet in vain.
            F.transform("s", lambda x: F.shiftright(x, 64 - _WORD_BITS).cast("int")).alias("t"),
        ),
        "lines",
    )
    levels = word_levels(lines)
    seen = lines.filter(F.col("n") >= min_words)

    # Classes of lines with equal words, at their first place.
    places = seen.select("c", "row", "id", "th", "no")
    first = places.groupBy("c").agg(F.min("id").alias("first_id"))
    first = places.join(first, "c").filter("id = first_id").groupBy("c").agg(
        F.min("id").alias("first_id"), F.min("no").alias("first_no")
    )
    copies = places.join(first, "c").filter("id <> first_id OR no <> first_no")
    copies = store(copies.select("row", "id", "th", "no"), "line-copies")
    places, row = seen.select("row", "id", "th", "no"), F.col("row")
    similar = _Verifier(texts, places, percent)

    # Lines are marked by a bit each, so the table of them stays where it is.
    firsts = _with_mark(seen, row, _marks(copies, row)).filter("NOT _marked")
    # A line with fewer words is only similar to an equal one, and those are classes already.
    posting = firsts.filter(100 * F.col("n") >= percent * (F.col("n") + 1))
    posts, shared = _posts(posting, seen, levels, percent)
    posts = store(posts, "posts")
    crowds = posts.groupBy("w").agg(F.count(F.lit(1)).alias("many"), F.min("id").alias("head"))
    crowds = crowds.filter(F.col("many") > CROWD).select(F.col("w").alias("_w"), "head")
    crowds = store(crowds, "crowds")

    # One exchange serves both sides, here and below.
    parts = _parts(docs)
    as_earlier = {c: f"y_{c}" for c in posts.columns}
    crowded = posts.repartition(parts, "w").join(_few(crowds), F.col("w") == F.col("_w")).drop("_w")
    # Heads are the smallest ids; an equation would be a key of the join and part its exchange.
    heads = crowded.filter("id <= head").drop("head").withColumnsRenamed(as_earlier)
    done = similar.later(_pairs(crowded.filter("id > head").drop("head").join(heads, _meet(percent)), shared))

    # The others; lines that are done have numbers below zero and are only the earlier ones.
    known = _with_mark(posts, row, _marks(done, row)).withColumn("row", F.when(F.col("_marked"), -1 - row).otherwise(row))
    dealt = known.drop("_marked").repartition(parts, "w")
    met = dealt.join(dealt.withColumnsRenamed(as_earlier), _meet(percent))
    done = done.unionByName(similar.later(_pairs(met, shared)))

    later = _with_mark(places, row, _marks(done, row)).filter("_marked").select(*places.columns)
    return store(later.unionByName(copies).select("id", "th", "no"), "repeated-lines")


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _posts(lines: DataFrame, seen: DataFrame, levels: list[int], percent: int) -> tuple[DataFrame, int]:
    """A row for each key of a line that another line of fitting length has too, and the keys that similar lines share."""
    keys, shared = _keys(F.col("_words"), F.col("n"), percent)
    words = lines.select("row", "n", _rare_first(F.col("t"), levels).alias("_words"))
    posts = words.select("row", "n", F.posexplode(keys).alias("pos", "w"))
    posts = posts.select("w", "row", _packed(F.lit(0), F.col("n"), F.col("pos")).alias("at"))
    # Most keys belong to one line, so few rows are left, and only these get what the join of lines needs.
    # Columns are told by the sides' names, as other columns would be another exchange.
    fit = F.expr(f"x.w = y.w AND x.row <> y.row AND ({_fit(percent, 'x.', 'y.')})")
    met = posts.alias("x").join(posts.alias("y"), fit, "left_semi")
    met = met.join(seen.select("row", "id", "no", "bits", "more"), "row")
    at = F.col("at").bitwiseOR(_packed(F.col("no"), F.lit(0), F.lit(0)))
    return met.select("w", "row", "id", at.alias("at"), "bits", "more"), shared


def _few(df: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast if it is small."""
    return F.broadcast(df) if common.measured_bytes(df) <= FEW_BYTES else df


def join_measured(left: DataFrame, right: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    return common.join_measured(left, right, on, how, FEW_BYTES)


def _counts(side: str) -> tuple[str, str]:
    """The line's number of words and the key's position."""
    return f"({side}at >> {_COUNT_BITS} & {_MOST})", f"({side}at & {_MOST})"


def _fit(percent: int, one: str = "", other: str = "y_") -> str:
    """Whether two lines with a common key may be similar by their numbers of words; the names' prefixes tell them."""
    (n, i), (m, j) = _counts(one), _counts(other)
    return (
        f"NOT ({n} < {_MOST} AND {m} < {_MOST})"  # larger counts are not kept
        f" OR 100 * {n} >= {percent} * {m} AND 100 * {m} >= {percent} * {n}"
        # Before the shared word at most the smaller position is shared, from it on the shorter rest.
        f" AND {100 + percent} * (least({i}, {j}) + least({n} - {i}, {m} - {j})) >= {percent} * ({n} + {m})"
    )


def _meet(percent: int) -> Column:
    """Whether a post and another line's, with the prefix ``y_``, may show two similar lines, the other earlier."""
    (n, _), (m, _) = _counts(""), _counts("y_")
    place = 2 * _COUNT_BITS
    return F.expr(
        # A row below zero has its match; told by both sides, as a filter of one side would part their exchange.
        f"w = y_w AND least(row, y_at) >= 0 AND (y_id < id OR y_id = id AND y_at >> {place} < at >> {place})"
        f" AND ({_fit(percent)})"
        # Each differing bit is at least one word that only one line has.
        f" AND (NOT ({n} < {_MOST} AND {m} < {_MOST}) OR {100 - percent} * ({n} + {m}) >= {100 + percent}"
        f" * CASE WHEN least({n}, {m}) < {_LONG} THEN bit_count(bits ^ y_bits)"
        f" ELSE bit_count(bits ^ y_bits ^ more ^ y_more) + bit_count(more ^ y_more) END)"
    )


def _pairs(met: DataFrame, shared: int) -> DataFrame:
    """Pairs that met by enough words: ``a`` and the earlier ``b``."""
    earlier = F.greatest("y_row", -1 - F.col("y_row"))
    met = met.groupBy(F.col("row").alias("a"), earlier.alias("b")).agg(F.count(F.lit(1)).alias("_met"))
    return met.filter(F.col("_met") >= shared).drop("_met")


class _Verifier:
    """Compares lines on all words, made again from the texts."""

    def __init__(self, texts: DataFrame, places: DataFrame, percent: int):
        self.texts, self.places, self.percent = texts, places, percent

    def later(self, pairs: DataFrame) -> DataFrame:
        """``row`` of the lines that are similar to an earlier one; stored."""
        pairs = store(pairs, "line-pairs")
        row = F.col("row")
        wanted = pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct()
        places = _with_mark(self.places, row, _marks(wanted, row)).filter("_marked")
        # Rows of one id and text have the same lines.
        places = store(places.groupBy("id", "th", "no").agg(F.min("row").alias("a")), "line-places")
        # Few texts and lines that are not wanted pass; the join leaves them out.
        bits = min(_MOST_BITS, 1 << (_SPARSE * places.count()).bit_length())
        text = F.col("th").bitwiseAND(F.lit(bits - 1))
        line = F.xxhash64("id", "th", "no").bitwiseAND(F.lit(bits - 1))
        texts = _with_mark(self.texts, text, _marks(places.select("th").distinct(), text)).filter("_marked")
        lines = _with_mark(_lines(texts, "id", "th"), line, _marks(places, line)).filter("_marked").drop("_marked")
        rows = lines.join(places, ["id", "th", "no"]).select("a", "line")
        full = rows.select("a", _words(F.col("line")).alias("t")).repartition(_parts(rows), "a")
        other = full.withColumnsRenamed({"a": "b", "t": "u"})
        both = F.size(F.array_intersect("t", "u"))
        alike = 100 * both >= self.percent * (F.size("t") + F.size("u") - both)
        found = pairs.join(full, "a").join(other, "b").filter(alike)
        return store(found.select(F.col("a").alias("row")).distinct(), "later-lines")


def drop_repeated_lines(
    docs: DataFrame,
    percent: int = 80,
    min_words: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    count_col: str = "removed_lines",
) -> DataFrame:
    """The documents without lines that are similar to an earlier line.

    Two lines are similar if their sets of words (lower case, parted by white
    space) share at least ``percent`` percent of their union; lines with fewer
    than ``min_words`` different words (by default, without any) are left alone.  Earlier means in a
    document with a smaller id or, in one document, further up; a document
    without an id comes first; rows of one id count as one document, and lines
    with equal numbers in them do not precede each other.  A removed line still
    counts as an earlier one.  Texts are cut at line feeds.  Null and empty texts
    stay as they are.  All columns stay; ``count_col`` is added (or replaced).
    """
    found = find_repeated_lines(docs, percent, min_words, id_col, text_col)
    drops = found.groupBy(F.col("id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_set("no").alias("_drop"))
    text = F.col(f"`{text_col}`").cast("string")
    same = (F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63))) == F.col("_id")) & (
        F.xxhash64(text) == F.col("_th")
    )
    joined = join_measured(docs, drops, same, "left")
    kept = F.filter(F.split(text, "\n"), lambda line, no: ~F.array_contains(F.col("_drop"), no))
    cut = F.when(F.col("_drop").isNull(), text).otherwise(F.array_join(kept, "\n"))
    columns = [cut.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c != count_col]
    return joined.select(*columns, F.coalesce(F.size("_drop"), F.lit(0)).alias(count_col))
