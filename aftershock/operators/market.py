"""The market before and after every candle.

Frames count candles, not minutes: over a gap in the data they reach across
it.  Candles are unique on (pair, ts).

Extremes come from a sparse table: level ``j`` holds the highest high and lowest
low of ``2 ** j`` candles, made of two values of the level below, and any frame is
covered by two blocks of one level.  So a frame costs two lookups, however long
it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aftershock.functions.moments import minutes
from aftershock.functions.prices import price_to_pips
from aftershock.operators.ordered import CHUNK_ROWS, window_text, with_halo
from aftershock.operators.sized import join_null_safe, join_sized
from aftershock.session import stored
from aftershock.settings import BEFORE_MINUTES, CANDLE_MINUTES, horizons

PRICES = ("open", "high", "low", "close")
AFTER_METRICS = ("volatility", "pips_candle", "pips_agg", "pips_candle_max", "pips_candle_min")


def candles_from_ticks(
    ticks: DataFrame, pair: Column, ts: Column, slot: Column, pips: Column
) -> DataFrame:
    """Open, high, low and close of every slot; partial results combine map-side."""
    rows = ticks.select(pair.alias("pair"), slot.alias("slot"), ts.alias("tick"), pips.alias("pips"))
    return rows.groupBy("pair", F.col("slot").alias("ts")).agg(
        F.min_by("pips", "tick").alias("open"),
        F.max("pips").alias("high"),
        F.min("pips").alias("low"),
        F.max_by("pips", "tick").alias("close"),
    )


def candles_in_pips(candles: DataFrame) -> DataFrame:
    """Prices of a candle table as integer pips."""
    return candles.withColumns({c: price_to_pips(F.col(c)) for c in PRICES})


def ohlc_resample(candles: DataFrame, size: int) -> DataFrame:
    """Coarser candles, closed on the right and labelled by their left end.

    A candle that starts exactly on a boundary belongs to the window before
    it.  Windows without candles do not appear.
    """
    step = size * 60
    label = F.timestamp_seconds(
        (F.ceil(F.unix_micros("_ts") / F.lit(step * 1_000_000.0)) - 1) * F.lit(step)
    )
    rows = candles.withColumnRenamed("ts", "_ts").withColumn("ts", label)
    return rows.groupBy("pair", "ts").agg(
        F.min_by("open", "_ts").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "_ts").alias("close"),
    )


def _days(candles: DataFrame) -> DataFrame:
    """Rows and first position of every day of a pair."""
    per_day = candles.groupBy("pair", F.to_date("ts").alias("_day")).agg(F.count(F.lit(1)).alias("_rows"))
    by_day = Window.partitionBy("pair").orderBy("_day")
    return per_day.withColumn("_offset", F.sum("_rows").over(by_day) - F.col("_rows"))


def number_candles(candles: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """Adds ``candle_no``, the position of a candle in its pair's series.

    Two levels keep every task small: a day of a pair holds at most
    1440 / candle size rows, and a pair has one count row per day.  With
    ``days`` (some of ``_days``), only candles of these days come back.
    """
    offsets = (_days(candles) if days is None else days).select("pair", "_day", "_offset")
    rows = candles.withColumn("_day", F.to_date("ts"))
    in_day = Window.partitionBy("pair", "_day").orderBy("ts")
    numbered = F.col("_offset") + F.row_number().over(in_day) - 1
    if days is None:
        rows = rows.withColumn("_row", F.row_number().over(in_day))
        numbered = F.col("_offset") + F.col("_row") - 1
        joined = join_null_safe(rows, offsets, ["pair", "_day"])
    else:  # before the rows are sorted, as few of them stay
        joined = join_sized(rows, offsets, ["pair", "_day"], null_safe=True)
    return joined.withColumn("candle_no", numbered).drop("_day", "_row", "_offset")


def suffix(start: int, end: int) -> str:
    return f"_{start}_{end}_after"


def level_of(rows: int) -> int:
    """Level of the two blocks that cover a frame."""
    return rows.bit_length() - 1


def levels_needed(pairs: Sequence[tuple[int, int]]) -> int:
    """Highest level that the horizons' frames use."""
    return max(level_of((end - start) // CANDLE_MINUTES) for start, end in pairs)


def _level(price: str, j: int, ahead: bool) -> str:
    """Column of a level; level 0 is the candle itself."""
    return f"_{price}_{'on' if ahead else 'back'}{j}" if j else price


def with_levels(df: DataFrame, w: str, highest: int, ahead: bool = True) -> DataFrame:
    """Adds the levels up to ``highest`` of candles from each one on, or up to each one.

    Nulls beyond the ends of the series do not count.
    """
    step = "lead" if ahead else "lag"
    for j in range(highest):
        texts = [
            f"{best}({_level(p, j, ahead)}, {step}({_level(p, j, ahead)}, {1 << j}) OVER ({w})) "
            f"AS {_level(p, j + 1, ahead)}"
            for p, best in (("high", "greatest"), ("low", "least"))
        ]
        df = df.selectExpr("*", *texts)
    return df


def _frame_blocks(first: int, last: int, ahead: bool) -> tuple[int, list[int]]:
    """Level and places of the blocks that cover a frame."""
    j = level_of(last - first + 1)
    rest = (1 << j) - 1
    return j, sorted({first, last - rest} if ahead else {last, first + rest})


def _best_of(best: str, found: list[str]) -> str:
    """``greatest`` and ``least`` want at least two values."""
    return f"{best}({', '.join(found)})" if len(found) > 1 else found[0]


def forward_extremes(w: str, start: int, end: int) -> tuple[str, str]:
    """Highest high and lowest low of the candles from ``start`` up to ``end``, out of the levels."""
    j, places = _frame_blocks(start // CANDLE_MINUTES, end // CANDLE_MINUTES - 1, True)

    def ahead(price: str, best: str) -> str:
        found = [f"lead({_level(price, j, True)}, {k}) OVER ({w})" if k else _level(price, j, True) for k in places]
        return f"coalesce({_best_of(best, found)}, {price})"

    return ahead("high", "greatest"), ahead("low", "least")


def forward_closes(w: str, start: int, end: int) -> tuple[str, str]:
    """Close of the candle at ``start`` and of the last candle before ``end``."""

    def ahead(k: int) -> str:
        return f"coalesce(lead(close, {k}) OVER ({w}), close)" if k else "close"

    return ahead(start // CANDLE_MINUTES), ahead(end // CANDLE_MINUTES - 1)


def reaction(s: str, high: str, low: str, first: str, last: str, close: str) -> dict[str, str]:
    """The five reaction metrics of a horizon from its prices.

    The reference price of a horizon is the close of its first candle;
    ``pips_agg`` is measured from the close of the release candle.
    """
    return {
        "volatility" + s: f"{high} - {low}",
        "pips_candle" + s: f"{last} - {first}",
        "pips_agg" + s: f"{last} - {close}",
        "pips_candle_max" + s: f"{high} - {first}",
        "pips_candle_min" + s: f"{low} - {first}",
    }


def after_columns(w: str, pairs: Sequence[tuple[int, int]]) -> dict[str, str]:
    """Reaction metrics of every horizon."""
    out: dict[str, str] = {}
    for start, end in pairs:
        prices = (*forward_extremes(w, start, end), *forward_closes(w, start, end))
        out.update(reaction(suffix(start, end), *prices, "close"))
    return out


def before_columns(
    w: str, span: int = BEFORE_MINUTES, include_release_candle: bool = True
) -> dict[str, str]:
    """Volatility and change of the open over the ``span`` minutes before, out of the levels."""
    rows = span // CANDLE_MINUTES
    last = 0 if include_release_candle else -1
    j, places = _frame_blocks(last - rows + 1, last, False)

    def back(price: str, best: str) -> str:
        found = [f"lag({_level(price, j, False)}, {-k}) OVER ({w})" if k else _level(price, j, False) for k in places]
        return f"coalesce({_best_of(best, found)}, {price})"

    return {
        f"volatility_{span}_0_before": f"{back('high', 'greatest')} - {back('low', 'least')}",
        f"pips_agg_{span}_0_before": f"open - coalesce(lag(open, {rows}) OVER ({w}), open)",
    }


def _framed(
    numbered: DataFrame,
    pairs: Sequence[tuple[int, int]],
    span: int,
    include_release_candle: bool,
    chunk: int,
) -> DataFrame:
    """Numbered candles with all columns; levels and columns share one exchange and one sort.

    Chunks carry copies of as many neighbours as the frames reach for.
    """
    before, after = span // CANDLE_MINUTES, _reach(pairs)
    w = window_text(["pair", "_chunk"], ["candle_no"])
    rows, columns = with_halo(numbered, "candle_no", before, after, chunk), {}
    if pairs:
        rows, columns = with_levels(rows, w, levels_needed(pairs)), after_columns(w, pairs)
    if span:
        rows = with_levels(rows, w, level_of(before), ahead=False)
        columns |= before_columns(w, span, include_release_candle)
    texts = [f"{text} AS `{name}`" for name, text in columns.items()]
    return rows.selectExpr(*numbered.columns, "_own", *texts).filter("_own").drop("_own")


def _reach(pairs: Sequence[tuple[int, int]]) -> int:
    """Candles that the horizons look ahead."""
    return max((end for _, end in pairs), default=CANDLE_MINUTES) // CANDLE_MINUTES - 1


def with_extremes(
    numbered: DataFrame, pairs: Sequence[tuple[int, int]], chunk: int = CHUNK_ROWS
) -> DataFrame:
    """Numbered candles with ``high_{a}_{b}`` and ``low_{a}_{b}`` of every horizon."""
    w = window_text(["pair", "_chunk"], ["candle_no"])
    rows = with_levels(with_halo(numbered, "candle_no", 0, _reach(pairs), chunk), w, levels_needed(pairs))
    texts = []
    for a, b in pairs:
        high, low = forward_extremes(w, a, b)
        texts += [f"{high} AS high_{a}_{b}", f"{low} AS low_{a}_{b}"]
    return rows.selectExpr(*numbered.columns, "_own", *texts).filter("_own").drop("_own")


def market_after(
    candles: DataFrame, pairs: Sequence[tuple[int, int]] | None = None, chunk: int = CHUNK_ROWS
) -> DataFrame:
    """Candles with the reaction metrics of all horizons, in one shuffle and sort."""
    pairs = horizons() if pairs is None else pairs
    return _framed(number_candles(candles), pairs, 0, True, chunk)


def market_before(
    candles: DataFrame,
    span: int = BEFORE_MINUTES,
    include_release_candle: bool = True,
    chunk: int = CHUNK_ROWS,
) -> DataFrame:
    """Candles with the market before them."""
    return _framed(number_candles(candles), [], span, include_release_candle, chunk)


def market_features(
    candles: DataFrame,
    pairs: Sequence[tuple[int, int]] | None = None,
    span: int = BEFORE_MINUTES,
    include_release_candle: bool = True,
    frame: str = "rows",
    chunk: int = CHUNK_ROWS,
) -> DataFrame:
    """Before and after columns together; still one shuffle and one sort."""
    pairs = horizons() if pairs is None else pairs
    if frame == "time":
        return _time_features(candles, pairs, span, include_release_candle)
    if frame != "rows":
        raise ValueError(f"frame must be 'rows' or 'time', not {frame!r}")
    return _framed(number_candles(candles), pairs, span, include_release_candle, chunk)


# Positions that are looked for together when days are chosen.
_STRIDE = 64


def _days_in_reach(candles: DataFrame, instants: DataFrame, before: int, after: int) -> DataFrame:
    """Days (see ``_days``) that hold any candle within reach of an instant; all is per day."""
    days = stored(_days(candles), "days")
    asked = instants.select("pair", F.to_date("ts").alias("_day")).distinct()
    asked = join_null_safe(asked, days, ["pair", "_day"])

    def strides(first: Column, last: Column) -> Column:
        return F.explode(F.sequence(F.floor(first / _STRIDE), F.floor(last / _STRIDE)))

    last = F.col("_offset") + F.col("_rows") - 1
    wanted = asked.select(
        "pair", strides(F.greatest(F.col("_offset") - before, F.lit(0)), last + after).alias("_stride")
    ).distinct()
    held = days.withColumn("_stride", strides(F.col("_offset"), last))
    found = join_null_safe(held, wanted, ["pair", "_stride"], "leftsemi")
    return found.drop("_stride").dropDuplicates(["pair", "_day"])


def market_at(
    instants: DataFrame,
    candles: DataFrame,
    pairs: Sequence[tuple[int, int]] | None = None,
    span: int = BEFORE_MINUTES,
    include_release_candle: bool = True,
    chunk: int = CHUNK_ROWS,
) -> DataFrame:
    """``market_features`` of the candles at given instants only: ``pair, ts`` and the features.

    ``instants`` has (pair, ts); those without a candle give no row.  All candles
    are counted per day, and only those of days within reach of an instant are
    shuffled, numbered and laid out as levels; a frame is two lookups into these,
    by equi joins on (pair, candle_no).
    """
    pairs = horizons() if pairs is None else pairs
    instants = instants.select("pair", "ts").distinct()
    before, after = span // CANDLE_MINUTES, _reach(pairs)
    days = _days_in_reach(candles, instants, before, after)
    numbered = number_candles(candles.select("pair", "ts", *PRICES), days)
    numbered = stored(numbered, "numbered")

    # What is looked up where: (offset, column).
    top = 0 if include_release_candle else -1
    wanted: dict[str, tuple[str, list[tuple[int, str]]]] = {}
    for start, end in pairs:
        s, first, last = suffix(start, end), start // CANDLE_MINUTES, end // CANDLE_MINUTES - 1
        j, places = _frame_blocks(first, last, True)
        wanted[f"_h{s}"] = ("greatest", [(k, _level("high", j, True)) for k in places])
        wanted[f"_l{s}"] = ("least", [(k, _level("low", j, True)) for k in places])
        wanted[f"_f{s}"], wanted[f"_t{s}"] = ("", [(first, "close")]), ("", [(last, "close")])
    j, places = _frame_blocks(top - before + 1, top, False)
    wanted["_hb"] = ("greatest", [(k, _level("high", j, False)) for k in places])
    wanted["_lb"] = ("least", [(k, _level("low", j, False)) for k in places])
    wanted["_ob"] = ("", [(-before, "open")])
    offsets = sorted({k for _, parts in wanted.values() for k, _ in parts})

    w = window_text(["pair", "_chunk"], ["candle_no"])
    levels = with_halo(numbered, "candle_no", before, after, chunk)
    levels = with_levels(with_levels(levels, w, levels_needed(pairs)), w, level_of(before), ahead=False)
    used = sorted({c for _, parts in wanted.values() for _, c in parts})
    levels = levels.filter("_own").select("pair", "candle_no", *used)

    at = join_null_safe(numbered, instants, ["pair", "ts"], "leftsemi")
    own = [f"_{c}0" for c in PRICES]
    asked = at.select(
        "pair", "ts", *[F.col(c).alias(f"_{c}0") for c in PRICES], "candle_no",
        F.explode(F.array(*[F.lit(k) for k in offsets])).alias("_k"),
    )
    asked = asked.withColumn("candle_no", F.col("candle_no") + F.col("_k"))
    met = join_null_safe(asked, levels, ["pair", "candle_no"], "left")

    def found(best: str, parts: list[tuple[int, str]]) -> str:
        return _best_of(best, [f"max(CASE WHEN _k = {k} THEN {c} END)" for k, c in parts])

    folded = met.groupBy("pair", "ts", *own).agg(*[F.expr(f"{found(*v)} AS {n}") for n, v in wanted.items()])
    first, reactions = _from_near(pairs, span)
    texts = {k: v for part in reactions.values() for k, v in part.items()} | first
    return folded.selectExpr("pair", "ts", *[f"{text} AS `{name}`" for name, text in texts.items()])


def _near_prices(pairs: Sequence[tuple[int, int]], span: int, top: int) -> list[str]:
    """Aggregates over neighbour candles at ``_k`` steps: extremes and edge prices."""
    back = span // CANDLE_MINUTES
    out = [
        f"max(CASE WHEN _k BETWEEN {top - back + 1} AND {top} THEN high END) AS _hb",
        f"min(CASE WHEN _k BETWEEN {top - back + 1} AND {top} THEN low END) AS _lb",
        f"max(CASE WHEN _k = {-back} THEN open END) AS _ob",
    ]
    for start, end in pairs:
        lo, hi, s = start // CANDLE_MINUTES, end // CANDLE_MINUTES - 1, suffix(start, end)
        out += [
            f"max(CASE WHEN _k BETWEEN {lo} AND {hi} THEN high END) AS _h{s}",
            f"min(CASE WHEN _k BETWEEN {lo} AND {hi} THEN low END) AS _l{s}",
            f"max(CASE WHEN _k = {lo} THEN close END) AS _f{s}",
            f"max(CASE WHEN _k = {hi} THEN close END) AS _t{s}",
        ]
    return out


def _from_near(
    pairs: Sequence[tuple[int, int]], span: int
) -> tuple[dict[str, str], dict[tuple[int, int], dict[str, str]]]:
    """Before metrics, and reaction metrics by horizon, out of those aggregates.

    The candle's own prices are named ``_open0`` and so on.
    """
    before = {
        f"volatility_{span}_0_before": "coalesce(_hb, _high0) - coalesce(_lb, _low0)",
        f"pips_agg_{span}_0_before": "_open0 - coalesce(_ob, _open0)",
    }
    after = {}
    for start, end in pairs:
        s = suffix(start, end)
        prices = [
            f"coalesce(_{short}{s}, _{own}0)"
            for short, own in (("h", "high"), ("l", "low"), ("f", "close"), ("t", "close"))
        ]
        after[start, end] = reaction(s, *prices, "_close0")
    return before, after


def _time_features(
    candles: DataFrame,
    pairs: Sequence[tuple[int, int]],
    span: int,
    include_release_candle: bool,
) -> DataFrame:
    """As above with frames of minutes: a gap shortens a frame.

    Every candle is sent to the slots it is a neighbour of, so the join is an
    equi join and the work is (candles x frame length).
    """
    reach = max(end for _, end in pairs) // CANDLE_MINUTES - 1
    back = span // CANDLE_MINUTES
    sent = candles.withColumn("_k", F.explode(F.sequence(F.lit(-back), F.lit(reach)))).withColumn(
        "ts", F.col("ts") - minutes((F.col("_k") * CANDLE_MINUTES).cast("int"))
    )
    top = 0 if include_release_candle else -1
    near = sent.groupBy("pair", "ts").agg(*[F.expr(t) for t in _near_prices(pairs, span, top)])
    own = candles.withColumns({f"_{c}0": F.col(c) for c in PRICES})
    before, after = _from_near(pairs, span)
    texts = {k: v for part in after.values() for k, v in part.items()} | before
    return own.join(near, ["pair", "ts"], "left").selectExpr(
        *candles.columns, *[f"{text} AS {name}" for name, text in texts.items()]
    )


def needed_candle_join(
    instants: DataFrame,
    candles: DataFrame,
    pairs: Sequence[tuple[int, int]] | None = None,
    span: int = BEFORE_MINUTES,
) -> DataFrame:
    """The same features for given instants only, in long form.

    ``instants`` has (pair, ts).  Each distinct instant is looked up once, its
    candle numbers are listed and joined back by (pair, candle_no), so the work
    grows with the instants and no key is hot.  One row per instant and horizon.
    """
    pairs = horizons() if pairs is None else pairs
    numbered = number_candles(candles)
    reach = max(end for _, end in pairs) // CANDLE_MINUTES - 1
    back = span // CANDLE_MINUTES
    at = instants.select("pair", "ts").distinct().join(numbered, ["pair", "ts"])
    own = [f"_{c}0" for c in PRICES]
    wanted = at.select(
        "pair",
        "ts",
        *[F.col(c).alias(f"_{c}0") for c in PRICES],
        F.explode(F.sequence(F.lit(-back), F.lit(reach))).alias("_k"),
        (F.col("candle_no") + F.col("_k")).alias("candle_no"),
    )
    # 60 rows per instant come together here and are folded map-side.
    folded = (
        wanted.join(numbered.drop("ts"), ["pair", "candle_no"])
        .groupBy("pair", "ts", *own)
        .agg(*[F.expr(t) for t in _near_prices(pairs, span, 0)])
    )
    before, after = _from_near(pairs, span)
    rows = []
    for (start, end), texts in after.items():
        fields = [f"'{m}', {texts[m + suffix(start, end)]}" for m in AFTER_METRICS]
        rows.append(f"named_struct('from_min', {start}, 'to_min', {end}, {', '.join(fields)})")
    return folded.selectExpr(
        "pair",
        "ts",
        *[f"{text} AS {name}" for name, text in before.items()],
        f"inline(array({', '.join(rows)}))",
    )
