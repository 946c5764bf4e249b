"""Technical indicators: window frames, and one kernel for all recurrences.

All frames share one partitioning and order, so a symbol's bars are shuffled
and sorted once; the kernel is grouped by the same key and needs no other
shuffle.  Values are null until there is enough history.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def series():
    """A symbol's bars in order."""
    return Window.partitionBy("symbol").orderBy("trade_date")


def last_rows(n: int):
    return series().rowsBetween(-(n - 1), 0)


def enough(value: Column, n: int) -> Column:
    """Null until row n of the series."""
    return F.when(F.row_number().over(series()) >= n, value)


def sma(column: str, n: int) -> Column:
    return enough(F.avg(column).over(last_rows(n)), n)


def frame_indicators(bars: DataFrame) -> DataFrame:
    """Bars with every indicator that a window frame can express."""
    previous, row = F.lag("close").over(series()), F.row_number().over(series())
    up, down = F.col("high") - F.lag("high").over(series()), F.lag("low").over(series()) - F.col("low")
    flat = F.col("high") - F.col("low")
    one = bars.withColumns(
        {
            "rn": row,
            "change": F.col("close") - previous,
            "change_percent": (F.col("close") - previous) / F.nullif(previous, F.lit(0.0)) * 100,
            "true_range": F.coalesce(F.greatest(flat, F.abs(F.col("high") - previous), F.abs(F.col("low") - previous)), flat),
            "plus_dm": F.when((up > down) & (up > 0), up).when(up.isNotNull(), 0.0),
            "minus_dm": F.when((down > up) & (down > 0), down).when(up.isNotNull(), 0.0),
            "typical": (F.col("high") + F.col("low") + F.col("close")) / 3,
            "sma_20": sma("close", 20),
            "sma_50": sma("close", 50),
            "bb_sigma": enough(F.stddev_pop("close").over(last_rows(20)), 20),
            "low_14": F.min("low").over(last_rows(14)),
            "high_14": F.max("high").over(last_rows(14)),
            "volume_ratio_prev": F.col("volume") / F.nullif(F.lag("volume").over(series()), F.lit(0)),
            "volume_ratio": enough(F.col("volume") / F.nullif(F.avg("volume").over(last_rows(20)), F.lit(0.0)), 20),
            "recent_high": F.max("high").over(last_rows(20)),
            "recent_low": F.min("low").over(last_rows(20)),
        }
    )
    spread = F.col("high_14") - F.col("low_14")
    gain, loss = F.greatest("change", F.lit(0.0)), F.greatest(-F.col("change"), F.lit(0.0))
    two = one.withColumns(
        {
            "bb_middle": F.col("sma_20"),
            "bb_upper": F.col("sma_20") + 2 * F.col("bb_sigma"),
            "bb_lower": F.col("sma_20") - 2 * F.col("bb_sigma"),
            "bb_width": F.when(F.col("sma_20") == 0, 0.0).otherwise(4 * F.col("bb_sigma") / F.nullif(F.col("sma_20"), F.lit(0.0))),
            "raw_k": F.when(spread == 0, 50.0).otherwise((F.col("close") - F.col("low_14")) / F.nullif(spread, F.lit(0.0)) * 100),
            "vwap": F.try_divide(F.sum(F.col("typical") * F.col("volume")).over(series()), F.sum("volume").over(series())),
            "vwap_14": enough(F.try_divide(F.sum(F.col("typical") * F.col("volume")).over(last_rows(14)), F.sum("volume").over(last_rows(14))), 14),
            "gain_14": F.sum(gain).over(last_rows(14)),
            "loss_14": F.sum(loss).over(last_rows(14)),
            "tr_14": F.sum("true_range").over(last_rows(14)),
            "pdm_14": F.sum("plus_dm").over(last_rows(14)),
            "mdm_14": F.sum("minus_dm").over(last_rows(14)),
        }
    )
    total = F.col("gain_14") + F.col("loss_14")
    plus, minus = F.try_divide(F.col("pdm_14"), F.col("tr_14")) * 100, F.try_divide(F.col("mdm_14"), F.col("tr_14")) * 100
    return two.withColumns(
        {
            "stoch_k": enough(F.col("raw_k"), 14),
            "stoch_d": enough(F.avg("raw_k").over(last_rows(3)), 16),
            # Fewer rows than asked for count as balanced.
            "rsi_simple": F.when(F.col("rn") < 15, 50.0).when(F.col("loss_14") == 0, 100.0).otherwise(100 * F.col("gain_14") / F.nullif(total, F.lit(0.0))),
            "atr_simple": enough(F.col("tr_14") / 14, 14),
            "plus_di_simple": enough(plus, 15),
            "minus_di_simple": enough(minus, 15),
            "adx_simple": enough(F.when(plus + minus == 0, 0.0).otherwise(100 * F.abs(plus - minus) / F.nullif(plus + minus, F.lit(0.0))), 15),
        }
    ).drop("raw_k", "low_14", "high_14", "gain_14", "loss_14", "tr_14", "pdm_14", "mdm_14", "bb_sigma", "typical")


RECURRENT = ("ema_12", "ema_26", "macd_line", "macd_signal", "macd_histogram", "prev_macd_line", "prev_macd_signal", "rsi_14", "atr_14", "plus_di", "minus_di", "adx_sum", "adx")


def _smooth(x: np.ndarray, begin: int, seed: float, decay: float, gain: float) -> np.ndarray:
    """y[begin] = seed; y[i] = decay * y[i-1] + gain * x[i]; NaN before."""
    y = np.full(len(x), np.nan)
    if begin < len(x):
        now = float(seed)
        out = [now]
        for value in x[begin + 1 :].tolist():
            now = decay * now + gain * value
            out.append(now)
        y[begin:] = out
    return y


def _ema(x: np.ndarray, n: int, begin: int = 0) -> np.ndarray:
    if len(x) < begin + n:
        return np.full(len(x), np.nan)
    a = 2.0 / (n + 1)
    return _smooth(x, begin + n - 1, x[begin : begin + n].mean(), 1 - a, a)


def recurrences(close: np.ndarray, tr: np.ndarray, pdm: np.ndarray, mdm: np.ndarray, n: int = 14) -> dict[str, np.ndarray]:
    """All recurrent indicators of one series, each from its own seed."""
    size = len(close)
    out = {"ema_12": _ema(close, 12), "ema_26": _ema(close, 26)}
    out["macd_line"] = out["ema_12"] - out["ema_26"]
    signal = _ema(out["macd_line"], 9, 25)
    signal[:34] = np.nan
    out["macd_signal"], out["macd_histogram"] = signal, out["macd_line"] - signal
    out["prev_macd_line"], out["prev_macd_signal"] = (np.append(np.nan, out[c][:-1]) for c in ("macd_line", "macd_signal"))
    change = np.diff(close, prepend=close[:1])
    if size > n:
        gain, loss = np.maximum(change, 0), np.maximum(-change, 0)
        up = _smooth(gain, n, gain[1 : n + 1].mean(), (n - 1) / n, 1 / n)
        down = _smooth(loss, n, loss[1 : n + 1].mean(), (n - 1) / n, 1 / n)
        with np.errstate(divide="ignore", invalid="ignore"):
            rsi = 100 - 100 / (1 + up / down)
        out["rsi_14"] = np.where(np.isnan(down), np.nan, np.where(down == 0, 100.0, rsi))
        atr = _smooth(tr, n - 1, tr[:n].mean(), (n - 1) / n, 1 / n)
        atr[:n] = np.nan
        out["atr_14"] = atr

        def wilder_sum(x):
            return _smooth(x, n, x[1 : n + 1].sum(), 1 - 1 / n, 1.0)

        s_tr, s_p, s_m = wilder_sum(tr), wilder_sum(pdm), wilder_sum(mdm)
        with np.errstate(divide="ignore", invalid="ignore"):
            plus, minus = np.where(s_tr != 0, s_p / s_tr * 100, 0.0), np.where(s_tr != 0, s_m / s_tr * 100, 0.0)
            dx = np.where(plus + minus != 0, np.abs(plus - minus) / (plus + minus) * 100, 0.0)
        dx[:n] = 0.0
        for name, value in (("plus_di", plus), ("minus_di", minus), ("adx_sum", wilder_sum(dx))):
            value[: 2 * n - 1] = np.nan
            out[name] = value
        out["adx"] = out["adx_sum"] / n
    return {c: out.get(c, np.full(size, np.nan)) for c in RECURRENT}


def recursive_indicators(frames: DataFrame) -> DataFrame:
    """Frames with EMA, MACD, RSI, ATR and ADX added, one pass per symbol.

    Columns that the recurrences don't read pass through as Arrow arrays.
    """
    schema = StructType([*frames.schema.fields, *[StructField(c, DoubleType()) for c in RECURRENT]])

    def run(bars: pa.Table) -> pa.Table:
        bars = bars.sort_by("trade_date")
        values = [pc.fill_null(pc.cast(bars.column(c), pa.float64()), 0.0).to_numpy() for c in ("close", "true_range", "plus_dm", "minus_dm")]
        for name, value in recurrences(*values).items():
            bars = bars.append_column(name, pa.array(value, mask=np.isnan(value)))
        return bars

    return frames.groupBy("symbol").applyInArrow(run, schema)


def technical(bars: DataFrame) -> DataFrame:
    """Every indicator on every row of every symbol."""
    return recursive_indicators(frame_indicators(bars))


def latest(df: DataFrame, key: str = "symbol", at: str = "trade_date") -> DataFrame:
    """The last row of each key; of columns of fixed width an aggregate by hash, without a sort."""
    return last_of(df, [key], at).select(df.columns)


def last_of(df: DataFrame, keys: list[str], at: str = "trade_date", columns: list[str] | None = None) -> DataFrame:
    """The keys, ``at`` and the columns (all, unless given) of the last row of each group."""
    named = [c for c in (df.columns if columns is None else columns) if c not in (*keys, at)]
    return df.groupBy(*keys).agg(F.max(at).alias(at), *[F.max_by(c, at).alias(c) for c in named])


def macd_cross() -> Column:
    line, signal, was, was_signal = (F.col(c) for c in ("macd_line", "macd_signal", "prev_macd_line", "prev_macd_signal"))
    return F.when((was <= was_signal) & (line > signal), "bullish").when((was >= was_signal) & (line < signal), "bearish")


def ma_cross(fast: str, slow: str) -> tuple[Column, Column]:
    """State (fast above slow) and event (the order flips from the row before)."""
    above = F.col(fast) > F.col(slow)
    before_fast, before_slow = F.lag(fast).over(series()), F.lag(slow).over(series())
    event = F.when(above & (before_fast <= before_slow), "golden").when((F.col(fast) < F.col(slow)) & (before_fast >= before_slow), "death")
    return above, event


def local_extrema(bars: DataFrame, order: int = 5, high: str = "high", low: str = "low") -> DataFrame:
    """is_max and is_min: strictly beyond each of up to ``order`` neighbours on both sides.

    The first and the last row never qualify.
    """
    before, after = series().rowsBetween(-order, -1), series().rowsBetween(1, order)
    top = (F.col(high) > F.max(high).over(before)) & (F.col(high) > F.max(high).over(after))
    bottom = (F.col(low) < F.min(low).over(before)) & (F.col(low) < F.min(low).over(after))
    return bars.withColumns({"is_max": F.coalesce(top, F.lit(False)), "is_min": F.coalesce(bottom, F.lit(False))})


def recent_rows(bars: DataFrame, rows: int) -> DataFrame:
    backwards = Window.partitionBy("symbol").orderBy(F.desc("trade_date"))
    return bars.withColumn("_n", F.row_number().over(backwards)).where(F.col("_n") <= rows).drop("_n")


def support_resistance(bars: DataFrame, last: int | None = 50, top: int = 3, order: int = 5, close_based: bool = False) -> DataFrame:
    """The ``top`` highest maxima and the ``top`` highest minima of the last sessions.

    With ``close_based`` the whole history of closes counts, and the lowest minima.
    """
    high, low = ("close", "close") if close_based else ("high", "low")
    some = bars if last is None or close_based else recent_rows(bars, last)
    marked = local_extrema(some, order, high, low)
    return marked.groupBy("symbol").agg(
        F.slice(F.sort_array(F.collect_list(F.when(F.col("is_max"), F.col(high))), asc=False), 1, top).alias("resistance"),
        F.slice(F.sort_array(F.collect_list(F.when(F.col("is_min"), F.col(low))), asc=close_based), 1, top).alias("support"),
    )


def support_bands(bars: DataFrame) -> DataFrame:
    """Bands of 3 and 5 % around the last close, and the extremes of the history."""
    close = F.max_by("close", "trade_date")
    return bars.groupBy("symbol").agg(
        *[(close * f).alias(n) for n, f in (("support_3", 0.97), ("support_5", 0.95), ("resistance_3", 1.03), ("resistance_5", 1.05))], F.max("close").alias("highest"), F.min("close").alias("lowest")
    )


FIBONACCI = (0.236, 0.382, 0.5, 0.618, 0.786)


def fibonacci(high: Column, low: Column, down: bool = False) -> dict[str, Column]:
    """Levels up from the low, or, with ``down``, down from the high (0 and 1 included)."""
    levels = (0.0, *FIBONACCI, 1.0) if down else FIBONACCI
    return {f"fib_{round(r * 1000)}": high - r * (high - low) if down else low + r * (high - low) for r in levels}


def blocked_ema(bars: DataFrame, n: int, block: int = 365) -> DataFrame:
    """EMA of series too long for one task, by prefix-combining affine maps.

    A block is a symbol's rows of ``block`` days.  Its first row number follows
    from the counts of the blocks before it, so no task sees a whole series.
    Each block is one map y -> a * y + b; the few maps of a symbol are combined
    in order, and each block is then run from its own start.  The seed is the
    average of the first ``n`` rows, which lie in at most ``n`` blocks.
    """
    alpha, blocks = 2.0 / (n + 1), Window.partitionBy("symbol").orderBy("_block")
    x = bars.select("symbol", "trade_date", F.col("close").cast("double").alias("close"), F.floor(F.unix_date(F.to_date("trade_date")) / block).alias("_block"))
    before = blocks.rowsBetween(Window.unboundedPreceding, -1)
    counts = x.groupBy("symbol", "_block").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    numbered = x.join(counts, ["symbol", "_block"])
    first = numbered.where(F.col("_base") < n).withColumn("_i", F.row_number().over(series())).where(F.col("_i") <= n)
    seeds = first.groupBy("symbol").agg(F.sum("close").alias("_sum"), F.count("*").alias("_n")).where(F.col("_n") == n).select("symbol", (F.col("_sum") / n).alias("_seed"))
    ready = numbered.join(seeds, "symbol")

    def rows_of(block: pa.Table) -> tuple[pa.Table, list[float], int]:
        """The block in order, its closes from row n - 1 on (the seed for that one), and that row's place or one below zero."""
        block = block.sort_by("trade_date")
        base, seed = block.column("_base")[0].as_py(), block.column("_seed")[0].as_py()
        at = n - 1 - base
        block = block.slice(max(0, at))
        closes = block.column("close").to_pylist()
        if closes and at >= 0:
            closes[0] = seed
        return block, closes, at

    def one_map(key: tuple, block: pa.Table) -> pa.Table:
        _, closes, at = rows_of(block)
        a, b = 1.0, 0.0
        for i, v in enumerate(closes):
            a, b = (0.0, v) if i == 0 and at >= 0 else (a * (1 - alpha), b + (v - b) * alpha)
        return pa.table({"symbol": [key[0].as_py()], "_block": [key[1].as_py()], "a": [a], "b": [b]})

    def combine(key: tuple, maps: pa.Table) -> pa.Table:
        maps, starts, y = maps.sort_by("_block"), [], 0.0
        for a, b in zip(maps.column("a").to_pylist(), maps.column("b").to_pylist(), strict=True):
            starts.append(y)
            y = a * y + b
        return maps.select(["symbol", "_block"]).append_column("_start", pa.array(starts, pa.float64()))

    def run(key: tuple, block: pa.Table) -> pa.Table:
        y = block.column("_start")[0].as_py()
        block, closes, at = rows_of(block)
        out = []
        for i, v in enumerate(closes):
            y = v if i == 0 and at >= 0 else y + (v - y) * alpha
            out.append(y)
        return block.select(["symbol", "trade_date"]).append_column("ema", pa.array(out, pa.float64()))

    maps = ready.groupBy("symbol", "_block").applyInArrow(one_map, "symbol string, _block long, a double, b double")
    starts = maps.groupBy("symbol").applyInArrow(combine, "symbol string, _block long, _start double")
    return ready.join(starts, ["symbol", "_block"]).groupBy("symbol", "_block").applyInArrow(run, StructType([bars.schema["symbol"], bars.schema["trade_date"], StructField("ema", DoubleType())]))
