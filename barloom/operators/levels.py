"""Sequential readings of one name's bars: pivots, support levels, zones, rallies, dips. One grouped map a ticker.

The functions on arrays use only bars up to the last one given, so a shorter history gives what was known then."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.ranks import ratio


def plateaus(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of runs of equal values that are higher than what is beside them."""
    change = np.flatnonzero(np.diff(v) != 0)
    first, last = np.r_[0, change + 1], np.r_[change, len(v) - 1]
    level = v[first]
    inner = np.arange(1, len(first) - 1)
    top = inner[(level[inner] > level[inner - 1]) & (level[inner] > level[inner + 1])]
    return first[top], last[top]


def apart(place: list[int], rank: list[int], distance: int) -> list[bool]:
    """Which places stay if each, in the order of rank, removes those nearer than distance."""
    alive = [True] * len(place)
    for i in rank:
        if alive[i]:  # only neighbours can be near
            for step in (-1, 1):
                j = i + step
                while 0 <= j < len(place) and abs(place[j] - place[i]) < distance:
                    alive[j] = False
                    j += step
    return alive


def drop(v: list[float], p: int, depth: float, way: int, end: int) -> int | None:
    """The first bar on one side of p that lies deep enough under it; none where a higher bar or the end of the reach is first."""
    top, floor, j = v[p], v[p], p
    while top - floor < depth:
        j += way
        if (j - end) * way > 0 or v[j] > top:
            return None
        if v[j] < floor:
            floor = v[j]
    return j


def peaks(x: np.ndarray, prominence: float, distance: int, wlen: int = 252) -> np.ndarray:
    """Places of local maxima (the middle of a plateau), kept highest first at least `distance` apart, whose drop on both
    sides, within wlen, is `prominence` or more. Missing values are passed over."""
    keep = np.flatnonzero(np.isfinite(x))
    return keep[Peaks(x[keep], distance, wlen).within(0, len(keep), prominence)]


class Peaks:
    """The peaks of any stretch of one row of numbers. Plateaus, what stays of them and how far the drops beside them lie are
    worked out once; a stretch cuts off what reaches over its ends and looks again at neighbours of the cut alone."""

    def __init__(self, v: np.ndarray, distance: int, wlen: int = 252):
        self.v, self.distance, self.half, self.drops = v.tolist(), distance, wlen // 2, {}
        self.first, self.last = plateaus(v) if len(v) >= 5 else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        found = (self.first + self.last) // 2
        self.place, rank = found.tolist(), np.argsort(v[found], kind="stable")[::-1].tolist()
        self.alive, self.turn = apart(self.place, rank, distance), dict(zip(rank, range(len(rank)), strict=True))

    def again(self, alive: list[bool], a: int, i: int, j: int) -> None:
        """Sets alive, which begins at a, for the peaks i to j, none of which has a neighbour outside."""
        rank = sorted(range(j - i), key=lambda k: self.turn[i + k])
        alive[i - a : j - a] = apart(self.place[i:j], rank, self.distance)

    def deep(self, p: int, prominence: float, begin: int, end: int) -> bool:
        if (p, prominence) not in self.drops:
            left = drop(self.v, p, prominence, -1, max(0, p - self.half))
            self.drops[p, prominence] = left, None if left is None else drop(self.v, p, prominence, 1, min(len(self.v) - 1, p + self.half))
        left, right = self.drops[p, prominence]
        return left is not None and right is not None and left >= begin and right < end

    def within(self, begin: int, end: int, prominence: float) -> np.ndarray:
        """Places of the peaks of v[begin:end], counted from the beginning of v."""
        a, b = int(np.searchsorted(self.first, begin, side="right")), int(np.searchsorted(self.last, end - 1, side="left"))
        if end - begin < 5 or a >= b:
            return np.zeros(0, np.int64)
        place, alive = self.place, self.alive[a:b]
        near = lambda k: place[k] - place[k - 1] < self.distance
        if a and near(a):
            self.again(alive, a, a, next((k for k in range(a + 1, b) if not near(k)), b))
        if b < len(place) and near(b):
            self.again(alive, a, next((k for k in range(b - 1, a, -1) if not near(k)), a), b)
        return np.array([p for p, on in zip(place[a:b], alive, strict=True) if on and self.deep(p, prominence, begin, end)], np.int64)


def true_ranges(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    before = np.r_[np.nan, close[:-1]]
    return np.fmax(high - low, np.fmax(np.abs(high - before), np.abs(low - before)))


def smoothed(tr: np.ndarray) -> np.ndarray:
    """Mean true range so far, of each column where there are several."""
    return pd.DataFrame(tr).ewm(alpha=1 / 14, adjust=False).mean().to_numpy().reshape(tr.shape)


def scale(high: np.ndarray, low: np.ndarray, close: np.ndarray, bounds: tuple[float, float] = (0.015, 0.09)) -> float:
    """Median true range over price in the last 250 bars, held within bounds."""
    return float(np.clip(np.median((smoothed(true_ranges(high, low, close)) / close)[-250:]), *bounds))


#: Pivots: multiples of the scale, least drop, bars between them, bars that confirm one.
RISE, LEAST_DROP, DISTANCE, CONFIRM = 3.0, 0.06, 5, 6


def pivot_places(high: np.ndarray, low: np.ndarray, close: np.ndarray, k: float = RISE, floor: float = LEAST_DROP, distance: int = DISTANCE, confirm: int = CONFIRM) -> tuple[np.ndarray, np.ndarray]:
    """Peaks of highs and troughs of lows, on log prices; the newest `confirm` bars can hold none."""
    need = max(floor, k * scale(high, low, close))
    last = len(close) - 1 - confirm
    tops, bottoms = peaks(np.log(high), need, distance), peaks(-np.log(low), need, distance)
    return tops[tops <= last], bottoms[bottoms <= last]


def clusters(prices: np.ndarray, weights: np.ndarray, tolerance: float = 0.025, least: int = 1, between: tuple[float, float] | None = None) -> list[tuple[float, int]]:
    """(level, members): the price with the most weight within tolerance takes its neighbours; then again without them. Ends
    where no cluster of `least` members can follow, or no price that is left lies between two bounds.

    Neighbours are bits of one number a price. Weights are counted by kind; where that leaves several prices, sums of doubles
    decide as if all were summed."""
    at, w, out = np.log(prices), weights, []
    near = np.abs(at[:, None] - at[None, :]) <= tolerance
    bits = lambda rows: [int.from_bytes(x.tobytes(), "little") for x in np.packbits(rows, axis=1, bitorder="little")]
    beside, held, still = bits(near), near * w[None, :], np.ones(len(at))
    kinds = [(float(x), bits((w == x)[None, :])[0]) for x in np.unique(w)]
    free = (1 << len(at)) - 1
    wanted = free if between is None else bits(((prices >= between[0]) & (prices <= between[1]))[None, :])[0]
    mass = [sum(x * (m & kind).bit_count() for x, kind in kinds) for m in beside]
    few = least * float(w.min()) - 1e-9
    while free & wanted:
        top = max(mass) - 1e-9
        if top < few:
            break
        best = [j for j, x in enumerate(mass) if x >= top]
        if len(best) > 1 and any(beside[j] & free != beside[best[0]] & free for j in best):
            best = [best[int(np.argmax((held[best] * still).sum(axis=1)))]]
        mine, others, taken = beside[best[0]] & free, 0, []
        left = mine
        while left:
            j = (left & -left).bit_length() - 1
            left &= left - 1
            taken.append(j)
            others |= beside[j]
            mass[j] = -1.0
        free &= ~mine
        still[taken] = 0
        others &= free  # only these have lost a neighbour
        while others:
            j = (others & -others).bit_length() - 1
            others &= others - 1
            m = beside[j] & free
            mass[j] = sum([x * (m & kind).bit_count() for x, kind in kinds])
        if len(taken) >= least:
            share = w[taken]
            out.append((float(np.exp((at[taken] * share).sum() / share.sum())), len(taken)))
    return out


def near_level(low: np.ndarray, close: np.ndarray, level: float) -> np.ndarray:
    """Bars whose low nears the level and whose close holds it."""
    return (low <= level * 1.025) & (low >= level * 0.97) & (close >= level * 0.98)


def visit_spans(low: np.ndarray, close: np.ndarray, level: float, gap: int = 8) -> list[tuple[int, int]]:
    """First and last bars of visits: bars whose low nears the level and whose close holds it, no more than gap apart."""
    hit = np.flatnonzero(near_level(low, close, level))
    if not len(hit):
        return []
    cut = np.flatnonzero(np.diff(hit) > gap)
    return list(zip(hit[np.r_[0, cut + 1]].tolist(), hit[np.r_[cut, len(hit) - 1]].tolist(), strict=True))


def bounce_history(close: np.ndarray, high: np.ndarray, visits: list[tuple[int, int]], level: float, horizon: int = 40) -> list[float]:
    """Best rise over the level in the horizon after each visit; visits inside an earlier one's horizon belong to it, and
    one whose horizon is not over does not count."""
    out, free = [], -1
    for first, _ in visits:
        if first <= free:
            continue
        free = first + horizon
        if free < len(close):
            out.append(float(high[first + 1 : free + 1].max() / level - 1))
    return out


def level_rows(g: pd.DataFrame) -> list[tuple[float, int]]:
    high, low, close = (g[c].to_numpy(float) for c in ("high", "low", "close"))
    return levels_of(high, low, *pivot_places(high, low, close))


def levels_of(high: np.ndarray, low: np.ndarray, tops: np.ndarray, bottoms: np.ndarray, between: tuple[float, float] | None = None) -> list[tuple[float, int]]:
    """Levels of two members or more among pivots; with bounds, at least those between them."""
    prices, weights = np.r_[low[bottoms], high[tops]], np.r_[np.ones(len(bottoms)), np.full(len(tops), 0.7)]
    return clusters(prices, weights, least=2, between=between) if len(prices) else []


class Readings:
    """One name's bars, read for levels under the price again and again: up to any bar, all or the last n of them. Logs,
    ranges and peaks are worked out once for all readings. Equal to level_rows of those bars alone."""

    def __init__(self, high: np.ndarray, low: np.ndarray, close: np.ndarray):
        self.high, self.low, self.close, self.scales = high, low, close, {}
        self.tr = true_ranges(high, low, close)
        self.whole = smoothed(self.tr) / close
        logs = np.log(high), -np.log(low)
        self.gaps = not (np.isfinite(logs).all() and np.isfinite(close).all())  # missing prices are passed over by each reading
        self.tops, self.bottoms = (Peaks(x, DISTANCE) for x in logs)

    def prepare(self, n: int, ends: list[int]) -> None:
        """Scales of the last n bars before each end, which begin anew and so differ from those of all bars."""
        ends = [e for e in ends if e > n]
        if ends:
            rows = np.array(ends) - n + np.arange(n)[:, None]
            tr = self.tr[rows]
            tr[0] = (self.high - self.low)[rows[0]]
            self.scales |= {(e - n, e): x for e, x in zip(ends, np.median((smoothed(tr) / self.close[rows])[-250:], axis=0).tolist(), strict=True)}

    def under(self, begin: int, end: int, reach: float) -> list[float]:
        """Levels at or under the last close of the bars begin to end, not farther than reach."""
        if self.gaps:
            tops, bottoms = (x + begin for x in pivot_places(*(x[begin:end] for x in (self.high, self.low, self.close))))
        else:
            found = self.scales[begin, end] if begin else float(np.median(self.whole[:end][-250:]))
            need = max(LEAST_DROP, RISE * min(max(found, 0.015), 0.09))
            tops, bottoms = (x.within(begin, end, need) for x in (self.tops, self.bottoms))
        last, price = end - 1 - CONFIRM, self.close[end - 1]
        # A level in the reach, which is wider than a cluster, has a member there.
        rows = levels_of(self.high, self.low, tops[tops <= last], bottoms[bottoms <= last], (price / (1 + reach) * (1 - 1e-9), price * (1 + 1e-9)))
        return [x for x, _ in rows if 0 <= price / x - 1 <= reach]


def _history(bars: DataFrame) -> DataFrame:
    return bars.select("ticker", "session", "high", "low", "close").where("high > 0 and low > 0 and close > 0")


def pivots(bars: DataFrame) -> DataFrame:
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("session").reset_index(drop=True)
        tops, bottoms = pivot_places(*(g[c].to_numpy(float) for c in ("high", "low", "close")))
        parts = [pd.DataFrame({"ticker": g["ticker"][at], "session": g["session"][at], "kind": kind, "price": g[column][at]}) for at, kind, column in ((tops, "peak", "high"), (bottoms, "trough", "low"))]
        return pd.concat(parts)

    return _history(bars).groupBy("ticker").applyInPandas(run, "ticker long, session date, kind string, price double")


def levels(bars: DataFrame) -> DataFrame:
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("session").reset_index(drop=True)
        return pd.DataFrame([(g["ticker"].iloc[0], price, n) for price, n in level_rows(g)], columns=["ticker", "level", "members"])

    return _history(bars).groupBy("ticker").applyInPandas(run, "ticker long, level double, members long")


def zones(bars: DataFrame, reach: float = 0.16, least: int = 2, most: int = 8) -> DataFrame:
    """The nearest levels below the last price that were visited twice or more, with what followed the visits."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("session").reset_index(drop=True)
        high, low, close = (g[c].to_numpy(float) for c in ("high", "low", "close"))
        rows = []
        for level, _ in level_rows(g):
            distance = close[-1] / level - 1
            visits = visit_spans(low, close, level)
            if 0 <= distance <= reach and len(visits) >= least:
                rises = bounce_history(close, high, visits, level)
                rows.append((g["ticker"].iloc[0], level, distance * 100, len(visits), len(rises), float(np.median(rises)) if rises else None, len(close) - 1 - visits[-1][1]))
        rows.sort(key=lambda x: (x[2], x[1]))
        return pd.DataFrame(rows[:most], columns=["ticker", "level", "dist_pct", "touches", "bounces", "bounce_median", "bars_since_touch"])

    return _history(bars).groupBy("ticker").applyInPandas(run, "ticker long, level double, dist_pct double, touches long, bounces long, bounce_median double, bars_since_touch long")


def suspects(bars: DataFrame, leap: float = 0.85, crowd: float = 3.0, share: float = 0.05) -> DataFrame:
    """(ticker, suspect): a leap of the close without volume, or a last close under a twentieth of the year's high, as a
    split that is not adjusted leaves behind."""
    name = Window.partitionBy("ticker")
    by_day = name.orderBy("session")
    x = bars.withColumn("__v", F.abs(F.ln(ratio(F.col("close"), F.lag("close").over(by_day))))).withColumn("__top", F.max("high").over(by_day.rowsBetween(-249, 0))).withColumn("__mid", F.percentile("volume", F.lit(0.5)).over(name))
    leapt = F.bool_or(F.coalesce((F.col("__v") > leap) & (F.col("volume") <= crowd * F.col("__mid")), F.lit(False)))
    fallen = F.coalesce(F.max_by(ratio(F.col("close"), F.col("__top")), "session") < share, F.lit(False))
    return x.groupBy("ticker").agg((leapt | fallen).alias("suspect"))


def zone_scan(bars: DataFrame, **limits) -> DataFrame:
    """Every name: its zones, or one row that says it has no support, or one that its prices are suspect and were not read.
    (ticker, level, dist_pct, touches, bounces, bounce_median, bars_since_touch, no_support, suspect)"""
    told = suspects(bars)
    odd = told.where("suspect").select("ticker")
    found = zones(bars.join(odd, "ticker", "left_anti"), **limits).select("*", F.lit(False).alias("no_support"), F.lit(False).alias("suspect"))
    empty = told.where("not suspect").select("ticker").join(found.select("ticker").distinct(), "ticker", "left_anti").select("ticker", F.lit(True).alias("no_support"), F.lit(False).alias("suspect"))
    marked = odd.select("ticker", F.lit(False).alias("no_support"), F.lit(True).alias("suspect"))
    return found.unionByName(empty.unionByName(marked), allowMissingColumns=True)


def zigzag(close: np.ndarray, turn: float = 0.10) -> list[int]:
    """Turning places: the price has come back by `turn` from the extreme since the last one."""
    out, way, best = [0], 0, 0
    for i in range(1, len(close)):
        if way >= 0 and close[i] > close[best] or way <= 0 and close[i] < close[best]:
            if way == 0 and abs(close[i] / close[0] - 1) >= turn:
                way = 1 if close[i] > close[0] else -1
            best = i if way else best
        elif way and (close[i] / close[best] - 1) * way <= -turn:
            out.append(best)
            way, best = -way, i
        elif way == 0 and abs(close[i] / close[0] - 1) >= turn:
            way, best = (1 if close[i] > close[0] else -1), i
    return out


def rallies(bars: DataFrame, turn: float = 0.10, least: float = 0.20) -> DataFrame:
    """Rises of `least` or more between turning places."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("session").reset_index(drop=True)
        c = g["close"].to_numpy(float)
        places = zigzag(c, turn)
        rows = [(g["ticker"].iloc[0], g["session"][a], g["session"][b], c[b] / c[a] - 1) for a, b in zip(places, places[1:], strict=False) if c[b] / c[a] - 1 >= least]
        return pd.DataFrame(rows, columns=["ticker", "start", "end", "gain"])

    return _history(bars).groupBy("ticker").applyInPandas(run, "ticker long, start date, end date, gain double")


def dips(bars: DataFrame, depth: float = 0.15, window: int = 63) -> DataFrame:
    """First closes at `depth` below the window's high, and whether that high is back within the window after; the next
    dip begins after that."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("session").reset_index(drop=True)
        c = g["close"].to_numpy(float)
        top = g["close"].rolling(window, min_periods=window).max().to_numpy()
        rows, free = [], 0
        for i in np.flatnonzero(c <= (1 - depth) * top):
            if i < free:
                continue
            after = c[i + 1 : i + 1 + window]
            back = np.flatnonzero(after >= top[i])
            end = i + 1 + (int(back[0]) if len(back) else min(window, len(after)) - 1)
            rows.append((g["ticker"].iloc[0], g["session"][i], g["session"][max(i, end)], bool(len(back))))
            free = end + 1
        return pd.DataFrame(rows, columns=["ticker", "start", "end", "recovered"])

    return _history(bars).groupBy("ticker").applyInPandas(run, "ticker long, start date, end date, recovered boolean")
