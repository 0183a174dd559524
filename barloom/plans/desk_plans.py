"""Queries of the bounce screen and of series that need a name's whole history: levels, runs, floors, outcomes, exits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions.ranks import ratio
from barloom.operators import bounce as bo
from barloom.operators import events as ev
from barloom.operators import windows as w
from barloom.plans.catalog import query, r
from barloom.sources.roles import BARS, CALENDAR, SECTORS, bars, calendar, sectors, table, walk_bars

T = "PARTITION BY ticker ORDER BY session"
KEY = ["ticker", "session"]
C = F.col

# One row a name: what the score queries take as their inputs.
STATS = "st AS (SELECT ticker, count(*) AS n, max(high) AS hi, min(low) AS lo, avg(close) AS md, sum(volume) AS vol, min(close) AS lc, arg_max(close, session) AS c FROM bars GROUP BY 1)"


def stats(spark, d):
    return bars(spark, d).groupBy("ticker").agg(F.count("*").alias("n"), F.max("high").alias("hi"), F.min("low").alias("lo"), F.avg("close").alias("md"), F.sum("volume").alias("vol"), F.min("close").alias("lc"), F.max_by("close", "session").alias("c"))


def clamp(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


# ---- scores of the screen


@query("F20_level_quality", f"WITH {BARS}, {STATS} SELECT ticker, round(0.32 * least((n % 7) / 5.0, 1.0) + 0.26 * (n % 2) + 0.16 * least(n * 3 / 365.0, 1.0) + 0.10 * (1 - least(n * 2 / 504.0, 1.0)) + 0.16 * least(md / lc / 3.0, 1.0), 6) AS quality FROM st")
def level_quality(spark, d):
    return stats(spark, d).select("ticker", r(bo.level_quality(C("n") % 7, C("n") % 2, C("n") * 3, C("n") * 2, ratio(C("md"), C("lc"))), "quality"))


@query("F27_retrace", f"WITH {BARS}, {STATS} SELECT ticker, round(1 - lc / hi, 6) AS dd_from_peak, round((hi - lc) / (hi - lo), 6) AS retrace_of_run, round(1 - lc / lo, 6) AS undercut, round(1 - c / lo, 6) AS undercut_close FROM st")
def retrace(spark, d):
    parts = bo.retrace(C("hi"), C("lo"), C("lc"), C("c"))
    return stats(spark, d).select("ticker", *[r(v, k) for k, v in parts.items()])


@query("F29_volume_signature", f"""WITH {BARS}, m AS (SELECT ticker, session, low, volume, row_number() OVER ({T}) AS k, count(*) OVER (PARTITION BY ticker) AS n, median(volume) OVER ({T} ROWS 59 PRECEDING) AS base, median(volume) OVER ({T} ROWS 5 PRECEDING) AS near, median(volume) OVER ({T} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS recent FROM bars),
l AS (SELECT ticker, min(k) AS k FROM (SELECT ticker, k, low, min(low) OVER (PARTITION BY ticker) AS least FROM m WHERE k > n - 40) WHERE low = least GROUP BY 1), x AS (SELECT m.ticker, any_value(base) FILTER (m.k = l.k) AS base, any_value(near) FILTER (m.k = l.k) AS near, max(volume) FILTER (m.k > l.k) AS after, any_value(volume) FILTER (m.k = n) AS last, any_value(recent) FILTER (m.k = n) AS recent FROM m JOIN l USING (ticker) GROUP BY 1)
SELECT ticker, round(near / base, 6) AS dry, round(coalesce(after / base, 0), 6) AS expand, round(last / recent, 6) AS today, round(0.35 * {clamp("(0.95 - near / base) / 0.35")} + 0.40 * {clamp("(coalesce(after / base, 0) - 1.0) / 1.2")} + 0.25 * {clamp("(last / recent - 0.9) / 0.9")}, 6) AS volume_score FROM x""")
def volume_signature(spark, d):
    """Volume at the low of the last 40 bars, against the 60 bars up to that low."""
    med = lambda a, b: F.percentile("volume", F.lit(0.5)).over(w.rows(a, b))
    name = Window.partitionBy("ticker")
    m = bars(spark, d).select(*KEY, "low", "volume", F.row_number().over(w.order()).alias("k"), F.count("*").over(name).alias("n"), med(-59, 0).alias("base"), med(-5, 0).alias("near"), med(-20, -1).alias("recent"))
    m = m.withColumn("at", F.min(F.when(C("k") > C("n") - 40, F.struct("low", "k"))).over(name)["k"])
    here, last = C("k") == C("at"), C("k") == C("n")
    x = m.groupBy("ticker").agg(*[F.max(F.when(t, C(v))).alias(a) for t, v, a in ((here, "base", "base"), (here, "near", "near"), (C("k") > C("at"), "volume", "after"), (last, "volume", "last"), (last, "recent", "recent"))])
    dry, expand, today = ratio(C("near"), C("base")), F.coalesce(ratio(C("after"), C("base")), F.lit(0.0)), ratio(C("last"), C("recent"))
    return x.select("ticker", r(dry, "dry"), r(expand, "expand"), r(today, "today"), r(bo.volume_score(dry, expand, today), "volume_score"))


LQ = clamp("(log10(greatest(vol * md, 1)) - log10(2e6)) / (log10(1e8) - log10(2e6))")
SCORE = f"""100.0 * (20 * {clamp("md / hi")} + 20 * {clamp("lc / md")} + 12 * {clamp("least(((hi - c) / (hi - lo) - 0.78) / (0.90 - 0.78), (1.12 - (hi - c) / (hi - lo)) / (1.12 - 1.02))")}
 + 12 * (0.65 * {clamp("(hi / lo - 2.20) / 0.8")} + 0.35 * {clamp("(hi / md - 1.25) / 3.0")}) + 9 * {clamp("lc / c")} + 7 * (0.65 * {clamp("1 - abs(lc / lo - 1) / 0.045")} + 0.35 * {clamp("1 - (md / lc - 1) / 0.35")})
 + 6 * {clamp("least((md / lc - 0.60) / 1.15, (6.50 - md / lc) / 2.50)")} + 6 * {LQ} + 8 * (CASE WHEN n % 2 = 0 THEN {clamp("(log10(vol * md * 50) - log10(1e8)) / (log10(2e11) - log10(1e8))")} ELSE {LQ} * 0.6 END)) / 100"""


@query("F31_composite", f"WITH {BARS}, {STATS}, s AS (SELECT ticker, {SCORE} AS s FROM st) SELECT ticker, round(s, 5) AS score, CASE WHEN s >= 75 THEN 'STRONG' WHEN s >= 60 THEN 'GOOD' WHEN s >= 45 THEN 'MARGINAL' ELSE 'WEAK' END AS band FROM s")
def composite(spark, d):
    part = lambda a, b: bo.clip(ratio(C(a), C(b)), 0.0, 1.0)
    cap = F.when(C("n") % 2 == 0, C("vol") * C("md") * 50)
    s = bo.composite(part("md", "hi"), ratio(C("hi") - C("c"), C("hi") - C("lo")), ratio(C("hi"), C("lo")), ratio(C("hi"), C("md")), 100 * part("lc", "md"), part("lc", "c"), ratio(C("lc"), C("lo")) - 1, ratio(C("md"), C("lc")) - 1, bo.stage_fit(ratio(C("md"), C("lc"))), C("vol") * C("md"), cap)
    return stats(spark, d).withColumn("s", s).select("ticker", r("s", "score", 5), bo.score_band(C("s")).alias("band"))


GRADE = "CASE WHEN n % 6 >= 4 AND n >= 60 AND md / lc - 1 <= 0.08 THEN 'A' WHEN n % 6 >= 3 AND n >= 30 AND md / lc - 1 <= 0.12 THEN 'B' WHEN n % 6 >= 2 AND md / lc - 1 <= 0.20 THEN 'C' WHEN n % 6 >= 2 THEN 'C' ELSE 'D' END"


@query("I9_support_grade", f"WITH {BARS}, {STATS} SELECT ticker, {GRADE} AS grade FROM st")
def support_grade(spark, d):
    return stats(spark, d).select("ticker", bo.support_grade(C("n") % 6, C("n"), ratio(C("md"), C("lc")) - 1).alias("grade"))


@query("I10_bucket", f"""WITH {BARS}, {STATS}, g AS (SELECT ticker, {GRADE} AS grade, 9 * (c - lo) / (hi - lo) AS ext, vol * md * 20 AS adv FROM st), s AS (SELECT *, CASE WHEN ext < 1 THEN 'STILL_TESTING' WHEN ext < 1.75 THEN 'TURNING' WHEN ext < 5 THEN 'CONFIRMED' WHEN ext < 8 THEN 'EXTENDED' ELSE 'GONE' END AS stage, CASE WHEN adv < 5e6 THEN 'OK' WHEN adv < 25e6 THEN 'GOOD' ELSE 'DEEP' END AS tier FROM g)
SELECT ticker, stage, tier, CASE WHEN stage IN ('EXTENDED', 'GONE') THEN 'LATE' WHEN grade IN ('A', 'B') AND stage IN ('TURNING', 'CONFIRMED') AND tier <> 'OK' THEN 'PRIME' WHEN stage = 'STILL_TESTING' AND grade IN ('A', 'B') THEN 'EARLY' WHEN tier = 'OK' OR grade IN ('C', 'D') THEN 'SPEC' ELSE 'WATCH' END AS bucket FROM s""")
def buckets(spark, d):
    ext, adv = ratio(9 * (C("c") - C("lo")), C("hi") - C("lo")), C("vol") * C("md") * 20
    s = stats(spark, d).select("ticker", bo.support_grade(C("n") % 6, C("n"), ratio(C("md"), C("lc")) - 1).alias("grade"), bo.stage(ext).alias("stage"), bo.liquidity_tier(adv).alias("tier"))
    return s.select("ticker", "stage", "tier", bo.bucket(C("grade"), C("stage"), C("tier")).alias("bucket"))


@query("F22_topology", f"""WITH {BARS}, m AS (SELECT ticker, date_trunc('year', session) AS y, max(high) AS h FROM bars GROUP BY 1, 2), t AS (SELECT ticker, list(h ORDER BY y) AS tops, max(h) AS peak FROM m GROUP BY 1), n AS (SELECT ticker, tops, len([x FOR x IN tops IF x >= 0.60 * peak]) AS a, len([x FOR x IN tops IF x >= 0.95 * peak]) AS b FROM t)
SELECT ticker, greatest(a, 1) AS n_major, CASE WHEN a <= 1 THEN 'SINGLE' WHEN a = 2 THEN 'DOUBLE' WHEN list_sort(tops) = tops THEN 'STAIR_STEP' ELSE 'COMPLEX' END AS shape FROM n""")
def topology(spark, d):
    """The highs of years stand for major peaks."""
    m = bars(spark, d).groupBy("ticker", F.year("session").alias("y")).agg(F.max("high").alias("h"))
    t = m.groupBy("ticker").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "h"))), lambda x: x["h"]).alias("tops"), F.max("h").alias("peak"))
    parts = bo.topology(C("tops"), C("peak"))
    return t.select("ticker", parts["n_major"].alias("n_major"), parts["shape"].alias("shape"))


@query("F32_bounce_screen")
def bounce_screen(spark, d):
    """Every name's structure, scores, bucket and first failed gate; sequential, so tested on worked paths."""
    s = bo.screen(walk_bars(spark, d))
    return s.select("ticker", "session", "peak_session", r("run_x", "run_x"), r("retrace_of_run", "retrace_of_run"), r("level", "level"), "touches", r("quality", "quality"), r("bounce", "bounce"), r("volume_sign", "volume_sign"), r("score", "score"), "band", "grade", "stage", "bucket", "failed")


@query("F23_dominant_peak")
def dominant_peak(spark, d):
    return bo.read(walk_bars(spark, d), only="peak").where("peak is not null").select("ticker", "peak_session", r("peak", "peak"))


@query("F24_run_start")
def run_start(spark, d):
    return bo.read(walk_bars(spark, d), only="run").where("run_x is not null").select("ticker", "base_session", r("run_x", "run_x"), r("run_z", "run_z"), "run_bars")


@query("F25_base_zone")
def base_zone(spark, d):
    return bo.read(walk_bars(spark, d), only="run").where("base_low is not null").select("ticker", r("base_low", "base_low"), r("base_mid", "base_mid"), r("base_high", "base_high"))


@query("F28_bounce_points")
def bounce_points(spark, d):
    return bo.read(walk_bars(spark, d), only="turn").where("bounce is not null").select("ticker", r("bounce", "bounce"), r("ext", "ext"))


# ---- indicators


@query("F8_wave_trend", f"""WITH RECURSIVE {BARS}, p AS (SELECT ticker, session, (high + low + close) / 3 AS x, row_number() OVER ({T}) AS k FROM bars),
e AS (SELECT ticker, session, k, x, x AS m, 0.0::DOUBLE AS s, NULL::DOUBLE AS wt FROM p WHERE k = 1 UNION ALL SELECT p.ticker, p.session, p.k, p.x, e.m + 2.0 / 11 * (p.x - e.m), e.s + 2.0 / 11 * (abs(p.x - (e.m + 2.0 / 11 * (p.x - e.m))) - e.s),
 CASE WHEN e.s + 2.0 / 11 * (abs(p.x - (e.m + 2.0 / 11 * (p.x - e.m))) - e.s) > 0 THEN coalesce(e.wt + 2.0 / 22 * ((p.x - (e.m + 2.0 / 11 * (p.x - e.m))) / (0.015 * (e.s + 2.0 / 11 * (abs(p.x - (e.m + 2.0 / 11 * (p.x - e.m))) - e.s))) - e.wt), (p.x - (e.m + 2.0 / 11 * (p.x - e.m))) / (0.015 * (e.s + 2.0 / 11 * (abs(p.x - (e.m + 2.0 / 11 * (p.x - e.m))) - e.s)))) ELSE e.wt END FROM e JOIN p ON p.ticker = e.ticker AND p.k = e.k + 1)
SELECT ticker, session, round(wt, 4) AS wt1, round(CASE WHEN count(wt) OVER f = 4 THEN avg(wt) OVER f END, 4) AS wt2 FROM e WINDOW f AS ({T} ROWS 3 PRECEDING)""")
def wave_trend(spark, d):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("session")
        first, second = bo.wave_trend(g["high"], g["low"], g["close"])
        return pd.DataFrame({"ticker": g["ticker"], "session": g["session"], "wt1": first, "wt2": second})

    out = bars(spark, d).select(*KEY, "high", "low", "close").groupBy("ticker").applyInPandas(run, "ticker long, session date, wt1 double, wt2 double")
    return out.select(*KEY, r("wt1", "wt1", 4), r("wt2", "wt2", 4))


SMA40 = "avg((high + low) / 2) OVER (PARTITION BY ticker ORDER BY session ROWS 39 PRECEDING)"


@query("F11_ma_shift", f"""WITH {BARS}, a AS (SELECT ticker, session, (high + low) / 2 AS src, CASE WHEN row_number() OVER ({T}) >= 40 THEN (high + low) / 2 - {SMA40} END AS diff FROM bars),
q AS (SELECT *, CASE WHEN count(diff) OVER f >= 250 THEN quantile_cont(diff, 0.99) OVER f END AS p FROM a WINDOW f AS ({T} ROWS 999 PRECEDING)), n AS (SELECT *, CASE WHEN p <> 0 THEN diff / p END AS norm FROM q), c AS (SELECT *, norm - lag(norm, 15) OVER ({T}) AS v FROM n),
h AS (SELECT *, 2 * ({" + ".join(f"{5 - i} * lag(v, {i}) OVER f" for i in range(5))}) / 15 - ({" + ".join(f"{10 - i} * lag(v, {i}) OVER f" for i in range(10))}) / 55 AS x FROM c WINDOW f AS ({T}))
SELECT ticker, session, src >= src - diff AS regime_up, round((3 * x + 2 * lag(x, 1) OVER f + lag(x, 2) OVER f) / 6, 4) AS osc FROM h WINDOW f AS ({T})""")
def ma_shift(spark, d):
    """Distance from the 40-bar mean over its own 99th percentile of 1,000 bars, its change over 15, smoothed by a Hull average."""
    src = (C("high") + C("low")) / 2
    a = bars(spark, d).select(*KEY, src.alias("src")).withColumn("diff", C("src") - w.sma("src", 40))
    frame = w.rows(-999)
    a = w.with_rolling_quantile(a, "diff", 1000, 0.99, "top")
    p = F.when(F.count("diff").over(frame) >= 250, C("top"))
    a = a.withColumn("norm", ratio(C("diff"), p)).withColumn("v", C("norm") - F.lag("norm", 15).over(w.order()))
    return w.with_hma(a, "v", 10, "osc").select(*KEY, (C("src") >= C("src") - C("diff")).alias("regime_up"), r("osc", "osc", 4))


@query("F15_plateau", f"WITH {BARS} SELECT ticker, session, arg_max(session, high) OVER f AS top_session, round(max(high) OVER f, 5) AS top FROM bars WINDOW f AS ({T} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def plateau(spark, d):
    frame = w.rows(-2, 2)
    return bars(spark, d).select(*KEY, F.max_by("session", "high").over(frame).alias("top_session"), r(F.max("high").over(frame), "top", 5))


@query("F19_touch_statistics", f"""WITH {BARS}, {STATS}, b AS (SELECT bars.*, lo * 1.02 AS level, row_number() OVER ({T}) AS k FROM bars JOIN st USING (ticker)), h AS (SELECT * FROM b WHERE low <= level * 1.025 AND low >= level * 0.97 AND close >= level * 0.98), n AS (SELECT *, CASE WHEN k - lag(k) OVER ({T}) <= 8 THEN 0 ELSE 1 END AS fresh FROM h),
v AS (SELECT *, sum(fresh) OVER ({T}) AS visit FROM n), s AS (SELECT ticker, visit, min(k) AS a, max(k) AS z, min(session) AS first_day, max(session) AS last_day FROM v GROUP BY 1, 2), e AS (SELECT ticker, arg_min(k, low) AS bottom, max(k) AS n FROM b GROUP BY 1),
c AS (SELECT e.ticker, e.n, coalesce(min(a) FILTER (z >= bottom - 8), any_value(bottom)) AS now FROM e LEFT JOIN s USING (ticker) GROUP BY 1, 2) SELECT c.ticker, count(s.a) AS touches, coalesce(date_diff('day', min(first_day), max(last_day)), 0) AS span_days, coalesce(any_value(c.n) - max(z), 1000000) AS gap_bars FROM c LEFT JOIN s ON s.ticker = c.ticker AND s.z < c.now GROUP BY 1""")
def touch_statistics(spark, d):
    """Visits of the level 2 percent over a name's lowest low, without the visit that holds that low."""
    b = bars(spark, d).withColumn("bar", F.row_number().over(w.order()))
    e = b.groupBy("ticker").agg((F.min("low") * 1.02).alias("level"), F.min_by("bar", "low").alias("bottom"), F.max("bar").alias("n"))
    b = b.join(e.select("ticker", "level"), "ticker").withColumn("hit", (C("low") <= C("level") * 1.025) & (C("low") >= C("level") * 0.97) & (C("close") >= C("level") * 0.98))
    s = w.islands(b, "hit", 8).groupBy("ticker", "visit").agg(F.min("bar").alias("a"), F.max("bar").alias("z"), F.min("session").alias("first"), F.max("session").alias("last"))
    s = e.select("ticker", "bottom", "n").join(s, "ticker", "left")
    s = s.withColumn("now", F.coalesce(F.min(F.when(C("z") >= C("bottom") - 8, C("a"))).over(Window.partitionBy("ticker")), "bottom"))
    before = lambda x: F.when(C("z") < C("now"), x)
    return s.groupBy("ticker", "n").agg(F.count(before(C("a"))).alias("touches"), F.coalesce(F.datediff(F.max(before(C("last"))), F.min(before(C("first")))).cast("long"), F.lit(0)).alias("span_days"), F.max(before(C("z"))).alias("z")).select("ticker", "touches", "span_days", F.coalesce(C("n") - C("z"), F.lit(1_000_000)).cast("long").alias("gap_bars"))


# ---- floors, outcomes, thinning

FLOOR = f"""i AS (SELECT ticker, session, high, low, close, volume, row_number() OVER ({T}) AS bar, count(*) OVER (PARTITION BY ticker) AS n, min(low) OVER ({T} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS around, count(*) OVER ({T} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS held FROM bars),
fl AS (SELECT ticker, min(low) AS floor FROM i WHERE bar > n - 250 GROUP BY 1), sw AS (SELECT i.ticker, i.bar FROM i JOIN fl USING (ticker) WHERE held = 11 AND low = around AND bar > n - 250 AND low <= floor * 1.10),
k AS (SELECT ticker, min(bar) AS bar FROM sw GROUP BY 1 UNION ALL SELECT k.ticker, (SELECT min(sw.bar) FROM sw WHERE sw.ticker = k.ticker AND sw.bar >= k.bar + 10) FROM k WHERE k.bar IS NOT NULL),
ft AS (SELECT ticker, count(bar) AS n_tests, max(bar) - min(bar) AS span FROM k WHERE bar IS NOT NULL GROUP BY 1)"""


def floor_tests_of(b):
    """Per name: the floor of the last 250 bars, its tests (swing lows within a tenth of it, 10 bars apart) and their span."""
    i = w.with_swing_low(b, 5).withColumn("bar", F.row_number().over(w.order())).withColumn("n", F.count("*").over(Window.partitionBy("ticker"))).where("bar > n - 250")
    i = i.withColumn("floor", F.min("low").over(Window.partitionBy("ticker")))
    kept = ev.thin_episodes(i.where("swing_low and low <= floor * 1.10").select("ticker", "session", "bar"), 10)
    tests = kept.groupBy("ticker").agg(F.count("*").alias("n_tests"), (F.max("bar") - F.min("bar")).cast("long").alias("span"))
    return i.groupBy("ticker").agg(F.first("floor").alias("floor")).join(tests, "ticker", "left")


@query("F45_floor_tests", f"WITH RECURSIVE {BARS}, {FLOOR} SELECT fl.ticker, round(floor, 5) AS floor, n_tests, span FROM fl LEFT JOIN ft USING (ticker)")
def floor_tests(spark, d):
    return floor_tests_of(bars(spark, d)).select("ticker", r("floor", "floor", 5), "n_tests", "span")


@query("F46_floor_classes", f"""WITH RECURSIVE {BARS}, {FLOOR}, pk AS (SELECT ticker, max(high) AS peak, min(bar) FILTER (high = h) AS p, any_value(n) AS n, any_value(close) FILTER (bar = n) AS c, avg(close * volume) FILTER (bar > n - 20) AS dv20 FROM (SELECT *, max(high) OVER (PARTITION BY ticker) AS h FROM i) GROUP BY 1),
st AS (SELECT pk.ticker, min(low) AS start FROM pk JOIN i ON i.ticker = pk.ticker AND i.bar BETWEEN pk.p - 249 AND pk.p GROUP BY 1), f AS (SELECT pk.ticker, p <= pk.n - 250 AS peak_old, peak / start AS run_x, 1 - c / peak AS off_hi, c / start AS above_start, coalesce(n_tests, 0) AS n_tests, coalesce(span, 0) AS span, c <= floor * 1.05 AS at_floor, dv20 FROM pk JOIN st USING (ticker) JOIN fl USING (ticker) LEFT JOIN ft USING (ticker)),
h AS (SELECT ticker, peak_old AND run_x >= 2.0 AS run, off_hi BETWEEN 0.35 AND 0.70 AND above_start >= 1.3 AS pull, n_tests >= 3 AND span >= 60 AS base, at_floor, run_x, dv20 FROM f) SELECT ticker, round(run_x, 5) AS run_x, run AND pull AND base AND at_floor AS pattern, CASE WHEN NOT run THEN 'run' WHEN NOT pull THEN 'pullback' WHEN NOT base THEN 'floor' WHEN NOT at_floor THEN 'at floor' END AS missing FROM h""")
def floor_classes(spark, d):
    """The retest of a floor after a run: run, pullback, tested floor, price at it; and the first that is missing."""
    b = bars(spark, d).withColumn("bar", F.row_number().over(w.order())).withColumn("n", F.count("*").over(Window.partitionBy("ticker")))
    top = F.max(F.struct("high", -C("bar")))
    pk = b.groupBy("ticker", "n").agg(top.alias("t"), F.max_by("close", "bar").alias("c")).select("ticker", "n", "c", C("t.high").alias("peak"), (-C("t.col2")).alias("p"))
    start = b.join(pk.select("ticker", "p"), "ticker").where("bar between p - 249 and p").groupBy("ticker").agg(F.min("low").alias("start"))
    f = pk.join(start, "ticker").join(floor_tests_of(bars(spark, d)), "ticker").na.fill(0, ["n_tests", "span"])
    run_x, off = ratio(C("peak"), C("start")), 1 - ratio(C("c"), C("peak"))
    tests = {"run": (C("p") <= C("n") - 250) & (run_x >= 2.0), "pullback": off.between(0.35, 0.70) & (ratio(C("c"), C("start")) >= 1.3), "floor": (C("n_tests") >= 3) & (C("span") >= 60), "at floor": C("c") <= C("floor") * 1.05}
    every = tests["run"] & tests["pullback"] & tests["floor"] & tests["at floor"]
    return f.select("ticker", r(run_x, "run_x", 5), every.alias("pattern"), F.coalesce(*[F.when(~t, k) for k, t in tests.items()]).alias("missing"))


@query("F42_outcome_tracking", f"""WITH {BARS}, x AS (SELECT ticker, session, high, low, close, close > 1.2 * lag(close) OVER ({T}) AS flag FROM bars), f AS (SELECT ticker, min(session) AS flagged FROM x WHERE flag GROUP BY 1), p AS (SELECT x.ticker, close AS price, flagged FROM x JOIN f ON x.ticker = f.ticker AND x.session = f.flagged)
SELECT p.ticker, any_value(flagged) AS flagged, round(arg_max(x.close, session) / any_value(price) - 1, 6) AS ret, round(max(high) / any_value(price) - 1, 6) AS mfe, round(min(low) / any_value(price) - 1, 6) AS mae, count(*) AS bars FROM p JOIN x ON x.ticker = p.ticker AND x.session > p.flagged GROUP BY 1""")
def outcome_tracking(spark, d):
    """Since a name's first jump of a fifth: return, best and worst."""
    x = bars(spark, d).withColumn("flag", C("close") > 1.2 * F.lag("close").over(w.order()))
    f = x.where("flag").groupBy("ticker").agg(F.min(F.struct("session", "close")).alias("f"))
    j = x.join(f, "ticker").where("session > f.session").groupBy("ticker", C("f.session").alias("flagged"), C("f.close").alias("price")).agg(F.max_by("close", "session").alias("c"), F.max("high").alias("h"), F.min("low").alias("l"), F.count("*").alias("bars"))
    return j.select("ticker", "flagged", *[r(ratio(C(a), C("price")) - 1, b) for a, b in (("c", "ret"), ("h", "mfe"), ("l", "mae"))], "bars")


THIN = """k AS (SELECT min(session_idx) AS i FROM e UNION ALL SELECT (SELECT min(session_idx) FROM e WHERE session_idx >= k.i + {gap}) FROM k WHERE k.i IS NOT NULL)"""
BUSY = "e AS (SELECT session_idx FROM cal JOIN (SELECT session, count(*) AS n FROM bars GROUP BY 1) USING (session) WHERE n >= {least})"


def thinned(spark, d, gap, least):
    """Sessions on which at least so many names traded, so many sessions apart, taken greedily. A calendar is one small group."""
    days = bars(spark, d).groupBy("session").agg(F.count("*").alias("n")).where(C("n") >= least).join(calendar(spark, d), "session")
    return ev.thin_episodes(days.select(F.lit(0).alias("all"), "session", C("session_idx").alias("bar")), gap, by="all")


@query("F49_date_thinning", f"WITH RECURSIVE {BARS}, {CALENDAR}, {BUSY.format(least=5)}, {THIN.format(gap=10)} SELECT session FROM k JOIN cal ON i = session_idx")
def date_thinning(spark, d):
    return thinned(spark, d, 10, 5).select("session")


@query("F50_coupled_dates", f"WITH RECURSIVE {BARS}, {CALENDAR}, {BUSY.format(least=15)}, {THIN.format(gap=21)} SELECT session FROM k JOIN cal ON i = session_idx")
def coupled_dates(spark, d):
    return thinned(spark, d, 21, 15).select("session")


@query("F47_zone_outcome", f"""WITH {BARS}, k AS (SELECT *, row_number() OVER ({T}) AS bar, count(*) OVER (PARTITION BY ticker) AS n FROM bars), z AS (SELECT ticker, min(low) AS level, any_value(n // 2) AS cut FROM k WHERE bar <= n // 2 GROUP BY 1), t AS (SELECT k.ticker, min(bar) AS bar FROM k JOIN z USING (ticker) WHERE bar > cut AND bar <= cut + 60 AND low <= level * 1.03 GROUP BY 1)
SELECT z.ticker, t.bar - cut AS after, round(min(k.low) / level - 1, 6) AS worst, round(max(k.high) / level - 1, 6) AS best FROM z JOIN t USING (ticker) JOIN k ON k.ticker = z.ticker AND k.bar BETWEEN t.bar + 1 AND t.bar + 20 GROUP BY z.ticker, level, t.bar, cut""")
def zone_outcome(spark, d):
    """A level read from the first half of a name's bars: its first touch within 60 bars, and the 20 bars after that."""
    k = bars(spark, d).withColumn("bar", F.row_number().over(w.order())).withColumn("cut", F.floor(F.count("*").over(Window.partitionBy("ticker")) / 2))
    k = k.withColumn("level", F.min(F.when(C("bar") <= C("cut"), C("low"))).over(Window.partitionBy("ticker")))
    k = k.withColumn("touch", F.min(F.when((C("bar") > C("cut")) & (C("bar") <= C("cut") + 60) & (C("low") <= C("level") * 1.03), C("bar"))).over(Window.partitionBy("ticker")))
    out = k.where("bar between touch + 1 and touch + 20").groupBy("ticker", "level", "touch", "cut").agg(F.min("low").alias("l"), F.max("high").alias("h"))
    return out.select("ticker", (C("touch") - C("cut")).cast("long").alias("after"), r(ratio(C("l"), C("level")) - 1, "worst"), r(ratio(C("h"), C("level")) - 1, "best"))


# ---- corrections and exits

EX = "x AS (SELECT s_suppkey AS ticker, DATE '1996-01-01' + CAST(s_suppkey % 900 AS INT) AS ex, (1000 + abs(s_acctbal)) / (1000 + abs(s_acctbal) + 20.0 * s_nationkey) AS factor FROM supplier)"


def spin_offs(spark, d):
    """Declared spin-offs: the factor is the parent's price over the price with the distributed shares."""
    price = 1000 + F.abs("s_acctbal")
    return table(spark, d, "supplier").select(C("s_suppkey").alias("ticker"), F.date_add(F.lit("1996-01-01").cast("date"), (C("s_suppkey") % 900).cast("int")).alias("ex"), ratio(price, price + 20.0 * C("s_nationkey")).alias("factor"))


@query("I21_spin_off_factor", f"WITH {EX} SELECT ticker, ex, round(factor, 8) AS factor FROM x")
def spin_off_factor(spark, d):
    return spin_offs(spark, d).select("ticker", "ex", r("factor", "factor", 8))


@query("F64_spin_off_adjust", f"WITH {BARS}, {EX} SELECT ticker, session, round(close * CASE WHEN session < ex THEN factor ELSE 1 END, 5) AS close FROM bars LEFT JOIN x USING (ticker)")
def spin_off_adjust(spark, d):
    """Bars before each declared day times the product of all later factors."""
    before = C("session") < C("ex")
    f = bars(spark, d).select(*KEY, "close").join(spin_offs(spark, d), "ticker", "left").groupBy(*KEY, "close").agg(F.product(F.when(before, C("factor")).otherwise(1.0)).alias("f"))
    return f.select(*KEY, r(C("close") * C("f"), "close", 5))


@query("F65_history_cut", f"WITH {BARS}, {EX} SELECT ticker, count(*) AS n, min(session) AS first FROM bars LEFT JOIN x USING (ticker) WHERE ex IS NULL OR session >= ex GROUP BY 1")
def history_cut(spark, d):
    return bars(spark, d).join(spin_offs(spark, d), "ticker", "left").where("ex is null or session >= ex").groupBy("ticker").agg(F.count("*").alias("n"), F.min("session").alias("first"))


LEADS = ", ".join(f"lead({c}, {i}) OVER f AS {c}{i}" for i in range(1, 6) for c in ("open", "high", "low", "close"))
HIT = " ".join(f"WHEN open{i} <= e * 0.95 THEN open{i} WHEN open{i} >= e * 1.08 THEN open{i} WHEN low{i} <= e * 0.95 THEN e * 0.95 WHEN high{i} >= e * 1.08 THEN e * 1.08" for i in range(2, 6))


@query("F67_bracket_with_gaps", f"WITH {BARS}, l AS (SELECT ticker, session, open1 AS e, * EXCLUDE (ticker, session) FROM (SELECT ticker, session, {LEADS} FROM bars WINDOW f AS ({T}))) SELECT ticker, session, round(CASE WHEN low1 <= e * 0.95 THEN e * 0.95 WHEN high1 >= e * 1.08 THEN e * 1.08 {HIT} ELSE close5 END / e - 1, 6) AS ret FROM l WHERE close5 IS NOT NULL")
def bracket_with_gaps(spark, d):
    """Stop and target over five bars; a bar that opens beyond one fills at its open, and the stop comes first."""
    lead = lambda c, i: F.lead(c, i).over(w.order())
    x = bars(spark, d).select(*KEY, *[lead(c, i).alias(f"{c}{i}") for i in range(1, 6) for c in ("open", "high", "low", "close")]).where("close5 is not null")
    entry, out = C("open1"), None
    stop, goal = entry * 0.95, entry * 1.08
    for i in range(1, 6):
        o, h, lo = C(f"open{i}"), C(f"high{i}"), C(f"low{i}")
        for test, price in (((o <= stop) | (o >= goal), o), (lo <= stop, stop), (h >= goal, goal)):
            if i > 1 or price is not o:
                out = F.when(test, price) if out is None else out.when(test, price)
    return x.select(*KEY, r(ratio(out.otherwise(C("close5")), entry) - 1, "ret"))


@query("F71_exit_levels", f"WITH {BARS}, a AS (SELECT ticker, session, close, avg(high - low) OVER ({T} ROWS 19 PRECEDING) AS rng, min(low) OVER ({T} ROWS 19 PRECEDING) AS support FROM bars) SELECT ticker, session, round(close * 0.95, 5) AS fixed_stop, round(close - 2 * rng, 5) AS range_stop, round(greatest(support * 0.98, close - 3 * rng), 5) AS level_stop, round(close + 3 * rng, 5) AS target FROM a")
def exit_levels(spark, d):
    f = w.rows(-19)
    a = bars(spark, d).withColumn("rng", F.avg(C("high") - C("low")).over(f)).withColumn("support", F.min("low").over(f))
    return a.select(*KEY, r(C("close") * 0.95, "fixed_stop", 5), r(C("close") - 2 * C("rng"), "range_stop", 5), r(F.greatest(C("support") * 0.98, C("close") - 3 * C("rng")), "level_stop", 5), r(C("close") + 3 * C("rng"), "target", 5))


@query("F56_limit_fill", f"WITH {BARS}, l AS (SELECT ticker, session, close * 0.97 AS lim, lead(open, 1) OVER f AS o1, lead(low, 1) OVER f AS l1, lead(open, 2) OVER f AS o2, lead(low, 2) OVER f AS l2, lead(open, 3) OVER f AS o3, lead(low, 3) OVER f AS l3 FROM bars WINDOW f AS ({T})), x AS (SELECT ticker, session, lim, CASE WHEN o1 <= lim THEN 1 WHEN l1 <= lim * 0.999 THEN 1 WHEN o2 <= lim OR l2 <= lim * 0.999 THEN 2 WHEN o3 <= lim OR l3 <= lim * 0.999 THEN 3 END AS fill_day, CASE WHEN o1 <= lim THEN o1 WHEN l1 <= lim * 0.999 THEN lim WHEN o2 <= lim THEN o2 WHEN l2 <= lim * 0.999 THEN lim WHEN o3 <= lim THEN o3 WHEN l3 <= lim * 0.999 THEN lim END AS price FROM l) SELECT ticker, session, fill_day, round(price, 5) AS price FROM x WHERE fill_day IS NOT NULL")
def limit_fill(spark, d):
    """A buy order 3 percent under the close, good for three sessions: at a lower open, or where the low goes through it."""
    limit, day, price = C("close") * 0.97, None, None
    for i in (1, 2, 3):
        o, lo = F.lead("open", i).over(w.order()), F.lead("low", i).over(w.order())
        for test, at in ((o <= limit, o), (lo <= limit * 0.999, limit)):
            day, price = (F.when(test, i), F.when(test, at)) if day is None else (day.when(test, i), price.when(test, at))
    return bars(spark, d).select(*KEY, day.alias("fill_day"), price.alias("price")).where("fill_day is not null").select(*KEY, "fill_day", r("price", "price", 5))


@query("F73_path_rehydration", f"WITH {BARS}, j AS (SELECT ticker, session, list(close) OVER ({T} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS path FROM bars) SELECT ticker, session, len(path) AS n, round(list_sum(path), 4) AS total, round(path[1], 5) AS next_close FROM j WHERE len(path) > 0")
def path_rehydration(spark, d):
    p = bars(spark, d).select(*KEY, F.collect_list("close").over(w.rows(1, 5)).alias("path")).where(F.size("path") > 0)
    return p.select(*KEY, F.size("path").cast("long").alias("n"), r(F.aggregate("path", F.lit(0.0), lambda s, x: s + x), "total", 4), r(F.get("path", F.lit(0)), "next_close", 5))


@query("F70_bar_grid", "WITH g AS (SELECT user_id, CAST(ts AS DATE) AS day, (hour(ts) * 60 + minute(ts)) // 30 AS slot, value, event_id FROM events WHERE value IS NOT NULL) SELECT user_id, day, CAST(slot AS INT) AS slot, count(*) AS n, round(max(value), 6) AS high, round(min(value), 6) AS low FROM g GROUP BY 1, 2, 3")
def bar_grid(spark, d):
    """Half-hour slots of each name's day; slots without a trade are missing."""
    slot = F.floor((F.hour("ts") * 60 + F.minute("ts")) / 30).cast("int")
    return table(spark, d, "events").where("value is not null").groupBy("user_id", F.to_date("ts").alias("day"), slot.alias("slot")).agg(F.count("*").alias("n"), r(F.max("value"), "high"), r(F.min("value"), "low"))


@query("C16_zone_suspicion", f"""WITH {BARS}, x AS (SELECT ticker, session, close, volume, abs(ln(close / lag(close) OVER ({T}))) AS v, max(high) OVER ({T} ROWS 249 PRECEDING) AS top, row_number() OVER (PARTITION BY ticker ORDER BY session DESC) AS k, median(volume) OVER (PARTITION BY ticker) AS med FROM bars)
SELECT ticker, coalesce(bool_or(v > 0.85 AND volume <= 3 * med), false) OR coalesce(bool_or(k = 1 AND close / top < 0.05), false) AS suspect FROM x GROUP BY 1""")
def zone_suspicion(spark, d):
    """A leap without volume, or a close under a twentieth of the year's high: an unadjusted split."""
    x = bars(spark, d).withColumns({"v": F.abs(F.ln(ratio(C("close"), F.lag("close").over(w.order())))), "top": F.max("high").over(w.rows(-249)), "med": F.percentile("volume", F.lit(0.5)).over(Window.partitionBy("ticker"))})
    last = F.max_by(ratio(C("close"), C("top")), "session")
    return x.groupBy("ticker").agg((F.coalesce(F.bool_or((C("v") > 0.85) & (C("volume") <= 3 * C("med"))), F.lit(False)) | F.coalesce(last < 0.05, F.lit(False))).alias("suspect"))


@query("C12_good_level", f"WITH {BARS}, {STATS} SELECT ticker FROM st WHERE c / lo - 1 <= 4 AND c / hi >= 0.30 AND n % 100 >= 25 AND n % 60 <= 45")
def good_level(spark, d):
    """Near its level, near its high, good reports and little noise."""
    return stats(spark, d).where("try_divide(c, lo) - 1 <= 4 and try_divide(c, hi) >= 0.30 and n % 100 >= 25 and n % 60 <= 45").select("ticker")


@query("E85_profile_percentile", f"WITH {BARS}, k AS (SELECT ticker, close, arg_max(close, session) OVER (PARTITION BY ticker) AS last FROM bars) SELECT ticker, count(*) AS n, round(100.0 * sum(CAST(close < last AS INT)) / count(*), 6) AS pct FROM k GROUP BY 1 HAVING count(*) >= 8")
def profile_percentile(spark, d):
    newest = F.max_by("close", F.when(C("close").isNotNull(), C("session")))  # a day without a price is not the last
    b = bars(spark, d).withColumn("last", newest.over(Window.partitionBy("ticker")))  # of the same bars, to the last bit
    below = F.sum((C("close") < C("last")).cast("int"))  # null where no bar has a price
    return b.groupBy("ticker").agg(F.count("*").alias("n"), r(ratio(100.0 * below, F.count("*")), "pct")).where("n >= 8")


@query("G7_universe_rows", f"WITH {BARS}, {STATS}, {SECTORS} SELECT s.ticker, sector, CASE WHEN st.ticker IS NULL THEN 'no bars' WHEN n < 500 THEN 'short history' WHEN c / hi < 0.3 THEN 'far from high' ELSE 'screened' END AS stage FROM sectors s LEFT JOIN st ON st.ticker = s.ticker")
def universe_rows(spark, d):
    j = sectors(spark, d).join(stats(spark, d), "ticker", "left")
    return j.select("ticker", "sector", F.when(C("n").isNull(), "no bars").when(C("n") < 500, "short history").when(ratio(C("c"), C("hi")) < 0.3, "far from high").otherwise("screened").alias("stage"))


@query("E135_drop_reason", f"WITH {BARS}, {STATS} SELECT ticker, CASE WHEN lc < 0.94 * (lo * 1.05) THEN 'support_broken' WHEN c / md - 1 > 0.2 THEN 'went_extended' ELSE 'bounce_stalled' END AS reason FROM st")
def drop_reason(spark, d):
    return stats(spark, d).select("ticker", F.when(C("lc") < 0.94 * (C("lo") * 1.05), "support_broken").when(ratio(C("c"), C("md")) - 1 > 0.2, "went_extended").otherwise("bounce_stalled").alias("reason"))


@query("E137_relative_strength", f"""WITH {BARS}, x AS (SELECT ticker, session, ln(close / lag(close) OVER ({T})) AS v FROM bars), m AS (SELECT *, v - avg(v) OVER (PARTITION BY session) AS rel, row_number() OVER (PARTITION BY ticker ORDER BY session DESC) AS k FROM x) SELECT ticker, round(sum(rel), 6) AS rs FROM m WHERE k <= 63 GROUP BY 1 HAVING count(rel) >= 0.8 * 63""")
def relative_strength(spark, d):
    """Sum of log returns over the session's mean, of the last 63 bars, four fifths of them at least."""
    x = bars(spark, d).withColumn("v", F.ln(ratio(C("close"), F.lag("close").over(w.order()))))
    x = x.withColumn("rel", C("v") - F.avg("v").over(Window.partitionBy("session"))).withColumn("k", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("session"))))
    return x.where("k <= 63").groupBy("ticker").agg(r(F.sum("rel"), "rs"), F.count("rel").alias("n")).where("n >= 0.8 * 63").drop("n")
