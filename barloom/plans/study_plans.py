"""Studies with controls and random draws, rules chosen on one period, and days that settle."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions.ranks import rank_avg, ratio, t_stat
from barloom.operators import asof, draws, levels
from barloom.operators import backtest as bt
from barloom.operators import crosssection as cs
from barloom.operators import events as ev
from barloom.operators import intraday as it
from barloom.operators import modules as mo
from barloom.operators import rebase as rb
from barloom.operators import windows as w
from barloom.operators import zone_study as zs
from barloom.operators.staged import stored
from barloom.plans import module_plans as mp
from barloom.plans.bar_plans import PATHS
from barloom.plans.catalog import query, r
from barloom.plans.event_plans import TRADES, trades
from barloom.sources import macro
from barloom.sources.roles import BARS, CALENDAR, SECTORS, WALK, bars, calendar, sectors, table, walk_bars
from barloom.streaming import settled

C = F.col

# ---- settled days: an order is a filing, resolved when its last line has shipped

NOW = "1998-06-15"
FEED = "feed AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey AS filing FROM orders), done AS (SELECT l_orderkey AS filing, max(CAST(l_shipdate AS DATE)) AS shipped FROM lineitem GROUP BY 1)"


def feed(spark, d):
    listed = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"), C("o_orderkey").alias("filing"))
    done = table(spark, d, "lineitem").groupBy(C("l_orderkey").alias("filing")).agg(F.max(F.to_date("l_shipdate")).alias("at"))
    return listed, done


@query("J9_settled_mark", f"""WITH {FEED}, s AS (SELECT day, count(*) AS listed, count(*) FILTER (shipped IS NULL OR shipped > DATE '{NOW}') AS pending FROM feed LEFT JOIN done USING (filing) WHERE day <= DATE '{NOW}' GROUP BY 1),
x AS (SELECT *, CASE WHEN pending = 0 THEN 'settled' WHEN DATE '{NOW}' - day > 3 THEN 'tolerated' ELSE 'open' END AS status FROM s) SELECT day, listed, pending, status, coalesce(day < (SELECT min(day) FROM x WHERE status = 'open'), true) AS below_mark FROM x""")
def settled_mark(spark, d):
    """Every day up to NOW with what is pending on it, and whether the mark has passed it."""
    return settled.with_mark(settled.day_states(*feed(spark, d), F.lit(NOW).cast("date")))


@query("J18_to_retry", f"WITH {FEED} SELECT day, filing FROM feed LEFT JOIN done USING (filing) WHERE day <= DATE '{NOW}' AND DATE '{NOW}' - day <= 120 AND (shipped IS NULL OR shipped > DATE '{NOW}')")
def to_retry(spark, d):
    """Filings of the last 120 days that the next run asks for again."""
    return settled.to_retry(*feed(spark, d), F.lit(NOW).cast("date"))


# ---- rules against luck

#: Rules over the modules' metrics, in words that both engines read.
RULES = {"dip_in_rise": "ret20 < 0 AND over50 > 0", "strong": "ret120 > 0.2 AND from_high > -0.8", "calm_rise": "range20 < 0.5 AND over20 > 0"}
PATTERN = {"low_climb": "from_low < 6.0 AND ret5 > 0"}


def mixed_sql(who: str, when: str, turn: str) -> str:
    p, a, b, c, e = draws.PRIME, draws.WHO, draws.WHEN, draws.TURN, draws.MORE
    x = f"((({who} % {p} * {a} + {when} % {p} * {b}) % {p} + {turn} * {c}) % {p})"
    return f"(({x} * {x} % {p} + {turn}) * ({x} * {x} % {p} + {e}) % {p})"


def draw_sql(rules: dict[str, str], outcome: str, n: int) -> str:
    return f"""WITH {mp.SCORES}, p AS (SELECT g.*, session_idx, {outcome} AS fwd, quantile_cont({outcome}, 0.5) OVER d AS middle, avg({outcome}) OVER d AS mean, avg(CAST({outcome} > 0 AS INT)) OVER d AS up FROM g JOIN cal USING (session) WHERE {outcome} IS NOT NULL WINDOW d AS (PARTITION BY session)),
k AS ({" UNION ALL ".join(f"SELECT '{k}' AS rule, session, fwd, middle, mean, up FROM p WHERE {v}" for k, v in rules.items())}), dd AS (SELECT rule, session, count(*) AS k, avg(fwd) - max(mean) AS excess, avg(CAST(fwd > 0 AS INT)) AS hit, max(up) AS pool_hit, avg(CAST(fwd > middle AS INT)) AS beat FROM k GROUP BY 1, 2 HAVING count(*) >= 3),
hh AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY session) <= count(*) OVER (PARTITION BY rule) // 2 AS early FROM dd), f AS (SELECT rule, count(*) AS dates, CAST(sum(k) AS BIGINT) AS picks, avg(hit) AS hit, avg(pool_hit) AS pool_hit, avg(beat) AS beat, avg(excess) AS excess, CASE WHEN count(*) >= 3 THEN avg(excess) / (stddev_samp(excess) / sqrt(count(*))) END AS t, avg(excess) FILTER (early) AS first_half, avg(excess) FILTER (NOT early) AS second_half FROM hh GROUP BY 1),
o AS (SELECT session, turn, fwd, mean, row_number() OVER (PARTITION BY session, turn ORDER BY {mixed_sql('ticker', 'session_idx', 'turn')}, ticker) AS n FROM p, (SELECT unnest(range({n})) AS turn) WHERE session IN (SELECT session FROM dd)), so AS (SELECT rule, turn, session, avg(fwd) - max(mean) AS e FROM o JOIN dd USING (session) WHERE n <= k GROUP BY 1, 2, 3), m AS (SELECT rule, turn, avg(e) AS drawn FROM so GROUP BY 1, 2),
lu AS (SELECT rule, avg(CAST(drawn >= excess - 1e-9 AS INT)) AS p FROM m JOIN f USING (rule) GROUP BY 1)
SELECT rule, dates, picks, round(hit, 6) AS hit, round(pool_hit, 6) AS pool_hit, round(beat, 6) AS beat, round(excess, 6) AS excess, round(t, 4) AS t, round(first_half, 6) AS first_half, round(second_half, 6) AS second_half, round(p, 4) AS p FROM f JOIN lu USING (rule)"""


def luck(spark, d, rules, outcome):
    pool = mp.scores(spark, d).join(F.broadcast(calendar(spark, d)), "session").withColumns({k: F.expr(v) for k, v in rules.items()})  # some hundred sessions a year
    f = draws.against_draws(pool, list(rules), "session", "session_idx", outcome)
    return f.select("rule", "dates", "picks", *[r(c, c) for c in ("hit", "pool_hit", "beat", "excess")], r("t", "t", 4), r("first_half", "first_half"), r("second_half", "second_half"), r("p", "p", 4))


@query("E125_rule_accuracy", draw_sql(RULES, "fwd5", 1000))
def rule_accuracy(spark, d):
    """Rules against their dates' pools and against 1,000 draws of as many names."""
    return luck(spark, d, RULES, "fwd5")


@query("E105_pattern_draws", draw_sql(PATTERN, "fwd20", 1000))
def pattern_draws(spark, d):
    """Names that climb from their low, over the next 20 bars, against the pool and random draws."""
    return luck(spark, d, PATTERN, "fwd20")


# ---- one rule chosen on the first years

FLAGS = {"dip": "ret20 < -0.05", "over": "over50 > 0", "thin": "traded20 < 120000", "calm": "range20 < 0.55"}
SPLIT = "1999-01-01"


def search_sql() -> str:
    rules = " UNION ALL ".join(f"SELECT '{name}' AS rule, {bits} AS bits, {n} AS size, {k} AS k" for name, bits, n, k in draws.k_of_n(list(FLAGS)))
    mask = " + ".join(f"CASE WHEN {v} THEN {1 << i} ELSE 0 END" for i, v in enumerate(FLAGS.values()))
    return f"""WITH {mp.SCORES}, r AS ({rules}), bb AS (SELECT session >= DATE '{SPLIT}' AS test, date_trunc('quarter', session) AS q, {mask} AS mask, fwd20 AS v FROM g WHERE fwd20 IS NOT NULL),
m AS (SELECT rule, size, k, test, q, count(*) AS n, sum(v) AS total FROM r JOIN bb ON bit_count(mask & bits) >= k GROUP BY ALL), h AS (SELECT rule, size, k, test, CAST(sum(n) AS BIGINT) AS n, sum(total) / sum(n) AS mean, CASE WHEN count(*) >= 3 THEN avg(total / n) / (stddev_samp(total / n) / sqrt(count(*))) END AS t FROM m GROUP BY 1, 2, 3, 4),
p AS (SELECT *, n >= 30 AND t IS NOT NULL AS fit, row_number() OVER (ORDER BY (n >= 30 AND t IS NOT NULL) DESC, floor(t * 1e6 + 0.5) DESC NULLS LAST, size, k, rule) AS place FROM h WHERE NOT test), c AS (SELECT *, place = 1 AND fit AS chosen FROM p)
SELECT c.rule, c.size, c.k, c.n AS train_n, round(c.mean, 6) AS train_mean, round(c.t, 4) AS train_t, place, chosen, CASE WHEN chosen THEN h.n END AS test_n, round(CASE WHEN chosen THEN h.mean END, 6) AS test_mean, round(CASE WHEN chosen THEN h.t END, 4) AS test_t FROM c LEFT JOIN h ON h.rule = c.rule AND h.test"""


@query("E101_rule_search", search_sql())
def rule_search(spark, d):
    """All k-of-n rules on the first years; the best one, and no other, on the years after."""
    rows = mp.scores(spark, d).withColumns({k: F.expr(v) for k, v in FLAGS.items()})
    f = draws.chosen_rule(rows, list(FLAGS), "fwd20", "session", SPLIT)
    return f.select("rule", "size", "k", "train_n", r("train_mean", "train_mean"), r("train_t", "train_t", 4), "place", "chosen", "test_n", r("test_mean", "test_mean"), r("test_t", "test_t", 4))


# ---- events against the same name's quiet days

STUDY = f"""{BARS}, {CALENDAR}, {TRADES}, b AS (SELECT ticker, session, row_number() OVER ({mp.T}) AS bar, close * volume AS traded, lead(close, 20) OVER ({mp.T}) / lead(open) OVER ({mp.T}) - 1 AS fwd FROM bars), span AS (SELECT ticker, count(*) AS bars FROM b GROUP BY 1),
ev AS (SELECT accession AS event, issuer + 1 AS ticker, role, filed, coalesce((SELECT max(bar) FROM b WHERE b.ticker = issuer + 1 AND b.session < filed), 0) + 1 AS place FROM trades), e AS (SELECT event, ev.ticker, role, place FROM ev JOIN span USING (ticker) WHERE place <= bars),
tr AS (SELECT event, ticker, role, place, turn, place - 250 + {mixed_sql('event', 'place', 'turn')} % 501 AS spot FROM e, (SELECT unnest(range(1, 21)) AS turn)), ok AS (SELECT event, ticker, role, spot, min(turn) AS turn FROM tr JOIN span USING (ticker) WHERE spot >= 1 AND spot <= bars - 20 AND NOT EXISTS (SELECT 1 FROM e x WHERE x.ticker = tr.ticker AND x.role = tr.role AND abs(x.place - tr.spot) <= 10) GROUP BY 1, 2, 3, 4),
pl AS (SELECT event, ticker, role, spot AS place FROM (SELECT *, row_number() OVER (PARTITION BY event ORDER BY turn) AS n FROM ok) WHERE n <= 5)"""


def placed(spark, d):
    """(events, spans, bars): events at their name's first bar from the filing day on, the bars of each name, and all bars
    numbered, with their fifth of traded value on the day and what followed."""
    b = bars(spark, d).select("ticker", "session", F.row_number().over(w.order()).cast("long").alias("bar"), (C("close") * C("volume")).alias("traded"), w.forward_return(20).alias("fwd"))
    span = b.groupBy("ticker").agg(F.count("*").alias("bars"))
    e = trades(spark, d).select(C("accession").alias("event"), (C("issuer") + 1).alias("ticker"), "role", "filed")
    at = asof.backward(e, b, "ticker", "filed", "session", ["bar"], strict=True).withColumn("place", F.coalesce("bar", F.lit(0).cast("long")) + 1)
    return at.join(span, "ticker").where("place <= bars").select("event", "ticker", "role", "place"), span, b


@query("E115_placebo_dates", f"WITH {STUDY} SELECT event, pl.ticker, role, pl.place, session FROM pl JOIN b ON b.ticker = pl.ticker AND b.bar = pl.place")
def placebo_dates(spark, d):
    """Up to five quiet days of the same name for each event, more than ten bars from any event of its kind."""
    e, span, b = placed(spark, d)
    p = draws.clear_dates(e, ["ticker", "role"], span)
    return p.join(b.select("ticker", C("bar").alias("place"), "session"), ["ticker", "place"]).select("event", "ticker", "role", "place", "session")


@query("E114_events_and_placebos", f"""WITH {STUDY}, q AS (SELECT *, (row_number() OVER (PARTITION BY session ORDER BY traded, ticker) - 1) * 5 // count(*) OVER (PARTITION BY session) AS fifth FROM b), x AS (SELECT ticker, bar, session, (fwd - avg(fwd) OVER (PARTITION BY session, fifth)) * 100 AS excess FROM q WHERE fwd IS NOT NULL),
y AS (SELECT event, role, session, excess FROM e JOIN x ON x.ticker = e.ticker AND x.bar = e.place), z AS (SELECT event, avg(excess) AS control, count(*) AS k FROM pl JOIN x ON x.ticker = pl.ticker AND x.bar = pl.place GROUP BY 1), j AS (SELECT role, session, excess, control, excess - control AS diff FROM y JOIN z USING (event)),
t AS (SELECT role, avg(m) / (stddev_samp(m) / sqrt(count(*))) AS t, count(*) AS quarters FROM (SELECT role, date_trunc('quarter', session) AS qq, avg(diff) AS m FROM j GROUP BY 1, 2) GROUP BY 1 HAVING count(*) >= 3)
SELECT role, count(*) AS episodes, round(avg(excess), 5) AS excess, round(avg(control), 5) AS control, round(avg(diff), 5) AS diff, any_value(quarters) AS quarters, round(any_value(t), 4) AS t FROM j JOIN t USING (role) GROUP BY 1""")
def events_and_placebos(spark, d):
    """Each event's excess over names of its liquidity fifth, less that of its own placebo days; t over quarters."""
    e, span, b = placed(spark, d)
    day = Window.partitionBy("session")
    q = b.withColumn("fifth", F.floor((F.row_number().over(day.orderBy("traded", "ticker")) - 1) * 5 / F.count("*").over(day))).where("fwd is not null")
    x = q.select("ticker", C("bar").alias("place"), "session", ((C("fwd") - F.avg("fwd").over(Window.partitionBy("session", "fifth"))) * 100).alias("excess"))
    control = draws.clear_dates(e, ["ticker", "role"], span).join(x, ["ticker", "place"]).groupBy("event").agg(F.avg("excess").alias("control"))
    j = e.join(x, ["ticker", "place"]).join(control, "event").withColumn("diff", C("excess") - C("control"))
    quarters = j.groupBy("role", F.date_trunc("quarter", "session").alias("q")).agg(F.avg("diff").alias("m")).groupBy("role").agg(F.count("*").alias("quarters"), t_stat("m").alias("t"))
    found = j.groupBy("role").agg(F.count("*").alias("episodes"), *[F.avg(c).alias(c) for c in ("excess", "control", "diff")]).join(quarters.where("quarters >= 3"), "role")
    return found.select("role", "episodes", *[r(c, c, 5) for c in ("excess", "control", "diff")], "quarters", r("t", "t", 4))


# ---- what was known, and series that were corrected

VINTAGES = """v AS (SELECT o_orderpriority AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS obs_date, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS early, round(sum(o_totalprice), 2) AS late FROM orders GROUP BY 1, 2),
vin AS (SELECT series, obs_date, early AS value, CAST(obs_date + INTERVAL 1 MONTH AS DATE) + 15 AS rs, CAST(obs_date + INTERVAL 1 MONTH AS DATE) + 59 AS re FROM v UNION ALL SELECT series, obs_date, late, CAST(obs_date + INTERVAL 1 MONTH AS DATE) + 60, DATE '9999-12-31' FROM v)"""


def vintages(spark, d):
    """Monthly sums by priority as a feed tells them: finished orders 15 days after the month, all orders 60 days after."""
    month = F.to_date(F.date_trunc("month", "o_orderdate"))
    v = table(spark, d, "orders").groupBy(C("o_orderpriority").alias("series"), month.alias("obs_date")).agg(F.round(F.sum(F.when(C("o_orderstatus") == "F", C("o_totalprice"))) + 1e-9, 2).alias("early"), F.round(F.sum("o_totalprice") + 1e-9, 2).alias("late"))
    told = F.add_months("obs_date", 1)
    spans = F.array(F.struct(C("early").alias("value"), F.date_add(told, 15).alias("realtime_start"), F.date_add(told, 59).alias("realtime_end")), F.struct(C("late").alias("value"), F.date_add(told, 60).alias("realtime_start"), F.lit(macro.OPEN_END).cast("date").alias("realtime_end")))
    return v.select("series", "obs_date", F.explode(spans).alias("x")).select("series", "obs_date", "x.*")


@query("A39_known_on", f"WITH {CALENDAR}, {VINTAGES}, g AS (SELECT session FROM cal WHERE session_idx % 10 = 1), k AS (SELECT series, session, obs_date, value, re, row_number() OVER (PARTITION BY series, session ORDER BY obs_date DESC, rs DESC) AS n FROM g JOIN vin ON rs <= session) SELECT series, session, obs_date, round(CASE WHEN re >= session THEN value END, 2) AS value FROM k WHERE n = 1")
def known_on(spark, d):
    """What each series showed on each day, revisions as they were then."""
    days = calendar(spark, d).where("session_idx % 10 = 1")
    return macro.known_on(vintages(spark, d), days).select("series", "session", "obs_date", r("value", "value", 2))


def split_store(spark, d):
    """(bars as stored, corrections declared): every tenth name's bars before a day stand at 1,000 times their price; half
    of the declared factors are right, half are not."""
    b = bars(spark, d).select("ticker", "session", "open", "high", "low", "close", "volume")
    ex = b.where("ticker % 10 = 0 and session >= date'1998-01-05'").groupBy("ticker").agg(F.min("session").alias("ex"))
    stored = b.join(F.broadcast(ex), "ticker", "left")  # one row a declared name
    k = F.when(C("session") < C("ex"), 1000.0).otherwise(1.0)
    stored = stored.select("ticker", "session", *[(C(c) * k).alias(c) for c in ("open", "high", "low", "close")], "volume")
    return stored, ex.select("ticker", "ex", F.when(C("ticker") % 20 == 0, 0.001).otherwise(0.9).alias("factor"))


@query("B23_rebased", f"""WITH {BARS}, x AS (SELECT ticker, min(session) AS ex FROM bars WHERE ticker % 10 = 0 AND session >= DATE '1998-01-05' GROUP BY 1), st AS (SELECT b.ticker, b.session, close * CASE WHEN session < ex THEN 1000 ELSE 1 END AS close, ex FROM bars b LEFT JOIN x USING (ticker)),
l AS (SELECT *, ln(close / lag(close) OVER ({mp.T})) AS v FROM st), z AS (SELECT *, CASE WHEN count(v) OVER f >= 20 AND stddev_samp(v) OVER f > 0 THEN v / stddev_samp(v) OVER f END AS z, stddev_samp(v) OVER f AS sd FROM l WINDOW f AS ({mp.T} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
m AS (SELECT ticker, ex, CASE WHEN ticker % 20 = 0 THEN 0.001 ELSE 0.9 END AS factor, v, z, sd FROM z WHERE session = ex), a AS (SELECT *, CASE WHEN v IS NULL THEN 'skip' WHEN NOT CASE WHEN z IS NOT NULL THEN abs(z) > 5 ELSE abs(exp(v) - 1) > 0.15 END THEN 'held' WHEN CASE WHEN z IS NOT NULL THEN abs((v - ln(factor)) / sd) > 5 ELSE abs(exp(v - ln(factor)) - 1) > 0.15 END THEN 'refuse' ELSE 'adjust' END AS action FROM m)
SELECT st.ticker, st.session, round(close * CASE WHEN action = 'adjust' AND st.session < st.ex THEN factor ELSE 1 END, 4) AS close, action FROM st JOIN a USING (ticker)""")
def rebased_bars(spark, d):
    """Bars of the corrected names after re-basing, with what was decided about each name."""
    stored, declared = split_store(spark, d)
    verdict = rb.measured(stored, declared).select("ticker", "action")
    return rb.rebased(stored, declared).join(F.broadcast(verdict), "ticker").select("ticker", "session", r("close", "close", 4), "action")


# ---- trades on half-hour bars, then days: an event's value is a trade's price, its user the name

INTRA = """s AS (SELECT user_id AS ticker, CAST(ts AS DATE) AS day, CAST((hour(ts) * 60 + minute(ts)) // 30 AS INT) AS slot, arg_min(value, (ts, value)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, value)) AS close FROM events WHERE value > 0 GROUP BY 1, 2, 3),
d AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY day) AS n FROM (SELECT ticker, day, arg_min(open, slot) AS open, max(high) AS high, min(low) AS low, arg_max(close, slot) AS close FROM s GROUP BY 1, 2))"""


def ends_sql(keys: str, gain: float, loss: float, hold: int) -> str:
    """Trades e (keys, ticker, day, n, slot, price, inside) to their ends: one list of bars, slots before days."""
    return f"""p AS (SELECT e.*, slot_no AS at, b.open, b.high, b.low, b.close FROM e JOIN (SELECT ticker, day, slot AS slot_no, open, high, low, close FROM s) b ON b.ticker = e.ticker AND b.day = e.day AND slot_no >= e.slot UNION ALL SELECT e.*, 100 + d.n - e.n, d.open, d.high, d.low, d.close FROM e JOIN d ON d.ticker = e.ticker AND d.n > e.n AND d.n <= e.n + {hold - 1}),
i AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY "at") AS i, count(*) OVER (PARTITION BY {keys}) AS bars FROM p), x AS (SELECT *, price * {1 - loss} AS st, price * {1 + gain} AS tg FROM i),
h AS (SELECT *, CASE WHEN i > 1 AND open <= st THEN open WHEN i > 1 AND open >= tg THEN open WHEN low <= st THEN st WHEN high >= tg AND (i > 1 OR NOT inside) THEN tg END AS px, CASE WHEN i > 1 AND open <= st THEN 'stop' WHEN i > 1 AND open >= tg THEN 'target' WHEN low <= st THEN 'stop' ELSE 'target' END AS kind FROM x),
f AS (SELECT {keys}, day, any_value(price) AS price, min(i) FILTER (px IS NOT NULL) AS hit, any_value(bars) AS bars, arg_max(close, i) AS last, arg_min(px, i) FILTER (px IS NOT NULL) AS px, arg_min(kind, i) FILTER (px IS NOT NULL) AS kind FROM h GROUP BY {keys}, day)
SELECT {keys}, day, round(price, 6) AS price, round(coalesce(px, last) / price - 1, 6) AS ret, CAST(coalesce(hit, bars) AS INT) AS bars, coalesce(kind, 'time') AS kind FROM f"""


@query("F54_slots_then_days", f"WITH {INTRA}, e AS (SELECT s.ticker, s.day, any_value(d.n) AS n, min(slot) AS slot, arg_min(s.open, slot) AS price, false AS inside FROM s JOIN d ON d.ticker = s.ticker AND d.day = s.day WHERE slot >= 4 GROUP BY 1, 2), {ends_sql('ticker, day', 0.4, 0.3, 5)}".replace("SELECT ticker, day, day,", "SELECT ticker, day,").replace("GROUP BY ticker, day, day)", "GROUP BY ticker, day)"))
def slots_then_days(spark, d):
    """A trade a day from its fifth half hour on, ended inside the day or on one of the four days after it."""
    b = it.days(it.slots(table(spark, d, "events"), "user_id", "ts", "value"))
    return it.after_open(b, 4, 0.4, 0.3, 5).select("ticker", "day", r("price", "price"), r("ret", "ret"), "bars", "kind")


@query("F66_limit_by_slots", f"""WITH {INTRA}, o AS (SELECT ticker, day AS signal, n AS n0, close * 0.9 AS lim FROM d), c AS (SELECT o.ticker, signal, d.day, d.n, s.slot, CASE WHEN s.open <= lim THEN s.open WHEN s.low <= lim * 0.998 THEN lim END AS price, s.open > lim AS inside FROM o JOIN d ON d.ticker = o.ticker AND d.n BETWEEN n0 + 1 AND n0 + 3 JOIN s ON s.ticker = d.ticker AND s.day = d.day),
e AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY ticker, signal ORDER BY n, slot) AS k FROM c WHERE price IS NOT NULL) WHERE k = 1), {ends_sql('ticker, signal', 0.4, 0.3, 5)}""")
def limit_by_slots(spark, d):
    """Orders a tenth under the close, followed in half hours for three days, then ended as any trade."""
    b = it.days(it.slots(table(spark, d, "events"), "user_id", "ts", "value"))
    return it.limit_orders(b, 0.1, 0.002, 3, 0.4, 0.3, 5).select("ticker", "signal", "day", r("price", "price"), r("ret", "ret"), "bars", "kind")


# ---- zones read from shortened histories


@query("E124_zone_lengths")
def zone_lengths(spark, d):
    """Shares of levels that are reached, fail and hold, by the length of history that they were read from."""
    out = zs.by_arm(stored(zs.scored(bars(spark, d))))  # the readings are dear, and three figures rest on them
    return out.select("arm", "levels", r("reached", "reached"), r("failed", "failed"), r("hit", "hit"), "dates", r("diff", "diff"), r("t", "t", 4))


# ---- lists of names: against seeds, by bucket, traded, by recipe

LISTED = f"""{mp.SCORES}, q AS (SELECT g.*, session_idx, CASE WHEN ret20 IS NOT NULL THEN row_number() OVER (PARTITION BY session ORDER BY ret20 DESC NULLS LAST, ticker) END AS place FROM g JOIN cal USING (session))"""


def listed(spark, d):
    """Names of the grid dates with their place by 20-bar return."""
    day = Window.partitionBy("session").orderBy(F.col("ret20").desc_nulls_last(), "ticker")
    x = mp.scores(spark, d).join(F.broadcast(calendar(spark, d)), "session")  # some sessions a year
    return x.withColumn("place", F.when(C("ret20").isNotNull(), F.row_number().over(day)))


SEEDS = 20


@query("E17_screen_against_seeds", f"""WITH {LISTED}, p AS (SELECT * FROM q WHERE fwd5 IS NOT NULL), k AS (SELECT session, count(*) AS k FROM p WHERE place <= 5 GROUP BY 1), o AS (SELECT session, fwd5, turn, row_number() OVER (PARTITION BY session, turn ORDER BY {mixed_sql('ticker', 'session_idx', 'turn')}, ticker) AS n FROM p, (SELECT unnest(range(1, {SEEDS + 1})) AS turn)),
r AS (SELECT turn, fwd5 FROM o JOIN k USING (session) WHERE n <= k), ts AS (SELECT turn, avg(fwd5) AS m, avg(CAST(fwd5 > 0 AS INT)) AS w FROM r GROUP BY 1), aa AS (SELECT count(*) AS n, avg(fwd5) AS m, var_samp(fwd5) AS v, avg(CAST(fwd5 > 0 AS INT)) AS w FROM p WHERE place <= 5), bb AS (SELECT count(*) AS n, avg(fwd5) AS m, var_samp(fwd5) AS v FROM r)
SELECT aa.n AS picks, round(aa.m, 6) AS screen, round(aa.w, 6) AS screen_win, round((SELECT avg(m) FROM ts), 6) AS random, round((SELECT min(m) FROM ts), 6) AS random_low, round((SELECT max(m) FROM ts), 6) AS random_high, round((SELECT avg(w) FROM ts), 6) AS random_win, (SELECT count(*) FROM ts WHERE ts.m >= aa.m - 1e-9) AS seeds_as_good, round((aa.m - bb.m) / sqrt(aa.v / aa.n + bb.v / bb.n), 4) AS t FROM aa, bb""")
def screen_against_seeds(spark, d):
    """The five best names of each date against as many drawn by each of twenty seeds: range of the seeds, Welch's t."""
    p = listed(spark, d).where("fwd5 is not null").select("session", "session_idx", "ticker", "fwd5", (C("place") <= 5).alias("hit"))
    k = p.where("hit").groupBy("session").agg(F.count("*").alias("k"))
    turns = p.join(k, "session").withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(SEEDS).cast("long"))))
    order = Window.partitionBy("session", "turn").orderBy(draws.mixed(C("ticker"), C("session_idx"), C("turn")), "ticker")
    drawn = turns.withColumn("n", F.row_number().over(order)).where("n <= k").select("turn", "fwd5")
    up = F.avg((C("fwd5") > 0).cast("double"))
    seeds = drawn.groupBy("turn").agg(F.avg("fwd5").alias("m"), up.alias("w"))
    a = p.where("hit").agg(F.count("*").alias("picks"), F.avg("fwd5").alias("screen"), F.var_samp("fwd5").alias("va"), up.alias("screen_win"))
    b = drawn.agg(F.count("*").alias("nb"), F.avg("fwd5").alias("mb"), F.var_samp("fwd5").alias("vb"))
    s = seeds.agg(F.avg("m").alias("random"), F.min("m").alias("random_low"), F.max("m").alias("random_high"), F.avg("w").alias("random_win"), F.collect_list("m").alias("each"))
    one = a.join(F.broadcast(b), how="cross").join(F.broadcast(s), how="cross")  # one row each
    good = F.size(F.filter("each", lambda m: m >= C("screen") - 1e-9)).cast("long")
    t = ratio(C("screen") - C("mb"), F.sqrt(ratio(C("va"), C("picks")) + ratio(C("vb"), C("nb"))))
    one = one.withColumn("seeds_as_good", good)  # before the rounded column of that name can stand for it
    return one.select("picks", *[r(c, c) for c in ("screen", "screen_win", "random", "random_low", "random_high", "random_win")], "seeds_as_good", r(t, "t", 4))


@query("E19_replay_medians", f"WITH {LISTED} SELECT CAST(floor((place - 1) / 5) AS BIGINT) AS bucket, count(*) AS n, round(quantile_cont(fwd5, 0.5), 6) AS fwd5, round(quantile_cont(fwd20, 0.5), 6) AS fwd20, round(avg(CAST(fwd5 > 0 AS INT)), 6) AS win FROM q WHERE place <= 20 GROUP BY 1")
def replay_medians(spark, d):
    """What followed past lists, as medians by bucket of five places."""
    x = listed(spark, d).where("place <= 20").withColumn("bucket", F.floor((C("place") - 1) / 5))
    return x.groupBy("bucket").agg(F.count("*").alias("n"), *[r(F.percentile(c, F.lit(0.5)), c) for c in ("fwd5", "fwd20")], r(F.avg((C("fwd5") > 0).cast("double")), "win"))


LEDGER_END = "1999-01-01"


@query("E99_shortlist_trades", f"""WITH {LISTED.replace(BARS + ", " + CALENDAR + ", b AS", BARS + ", " + CALENDAR + ", b0 AS").replace("FROM b WINDOW", "FROM b0 WINDOW")}, {PATHS}, h AS (SELECT ticker, session, min(i) AS i FROM j WHERE low <= entry - atr OR high >= entry + 2 * atr GROUP BY 1, 2), z AS (SELECT ticker, session, max(i) AS i FROM j GROUP BY 1, 2),
done AS (SELECT j.ticker, j.session, CASE WHEN h.i IS NULL THEN j.close WHEN j.low <= entry - atr THEN entry - atr ELSE entry + 2 * atr END / entry - 1 AS ret, j.i AS held FROM z LEFT JOIN h USING (ticker, session) JOIN j ON j.ticker = z.ticker AND j.session = z.session AND j.i = coalesce(h.i, z.i))
SELECT q.ticker, q.session, CAST(place AS INT) AS place, round(ret, 6) AS ret, CAST(held AS BIGINT) AS held FROM q JOIN done ON done.ticker = q.ticker AND done.session = q.session WHERE place <= 5 AND q.session >= DATE '{LEDGER_END}'""")
def shortlist_trades(spark, d):
    """Listed names that the ledger has not closed yet, each traded by the bracket rule from its next open."""
    wanted = F.broadcast(stored(listed(spark, d).where("place <= 5").select("ticker", "session", "place")))  # five names a grid date
    closed = wanted.where(C("session") < F.lit(LEDGER_END)).select("ticker", "session")  # what the ledger holds
    open_rows = wanted.join(F.broadcast(closed), ["ticker", "session"], "left_anti")
    # Lines of other names are not dealt, and paths, twenty times as wide as bars, go through no exchange.
    held = bars(spark, d).join(F.broadcast(open_rows.select("ticker").distinct()), "ticker", "left_semi")
    paths = bt.with_paths(held).join(F.broadcast(open_rows), ["ticker", "session"])
    return bt.exits(paths, ["bracket_1x2"], ("ticker", "session", "place")).select("ticker", "session", "place", r("ret", "ret"), "held")


@query("C12_good_levels", f"""WITH {BARS}, {WALK}, x AS (SELECT ticker, session, close / min(low) OVER (f ROWS 19 PRECEDING) - 1 AS dist, close / max(high) OVER (f ROWS 19 PRECEDING) AS pct_hi, round(close / lag(close, 20) OVER f - 1, 9) AS v, volume FROM walk WINDOW f AS (PARTITION BY ticker ORDER BY session)),
k AS (SELECT *, 100 * {mp.avg_rank('v', 'session')} / count(*) OVER (PARTITION BY session) AS fund, 100 * {mp.avg_rank('volume', 'session')} / count(*) OVER (PARTITION BY session) AS hype FROM x WHERE v IS NOT NULL) SELECT ticker, session, round(dist, 6) AS dist, round(pct_hi, 6) AS pct_hi FROM k WHERE dist <= 0.06 AND pct_hi >= 0.80 AND fund >= 55 AND hype <= 45""")
def good_levels(spark, d):
    """Near the low, near the high of the same bars, with a high score and low attention: the rule's four fixed bounds."""
    f = w.rows(-19)
    x = walk_bars(spark, d).select("ticker", "session", (ratio(C("close"), F.min("low").over(f)) - 1).alias("dist"), ratio(C("close"), F.max("high").over(f)).alias("pct_hi"), r(ratio(C("close"), F.lag("close", 20).over(w.order())) - 1, "v", 9), "volume").where("v is not null")
    held = F.count("*").over(Window.partitionBy("session"))
    x = x.withColumn("fund", ratio(100 * rank_avg("v", "session"), held)).withColumn("hype", ratio(100 * rank_avg("volume", "session"), held))
    return x.where("dist <= 0.06 and pct_hi >= 0.80 and fund >= 55 and hype <= 45").select("ticker", "session", r("dist", "dist"), r("pct_hi", "pct_hi"))


ZONES_ON = "1999-06-15"


@query("D33_zones_on_a_day", f"""WITH {BARS}, w AS (SELECT ticker, session, low, min(low) OVER f AS m, count(low) OVER f AS n, lead(session, 5) OVER (PARTITION BY ticker ORDER BY session) AS known FROM bars WINDOW f AS (PARTITION BY ticker ORDER BY session ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)), z AS (SELECT ticker, low AS level, known, last_day(known) AS file FROM w WHERE n = 11 AND low = m),
ff AS (SELECT max(file) AS file FROM z WHERE file <= DATE '{ZONES_ON}'), l AS (SELECT ticker, arg_max(close, session) AS price FROM bars WHERE session <= DATE '{ZONES_ON}' GROUP BY 1), c AS (SELECT z.ticker, level, price, row_number() OVER (PARTITION BY z.ticker ORDER BY price / level, known DESC, level DESC) AS k FROM z, ff JOIN l ON l.ticker = z.ticker WHERE z.file <= ff.file AND known > ff.file - 365 AND level <= price)
SELECT ticker, round(level, 5) AS level, round(price, 5) AS price, (SELECT file FROM ff) AS file FROM c WHERE k = 1""")
def zones_on_a_day(spark, d):
    """Support levels as the newest monthly file up to a day held them, the nearest one under each name's price. A file holds
    the swing lows of the year before it that were known by then."""
    lows = w.with_swing_low(bars(spark, d)).withColumn("known", F.lead("session", 5).over(w.order())).where("swing_low")
    z = lows.select("ticker", C("low").alias("level"), "known", F.last_day("known").alias("file"))
    newest = F.broadcast(z.where(C("file") <= F.lit(ZONES_ON)).agg(F.max("file").alias("newest")))  # one row
    price = bars(spark, d).where(C("session") <= F.lit(ZONES_ON)).groupBy("ticker").agg(F.max_by("close", "session").alias("price"))
    held = z.join(newest, how="cross").where((C("file") <= C("newest")) & (C("known") > F.date_sub("newest", 365))).join(price, "ticker").where("level <= price")
    near = Window.partitionBy("ticker").orderBy(ratio(C("price"), C("level")), F.desc("known"), F.desc("level"))
    return held.withColumn("k", F.row_number().over(near)).where("k = 1").select("ticker", r("level", "level", 5), r("price", "price", 5), C("newest").alias("file"))


#: Ranking recipes as a user's file declares them: a condition, sort keys, and how many names.
RECIPES = """[{"name": "movers", "where": "over20 > 0", "sort": [["ret5", "desc"]], "top": 3}, {"name": "calm", "where": "ret20 is not null", "sort": [["range20", "asc"], ["traded20", "desc"]], "top": 2}]"""


def recipe_sql() -> str:
    one = lambda x: f"SELECT '{x.name}' AS recipe, session, ticker, row_number() OVER (PARTITION BY session ORDER BY {', '.join(f'{c} {way} NULLS LAST' for c, way in x.sort)}, ticker) AS place, {x.top} AS top FROM g WHERE {x.where}"
    return f"WITH {mp.SCORES}, k AS ({' UNION ALL '.join(map(one, mo.recipes(RECIPES)))}) SELECT recipe, session, ticker, CAST(place AS INT) AS place FROM k WHERE place <= top"


@query("K4_recipes", recipe_sql())
def by_recipe(spark, d):
    """Each recipe's names of every grid date."""
    return mo.by_recipes(mp.scores(spark, d), mo.recipes(RECIPES)).select("recipe", "session", "ticker", "place")


# ---- what is to come, states of groups, studies by kind

EXPECTED = "sn AS (SELECT CAST(o_orderdate AS DATE) AS taken, o_orderkey % 50 + 1 AS ticker, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 23 AS INT) AS day, CASE WHEN o_orderkey % 2 = 0 THEN 'amc' ELSE 'bmo' END AS moment FROM orders)"


@query("D42_upcoming", f"""WITH {BARS}, {CALENDAR}, {EXPECTED}, l AS (SELECT max(taken) AS t FROM sn WHERE taken <= DATE '{NOW}' AND taken >= DATE '{NOW}' - 7), b AS (SELECT min(session_idx) AS b FROM cal WHERE session >= DATE '{NOW}'), x AS (SELECT DISTINCT ticker, day, moment FROM sn, l WHERE taken = t AND day >= DATE '{NOW}'),
m AS (SELECT ticker, day, moment, min(session) AS session, min(session_idx) - (SELECT b FROM b) AS ahead FROM x JOIN cal ON CASE WHEN moment = 'amc' THEN session > day ELSE session >= day END GROUP BY 1, 2, 3) SELECT * FROM m WHERE ahead <= 10""")
def upcoming(spark, d):
    """Expected reports in the ten sessions from NOW on, by the newest snapshot."""
    sn = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("taken"), (C("o_orderkey") % 50 + 1).alias("ticker"), F.date_add(F.to_date("o_orderdate"), (C("o_orderkey") % 23).cast("int")).alias("day"), F.when(C("o_orderkey") % 2 == 0, "amc").otherwise("bmo").alias("moment"))
    return ev.upcoming(sn, calendar(spark, d), NOW)


STATES = f"""{BARS}, {SECTORS}, x AS (SELECT ticker, session, close / lag(close, 20) OVER ({mp.T}) - 1 AS mom, lead(close, 5) OVER ({mp.T}) / lead(open) OVER ({mp.T}) - 1 AS fwd FROM bars), gm AS (SELECT subind, CAST(date_trunc('month', session) AS DATE) AS month, avg(mom) AS v FROM x JOIN sectors USING (ticker) WHERE mom IS NOT NULL GROUP BY 1, 2),
st AS (SELECT subind, month, last_day(month) AS known, CASE WHEN v > quantile_cont(v, 2.0 / 3) OVER (PARTITION BY month) THEN 3 WHEN v <= quantile_cont(v, 1.0 / 3) OVER (PARTITION BY month) THEN 1 ELSE 2 END AS state FROM gm)"""


@query("E49_state_terciles", f"WITH {STATES}, j AS (SELECT st.state, x.fwd FROM x JOIN sectors USING (ticker) ASOF JOIN st ON st.subind = sectors.subind AND st.known <= x.session WHERE x.fwd IS NOT NULL) SELECT state, count(*) AS n, round(avg(fwd), 6) AS mean, round(avg(CAST(fwd > 0 AS INT)), 6) AS up FROM j GROUP BY 1")
def state_terciles(spark, d):
    """Outcomes by the third that the name's group held in the newest whole month."""
    s = sectors(spark, d).select("ticker", "subind")
    x = bars(spark, d).select("ticker", "session", (ratio(C("close"), F.lag("close", 20).over(w.order())) - 1).alias("mom"), w.forward_return(5).alias("fwd")).join(F.broadcast(s), "ticker")  # a row a name
    g = x.where("mom is not null").groupBy("subind", F.trunc("session", "month").alias("month")).agg(F.avg("mom").alias("v"))
    st = cs.with_thirds(g, "v", ["month"], "state").select("subind", F.last_day("month").alias("known"), "state")
    j = asof.backward(x.where("fwd is not null").select("subind", "session", "fwd"), st, "subind", "session", "known", ["state"]).where("state is not null")
    return j.groupBy("state").agg(F.count("*").alias("n"), r(F.avg("fwd"), "mean"), r(F.avg((C("fwd") > 0).cast("double")), "up"))


@query("E112_event_studies", f"""WITH {BARS}, {TRADES}, b AS (SELECT ticker, session, lead(close, 5) OVER ({mp.T}) / lead(open) OVER ({mp.T}) - 1 AS fwd5, lead(close, 20) OVER ({mp.T}) / lead(open) OVER ({mp.T}) - 1 AS fwd20 FROM bars), p AS (SELECT *, avg(fwd5) OVER (PARTITION BY session) AS p5, avg(fwd20) OVER (PARTITION BY session) AS p20 FROM b),
e AS (SELECT DISTINCT role, issuer + 1 AS ticker, filed AS session FROM trades), j AS (SELECT role, session, 5 AS horizon, fwd5 AS v, p5 AS pool FROM p JOIN e USING (ticker, session) UNION ALL SELECT role, session, 20, fwd20, p20 FROM p JOIN e USING (ticker, session)), x AS (SELECT *, (v - pool) * 100 AS x FROM j WHERE v IS NOT NULL),
q AS (SELECT role, horizon, avg(x) AS m FROM x GROUP BY role, horizon, date_trunc('quarter', session)), t AS (SELECT role, horizon, count(*) AS quarters, CASE WHEN count(*) >= 3 THEN avg(m) / (stddev_samp(m) / sqrt(count(*))) END AS t FROM q GROUP BY 1, 2)
SELECT role, horizon, count(*) AS n, round(avg(x), 5) AS mean, round(quantile_cont(x, 0.5), 5) AS median, round(avg(CAST(v > 0 AS INT)), 6) AS up, round(avg(CAST(x > 0 AS INT)), 6) AS beat, round(any_value(t), 4) AS t, any_value(quarters) AS quarters FROM x JOIN t USING (role, horizon) GROUP BY 1, 2 HAVING count(*) >= 10""")
def event_studies(spark, d):
    """Every kind of event at every horizon against its date's pool, in one frame."""
    b = bars(spark, d).select("ticker", "session", w.forward_return(5).alias("fwd5"), w.forward_return(20).alias("fwd20"))
    day = Window.partitionBy("session")
    p = b.withColumn("p5", F.avg("fwd5").over(day)).withColumn("p20", F.avg("fwd20").over(day))
    e = trades(spark, d).select("role", (C("issuer") + 1).alias("ticker"), C("filed").alias("session")).distinct()
    each = F.explode(F.array(F.struct(F.lit(5).alias("horizon"), C("fwd5").alias("v"), C("p5").alias("pool")), F.struct(F.lit(20).alias("horizon"), C("fwd20").alias("v"), C("p20").alias("pool"))))
    j = p.join(e, ["ticker", "session"]).select("role", "session", each.alias("x")).select("role", "session", "x.*")
    out = ev.study(j, "v", "pool", "session", ["role", "horizon"])
    return out.select("role", "horizon", "n", r("mean", "mean", 5), r("median", "median", 5), r("up", "up"), r("beat", "beat"), r("t", "t", 4), "quarters")


@query("F35_zone_scan")
def zone_scan(spark, d):
    """Every name of the walking bars with its zones, or why it has none."""
    z = levels.zone_scan(walk_bars(spark, d))
    return z.select("ticker", r("level", "level"), r("dist_pct", "dist_pct", 4), "touches", "bounces", r("bounce_median", "bounce_median"), "bars_since_touch", "no_support", "suspect")
