"""Draws, placebo dates and rule searches against plain Python."""

import datetime as dt
import itertools
import random
import statistics

import pytest

from barloom.operators import draws

DAY = dt.date(2021, 1, 1)


def pool_rows(seed=3, dates=6, names=25):
    r = random.Random(seed)
    return [(t, DAY + dt.timedelta(30 * i), i + 1, r.gauss(0, 1) + (2.0 if t < 4 else 0.0), t < 4, t % 3 == 0, t == 0) for i in range(dates) for t in range(names)]


SHAPE = "ticker long, day date, number long, out double, good boolean, any_third boolean, rare boolean"


def test_draws_against_python(spark):
    """Planted picks beat all draws, others do not, and each draw is what the hash order says; one pick a date is no rule."""
    rows, n = pool_rows(), 200
    found = {x.rule: x for x in draws.against_draws(spark.createDataFrame(rows, SHAPE), ["good", "any_third", "rare"], "day", "number", "out", n).collect()}
    assert set(found) == {"good", "any_third"}
    by = {k: list(g) for k, g in itertools.groupby(rows, key=lambda x: x[1])}
    for rule, at in (("good", 4), ("any_third", 5)):
        excess = [statistics.mean(x[3] for x in g if x[at]) - statistics.mean(x[3] for x in g) for g in by.values()]
        k = sum(x[at] for x in by[DAY])
        luck = [statistics.mean(statistics.mean(x[3] for x in sorted(g, key=lambda x: (draws.mixed(x[0], x[2], turn), x[0]))[:k]) - statistics.mean(x[3] for x in g) for g in by.values()) for turn in range(n)]
        x = found[rule]
        assert x.excess == pytest.approx(statistics.mean(excess)) and x.dates == 6 and x.picks == 6 * k
        assert x.p == pytest.approx(sum(v >= statistics.mean(excess) - 1e-9 for v in luck) / n)
        assert x.first_half == pytest.approx(statistics.mean(excess[:3])) and x.second_half == pytest.approx(statistics.mean(excess[3:]))
    assert found["good"].p == 0 < found["any_third"].p


def test_draw_of_the_whole_pool_is_no_luck(spark):
    rows = [(t, DAY, 1, float(t), True) for t in range(8)]
    x = draws.against_draws(spark.createDataFrame(rows, "ticker long, day date, number long, out double, all_in boolean"), ["all_in"], "day", "number", "out", 50).collect()
    assert [(v.excess, v.p) for v in x] == [(0.0, 1.0)]


def test_draws_do_not_repeat_orders():
    """Replicates are different orders, not turns of one."""
    orders = {tuple(sorted(range(12), key=lambda t: draws.mixed(t, 5, turn))) for turn in range(300)}
    assert len(orders) == 300
    cycles = {o[o.index(0) :] + o[: o.index(0)] for o in orders}
    assert len(cycles) > 290


def test_placebos_are_clear_of_events(spark):
    r = random.Random(7)
    events = [(i, t, kind, r.randint(1, 600)) for i, (t, kind) in enumerate((r.randint(1, 3), r.choice("ab")) for _ in range(60))]
    # A crowd of events on one name leaves little room; two events on one place.
    events += [(100 + i, 9, "a", 10 * i + 1) for i in range(60)] + [(200, 1, "a", 300), (201, 1, "a", 300)]
    span = [(t, 620) for t in (1, 2, 3, 9)]
    got = draws.clear_dates(spark.createDataFrame(events, "event long, ticker long, kind string, place long"), ["ticker", "kind"], spark.createDataFrame(span, "ticker long, bars long")).collect()
    want = set()
    for e, t, kind, p in events:
        free = []
        for turn in range(1, 21):
            at = p - 250 + draws.mixed(e, p, turn) % 501
            if 1 <= at <= 600 and at not in free and not any(x[1] == t and x[2] == kind and abs(x[3] - at) <= 10 for x in events):
                free.append(at)
        want |= {(e, t, kind, at) for at in free[:5]}
    assert {tuple(x) for x in got} == want and len(got) == len(want)
    assert not any(x.ticker == 9 and x.kind == "a" and x.place < 592 for x in got)


def test_rules_are_all_subsets_and_counts():
    assert len(draws.k_of_n(list("abcd"))) == 32 and len({r[0] for r in draws.k_of_n(list("abcd"))}) == 32


def test_one_rule_is_tested(spark):
    """Against a loop over all rules; the test's figures stand at the chosen rule alone."""
    r, rows = random.Random(9), []
    for i in range(600):
        a, b, c = (r.random() < 0.5 for _ in range(3))
        rows.append((DAY + dt.timedelta(4 * i), a, b, c if i % 9 else None, r.gauss(1.0 if a and b else 0.0, 1)))
    frame = spark.createDataFrame(rows, "day date, a boolean, b boolean, c boolean, out double")
    split = DAY + dt.timedelta(1500)
    got = {x.rule: x for x in draws.chosen_rule(frame, ["a", "b", "c"], "out", "day", split.isoformat()).collect()}

    def figures(name, test):
        _, bits, _, k = next(x for x in draws.k_of_n(["a", "b", "c"]) if x[0] == name)
        met = [(d, v) for d, *flags, v in rows if sum(bool(f) for i, f in enumerate(flags) if bits >> i & 1) >= k and (d >= split) == test]
        quarters = {}
        for d, v in met:
            quarters.setdefault((d.year, (d.month - 1) // 3), []).append(v)
        means = [statistics.mean(v) for v in quarters.values()]
        return len(met), statistics.mean(v for _, v in met), statistics.mean(means) / (statistics.stdev(means) / len(means) ** 0.5)

    assert len(got) == 12
    for name, x in got.items():
        assert (x.train_n, x.train_mean, x.train_t) == pytest.approx(figures(name, False))
    best = max(got.values(), key=lambda x: x.train_t)
    assert [x.rule for x in got.values() if x.chosen] == [best.rule] and best.place == 1
    assert (best.test_n, best.test_mean, best.test_t) == pytest.approx(figures(best.rule, True))
    assert all(x.test_n is None and x.test_t is None for x in got.values() if not x.chosen)
