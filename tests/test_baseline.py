import math
import random
import statistics
from datetime import date, timedelta

import pytest

from tidemark import Settings
from tidemark.operators.baseline import seasonal_baselines


def brute_force(rows, cfg):
    out = {}
    for e, m, d, v in rows:
        if v is None or not cfg.baseline_start <= d <= cfg.baseline_end:
            continue
        doy = d.timetuple().tm_yday
        for k in range(-cfg.half_window, cfg.half_window + 1):
            cell = out.setdefault((e, m, (doy - 1 + k) % 366 + 1), ([], set()))
            cell[0].append(v)
            cell[1].add(d.year)
    return out


@pytest.mark.parametrize("last_year", [2006, 2090])
def test_matches_brute_force(readings, last_year):
    rng = random.Random(3)
    cfg = Settings(baseline_start=date(2003, 6, 1), baseline_end=date(last_year, 3, 1))
    span = (cfg.baseline_end - cfg.baseline_start).days
    rows = []
    for e in ("a", "b"):
        for _ in range(260):
            day = cfg.baseline_start + timedelta(days=rng.randrange(-40, span + 40))
            rows.append((e, "flow", day, rng.choice([None, 5.0, rng.gauss(1e6, 3)])))
    rows += [("a", "flow", date(2004, 2, 29), 7.0), ("a", "flow", date(2004, 12, 31), 8.0)]
    want = brute_force(rows, cfg)
    got = {(r.entity_id, r.metric, r.day_of_year): r
           for r in seasonal_baselines(readings(rows), cfg).collect()}
    assert len(got) == 2 * 366
    for key, r in got.items():
        values, years = want.get(key, ([], set()))
        if not values:
            assert (r.mu, r.sigma, r.n_years) == (None, None, None)
            continue
        assert math.isclose(r.mu, statistics.fmean(values), rel_tol=1e-12)
        assert r.n_years == len(years)
        if len(values) < 2 or len(set(values)) == 1:
            assert r.sigma is None
        else:
            assert math.isclose(r.sigma, statistics.stdev(values), rel_tol=1e-9)


def test_window_wraps_around_the_year(readings):
    got = {r.day_of_year: r for r in seasonal_baselines(
        readings([("a", "m", "2005-12-31", 1.0), ("a", "m", "2005-01-03", 3.0)])).collect()}
    # 31 December is day 365 of 2005 and reaches day 366 and days 1..6
    assert got[366].mu == 2.0 and got[6].mu == 2.0
    assert got[7].mu == 3.0 and got[8].mu == 3.0
    assert got[358].mu == 1.0 and got[357].mu is None
    assert sum(r.mu is not None for r in got.values()) == 19


def test_small_spread_on_large_seasonal_swing(readings):
    rows = []
    for year in (2005, 2006, 2007):
        rows += [("a", "m", f"{year}-01-10", 1e9 + year % 2), ("a", "m", f"{year}-07-10", 1.0 + year % 2)]
    got = {r.day_of_year: r.sigma for r in seasonal_baselines(readings(rows)).collect()}
    for doy in (10, 191):
        assert math.isclose(got[doy], statistics.stdev([1, 0, 1]), rel_tol=1e-9)


def test_no_spread_is_null(readings):
    rows = [("a", "m", f"{y}-05-01", 0.1) for y in range(2004, 2024)]
    got = {r.day_of_year: r for r in seasonal_baselines(readings(rows)).collect()}
    assert got[121].n_years == 20 and got[121].sigma is None
