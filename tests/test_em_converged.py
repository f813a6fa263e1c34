"""The registered EM runs to its stop rule."""

import math
from collections import defaultdict

import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from varloom.plans.checks_traits import RG
from varloom.plans.registry import Inputs


def plain_em(rows, tol=1e-4, most=153):
    """(parameters, passes): all passes until nothing changes by more than tol of its value."""
    regions = defaultdict(list)
    for key, grp, z in rows:
        regions[key].append((grp, z))
    now = {g: (0.01, 10.0) for _, g, _ in rows}
    for k in range(1, most + 1):
        n, s, v = defaultdict(int), defaultdict(float), defaultdict(float)
        for members in regions.values():
            w = [now[g][0] * math.exp(-0.5 * math.log(1 + now[g][1]) + 0.5 * z * z * now[g][1] / (1 + now[g][1])) for g, z in members]
            for (g, z), x in zip(members, w):
                pip, sh = x / (1 + sum(w)), now[g][1] / (1 + now[g][1])
                n[g], s[g], v[g] = n[g] + 1, s[g] + pip, v[g] + pip * ((z * sh) ** 2 + sh)
        new = {g: (s[g] / n[g], v[g] / s[g]) for g in now}
        if k > 1 and all(abs(a - b) <= tol * b for g in now for a, b in zip(new[g], now[g])):
            return new, k
        now = new
    return now, most


def test_registered_em_is_converged(spark):
    z = Inputs(spark, SF).region_z.select("grp", "z", *RG).filter("z IS NOT NULL").collect()
    want, passes = plain_em([(tuple(r[c] for c in RG), r["grp"], r["z"]) for r in z])
    assert 4 < passes < 153
    got = {r["grp"]: (r["pi"], r["var"]) for r in entry.queries()["est_group_prior_converged"](spark, SF).collect()}
    assert set(got) == set(want)
    for g, (pi, var) in want.items():
        assert got[g] == pytest.approx((pi, var), abs=2e-6)
