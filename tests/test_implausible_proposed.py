"""The rules of excursions and stuck runs look at what the filter's innovations propose, and lose nothing by it."""

import numpy as np
import pandas as pd
from test_implausible import walk

from tidemark.operators import implausible as I


def cases(v):
    rows = pd.DataFrame({"source": "a", "day": np.arange(len(v)), "level": v})
    return set(I._level_cases(rows, 0.0, 125.0)["day"])


def spiked_and_stuck():
    v = walk(200)
    v[50] += 1.0
    v[120:132] = v[120]
    return v


def test_no_innovation_no_excursion(monkeypatch):
    assert cases(spiked_and_stuck()) == {50, *range(120, 132)}
    monkeypatch.setattr(I, "innovations", lambda y, scale: np.zeros(y.shape))
    assert cases(spiked_and_stuck()) == set(range(120, 132))


def test_no_vanished_innovation_no_stuck_run(monkeypatch):
    monkeypatch.setattr(I, "innovations", lambda y, scale: np.full(y.shape, np.inf))
    assert cases(spiked_and_stuck()) == {50}


def test_only_days_about_large_innovations_are_looked_at(monkeypatch):
    seen, whole = [], I.excursions
    monkeypatch.setattr(I, "excursions", lambda v, impossible, about: seen.append(about) or whole(v, impossible, about))
    v = np.tile([5.0, 5.01], 100)
    v[60:] += 1.0  # an ordinary change by which the limit can stay
    v[100] += 3.0
    assert cases(v) == {100}
    assert [a.tolist() for a in seen] == [[60, 61, 62, 63, 100]]  # withheld for three days, then the new level is accepted


def test_the_limit_falls_where_no_large_ordinary_change_is_proposed():
    v = 50 + np.cumsum(np.random.default_rng(0).choice([-1.0, 1.0], 200))
    v[90] += 4.5
    assert cases(v) == {90}


def test_proposals_lose_no_case(monkeypatch):
    rng = np.random.default_rng(3)
    drawn = []
    for _ in range(400):
        n = int(rng.integers(1, 120))
        v = [50 + np.cumsum(rng.choice([-1.0, 1.0], n)), rng.integers(0, 4, n) * 1.0, 50 + np.cumsum(rng.normal(0, 0.02, n)), np.where(np.arange(n) % 2, 10.0, 0.1)][rng.integers(4)]
        for _ in range(rng.integers(5)):
            k = int(rng.integers(n))
            v[k : k + rng.integers(1, 5)] += rng.normal() * 10 ** rng.uniform(-2, 1.5)
            k = int(rng.integers(n))
            v[k : k + rng.integers(1, 14)] = v[k]
            v[rng.integers(n)] = rng.choice([np.nan, np.inf, -1.0, 130.0, 1.0])
        drawn.append(v)
    found = [cases(v) for v in drawn]
    # all days proposed to the rule of excursions, all to that of stuck runs
    monkeypatch.setattr(I, "innovations", lambda y, scale: np.full(y.shape, np.inf))
    spikes = [cases(v) for v in drawn]
    monkeypatch.setattr(I, "innovations", lambda y, scale: np.zeros(y.shape))
    runs = [cases(v) for v in drawn]
    assert found == [a | b for a, b in zip(spikes, runs)]
    assert sum(map(len, found)) > 1000
