"""Terms of pairs as matrix products and their quantiles, against the steps one by one and the bracketing search."""

import numpy as np
import pytest

from varve.operators import mixture, tiles
from varve.operators.keywise import PairedTerms
from varve.plans import base


def _sums(z, cutoff=70, w=30):
    s = (np.arange(cutoff - w + 1, cutoff + 1) - cutoff) / 30.0
    seq, out = {"z": z[:w], "1": np.ones(w), "s": s}, {"entity_id": 1.0, "w": float(w), "log_age": float(np.log(cutoff / 100))}
    for p in mixture.PAIRS:
        x, y = seq[p[0]], seq[p[1]]
        out |= {f"p{p}_first": x[0] * y[0], f"p{p}_tail": x[1:] @ y[1:], f"p{p}_cross": x[1:] @ y[:-1] + x[:-1] @ y[1:], f"p{p}_head": x[:-1] @ y[:-1]}
    return out


def _case(n, entities, w=30):
    rng = np.random.default_rng(8)
    draws = {k: m + h * rng.uniform(-1, 1, n) for k, (m, h) in base.DRAW_PARAMS.items()}
    members = [_sums(rng.normal(rng.normal(), 1, 30), 40 + 9 * e, w) | {"entity_id": float(e)} for e in range(entities)]
    return draws, {c: np.array([m[c] for m in members]) for c in members[0]}, members


@pytest.mark.parametrize("w", [30, 2, 1])
def test_terms_as_products_equal_the_steps(w, monkeypatch):
    """also for windows too short for a regression, which are worked out one by one."""
    draws, columns, members = _case(3000, 5, w)
    paired = PairedTerms(mixture.TERM_STEPS, draws)
    monkeypatch.setattr(tiles, "TILE_TERMS", 6000)
    found = list(tiles.tiles(columns, draws, paired.of))
    assert [i for t in found for i in t.ids()] == list(range(5)) and (max(len(t.mu) for t in found) == 2) == (w > 1)
    for tile in found:
        for k, e in enumerate(tile.members):
            mu, var, log_w = paired.of(members[int(e["entity_id"])])
            assert np.allclose(tile.mu[k], mu, rtol=0, atol=1e-12) and np.allclose(tile.log_w[k], log_w, rtol=0, atol=1e-11) and np.allclose(tile.spread.var, var, rtol=1e-12)


@pytest.mark.parametrize("wide", [False, True])
def test_quantiles_from_few_passes_equal_the_bracketing_search(wide, monkeypatch):
    """the former search read all draws some five times for a quantile, the influence once more."""
    monkeypatch.setattr(tiles, "THIN_LEAST", 1 << 11)
    draws, columns, _ = _case(40_000, 3)
    read, sums = [0], tiles.Row._sums
    monkeypatch.setattr(tiles.Row, "_sums", lambda self, x, mu, *a: read.__setitem__(0, read[0] + len(mu)) or sums(self, x, mu, *a))
    for tile in tiles.tiles(columns, draws, None, wide):
        for _, row in tile.rows():
            for p in (0.05, 0.5, 0.95):
                q, cdf, density = row.quantile(p)
                slow = row.bracketed()
                want, _, want_density = slow.quantile(p)
                assert q[0] == pytest.approx(want[0], abs=1e-11) and abs(slow.at(q)[1][0] - p) <= 1e-12 and abs(cdf[0] - p) <= 1e-12
                assert density[0] == pytest.approx(want_density[0], rel=1e-8)
                assert np.allclose(row.influence(q, p), slow.influence(q, p), rtol=0, atol=1e-12)
    assert read[0] < 9 * 3 * 40_000


def test_terms_far_apart_are_left_to_the_bracketing_search():
    mu = np.concatenate([np.full(50, 0.0), np.full(50, 900.0)])
    row = tiles.Row(tiles.Spread(np.full(100, 0.01)), mu, np.zeros(100))
    for p in (0.05, 0.5, 0.95):
        q, cdf, _ = row.quantile(p)
        assert abs(cdf[0] - p) <= 1e-12 and abs(row.bracketed().at(q)[1][0] - p) <= 1e-12
