"""Terms of several entities against all draws of a fit, their mixture quantiles and influences, as matrices.

``mixture.TERM_STEPS`` restated: with G the inner products of (1, s), S the covariance of the effects and
e = G^-1 (i_z1, i_zs) - (m0, m1), the quadratic form of log_w is RSS + e' (G^-1 + S / sz2)^-1 e, where RSS is
what is left of i_zz after (1, s); both are squares of forms that are linear in an entity's sums. So coefficients by
draw are worked out once for all entities with the same window, and tiles are products of small matrices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from varve.functions import special as sp

# Terms of a tile, terms worked on at a time (they fit a cache), draws a search starts from at least, and at most one in so many.
TILE_TERMS, PIECE, THIN_LEAST, THIN = 1 << 20, 1 << 14, 1 << 13, 16
WINDOW = ["w", *[f"p{pair}_{part}" for pair in ("11", "1s", "ss") for part in ("first", "tail", "cross", "head")]]

# The normal CDF at nodes; a sum with the magic number ends in the number of the nearest node.
_PER_UNIT, _EDGE, _MAGIC = 4096, 9, 1.5 * 2.0**52
_BITS = int(np.array(_MAGIC).view(np.int64)) - _EDGE * _PER_UNIT
_CDF: list[np.ndarray] = []
_ROOT = 1 / np.sqrt(2 * np.pi)


def _sums(e: dict, pair: str) -> list:
    """first + (tail - rho cross + rho^2 head) A with A = 1 / (1 - rho^2) as a product with (1, A, rho A): rho^2 A = A - 1."""
    return [e[f"p{pair}_first"] - e[f"p{pair}_head"], e[f"p{pair}_tail"] + e[f"p{pair}_head"], -e[f"p{pair}_cross"]]


class Coefficients:
    """Of one window, by draw: ``linear`` forms (mu, two squares to add to log_w and two to take away) of the features
    (z1 sums, zs sums, 1, log_age), ``base`` of (zz sums, 1) for the rest of log_w, and the variance."""

    def __init__(self, window: dict[str, float], d: dict[str, np.ndarray]):
        n, zero, one = len(d["rho"]), np.zeros(len(d["rho"])), np.ones(len(d["rho"]))
        rest = 1 - d["rho"] * d["rho"]
        whiten = np.array([one, 1 / rest, d["rho"] / rest])
        g11, g1s, gss = (np.array(_sums(window, p)) @ whiten for p in ("11", "1s", "ss"))
        s00, s11, s01, sz2 = d["tau0"] ** 2, d["tau1"] ** 2, d["tau0"] * d["tau1"] * d["r_g"], d["sigma_z"] ** 2
        det_s, det_g = s00 * s11 - s01 * s01, g11 * gss - g1s * g1s
        a00, a11, a01 = s11 / det_s + g11 / sz2, s00 / det_s + gss / sz2, g1s / sz2 - s01 / det_s
        det_a = a00 * a11 - a01 * a01
        iz1, izs = np.zeros((2, 8, n))
        iz1[:3], izs[3:6] = whiten, whiten
        m0, m1 = np.zeros((2, 8, n))
        m0[6:], m1[6:] = (d["g00"], d["g01"]), (d["g10"], d["g11"])
        e0, e1 = (gss * iz1 - g1s * izs) / det_g - m0, (g11 * izs - g1s * iz1) / det_g - m1
        u1, us = iz1 - g11 * m0 - g1s * m1, izs - g1s * m0 - gss * m1
        d0, d1 = (a11 * u1 - a01 * us) / (det_a * sz2), (a00 * us - a01 * u1) / (det_a * sz2)
        mu = d["gamma0"] * (m0 + d0) + d["gamma1"] * (m1 + d1)
        mu[6] += d["beta0"]
        mu[7] += d["beta1"]
        # K = G^-1 + S / sz2 and e' K^-1 e as two squares; so with t' G t of t = G^-1 (i_z1, i_zs), which RSS leaves out
        k00, k11, k01 = gss / det_g + s00 / sz2, g11 / det_g + s11 / sz2, s01 / sz2 - g1s / det_g
        half = np.sqrt(0.5 / sz2)
        less = [half * e0 / np.sqrt(k00), half * (e1 - k01 / k00 * e0) / np.sqrt(k11 - k01 * k01 / k00)]
        more = [half * iz1 / np.sqrt(g11), half * (izs - g1s / g11 * iz1) / np.sqrt(gss - g1s * g1s / g11)]
        self.linear = np.array([mu, *more, *less])
        w = window["w"]
        self.base = np.array([*(-0.5 / sz2 * whiten), -0.5 * (w * np.log(2 * np.pi) + w * np.log(sz2) + (w - 1) * np.log(rest) + np.log(det_s) + np.log(det_a))])
        self.var = d["sigma_r"] ** 2 + (d["gamma0"] ** 2 * a11 - 2 * d["gamma0"] * d["gamma1"] * a01 + d["gamma1"] ** 2 * a00) / det_a
        self.usable = bool(np.isfinite(self.linear).all() and np.isfinite(self.base).all())

    def terms(self, e: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(mu, log_w) with a row per entity."""
        one = np.ones(len(e["log_age"]))
        feature = np.array([*_sums(e, "z1"), *_sums(e, "zs"), one, e["log_age"]]).T
        square = np.array([*_sums(e, "zz"), one]).T
        n = self.base.shape[1]
        mu, log_w = np.empty((2, len(one), n))
        step = max(1, PIECE // len(one))
        for at in range(0, n, step):
            span = slice(at, at + step)
            np.matmul(feature, self.linear[0, :, span], out=mu[:, span])
            out = square @ self.base[:, span]
            form = feature @ self.linear[1, :, span]
            for k in (1, 2, 3, 4):
                if k > 1:
                    np.matmul(feature, self.linear[k, :, span], out=form)
                form *= form
                (np.add if k < 3 else np.subtract)(out, form, out=out)
            log_w[:, span] = out
        return mu, log_w


class _Pieces:
    """CDF and density of the standard normal, piece by piece in the same memory.

    At node + d, with phi = density at v = node + d: Phi(v) = Phi(node) + phi d (1 + v d / 2 + ...); what is left out is below 1e-13.
    """

    def __init__(self):
        if not _CDF:
            from varve.operators.keywise import normal

            _CDF.append(normal(np.arange(-_EDGE * _PER_UNIT, _EDGE * _PER_UNIT + 1) / _PER_UNIT)[0])
        self.a, self.e, self.r, self.c, self.t = np.empty((5, PIECE))
        self.node = np.empty(PIECE, np.int64)

    def at(self, x: float, mu: np.ndarray, scaled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, CDF, exp(-v^2 / 2)) with a = ``_PER_UNIT`` v and v = (x - mu) / sd; ``scaled`` is ``_PER_UNIT`` / sd."""
        k = len(mu)
        a, e, r, c, node = self.a[:k], self.e[:k], self.r[:k], self.c[:k], self.node[:k]
        np.subtract(x, mu, out=a)
        a *= scaled
        np.multiply(a, a, out=e)
        e *= -0.5 / _PER_UNIT**2
        np.exp(e, out=e)
        np.add(a, _MAGIC, out=r)
        np.subtract(r.view(np.int64), _BITS, out=node)
        r -= _MAGIC
        np.subtract(a, r, out=r)
        np.take(_CDF[0], node, out=c, mode="clip")
        t = self.t[:k]
        np.multiply(a, r, out=t)
        t *= 0.5 * _ROOT / _PER_UNIT**3
        t += _ROOT / _PER_UNIT
        t *= r
        t *= e
        c += t
        return a, c, e


class Spread:
    """What the terms of a window share: standard deviations of the parts of a component, and the draws a search starts from."""

    def __init__(self, var: np.ndarray, wide: np.ndarray | None = None):
        n = len(var)
        self.n, self.pieces = n, _Pieces()
        self.thin = slice(None, None, max(1, min(THIN, n // THIN_LEAST)))
        sds = [(1.0, np.sqrt(var))] if wide is None else [(0.95, np.sqrt(var)), (0.05, np.sqrt(wide))]
        self.parts = [(share, _PER_UNIT / sd, 1 / sd) for share, sd in sds]
        self.thinned = [tuple(a if k == 0 else np.ascontiguousarray(a[self.thin]) for k, a in enumerate(part)) for part in self.parts]
        self.least, self.var, self.wide = float(sds[0][1].min()), var, wide


class Row:
    """Terms of one entity, with what ``keywise.Terms`` tells of a single key; its quantiles are searched from a part
    of the draws, and only the last steps, to the same residual, read all of them."""

    starts = np.zeros(1, np.int64)

    def __init__(self, spread: Spread, mu: np.ndarray, log_w: np.ndarray):
        self.spread, self.mu, self.log_w = spread, mu, log_w
        self.w = np.exp(log_w - log_w.max())
        self.n = np.array([len(mu)])
        self.sum_w = self.w.sum()
        self.mean_w = np.array([self.sum_w / len(mu)])
        self.weight_ess = np.minimum(self.sum_w**2 / np.array([self.w @ self.w]), self.n)
        self.max_weight = np.array([self.w.max() / self.sum_w])
        self._thin: tuple | None = None

    def _sums(self, x: float, mu: np.ndarray, w: np.ndarray, parts: list, total: float) -> np.ndarray:
        """CDF, density and its first three derivatives at ``x``."""
        out = np.zeros(5)
        for share, scaled, inverse in parts:
            got = np.zeros(5)
            for at in range(0, len(mu), PIECE):
                s = slice(at, at + PIECE)
                a, c, t = self.spread.pieces.at(x, mu[s], scaled[s])
                got[0] += c @ w[s]
                i, square = inverse[s], c
                t *= w[s]
                t *= i
                a *= i
                np.multiply(i, i, out=square)
                got[1] += t.sum()
                got[3] -= t @ square
                t *= a
                got[2] -= t.sum()
                got[3] += t @ a / _PER_UNIT**2
                got[4] += 3 * (t @ square)
                t *= a
                got[4] -= t @ a / _PER_UNIT**2
            got *= [1, _ROOT, _ROOT / _PER_UNIT, _ROOT, _ROOT / _PER_UNIT]
            out += share / total * got
        return out

    def _start(self, p: float) -> float:
        if self._thin is None:
            mu, w = np.ascontiguousarray(self.mu[self.spread.thin]), np.ascontiguousarray(self.w[self.spread.thin])
            total, sd = w.sum(), 1 / self.spread.thinned[-1][2]
            mean = w @ mu / total
            self._thin = mu, w, total, mean, np.sqrt(max(w @ (mu * mu + sd * sd) / total - mean * mean, 0.0))
        mu, w, total, mean, spread = self._thin
        x = mean + sp.norm_ppf(p) * spread
        for _ in range(8):
            cdf, density, slope, *_ = self._sums(x, mu, w, self.spread.thinned, total)
            newton = (cdf - p) / density
            step = newton / max(1.0 - newton * slope / (2 * density), 0.5)
            x -= step
            if not abs(step) > 1e-3 * spread:
                break
        return x

    def quantile(self, p: float, tolerance: float = 1e-12, rounds: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Root, CDF and density there. A step is the root of the CDF's series, taken if the term left out is within the
        tolerance; what does not settle in a few steps is left to the search that brackets."""
        with np.errstate(all="ignore"):
            x = self._start(p)
            for _ in range(rounds):
                cdf, *d = self._sums(x, self.mu, self.w, self.spread.parts, self.sum_w)
                series = np.array([d[3] / 24, d[2] / 6, d[1] / 2, d[0], cdf - p])
                step = 0.0
                for _ in range(6):
                    step -= np.polyval(series, step) / np.polyval(np.polyder(series), step)
                x += step
                left = np.polyval(series, step)
                # |He_4| phi is at most 1.2, so what the series leaves out is at most 0.01 (step / sd)^5
                if abs(left) + 0.01 * (abs(step) / self.spread.least) ** 5 <= tolerance / 2:
                    return np.array([x]), np.array([p + left]), np.array([np.polyval(np.polyder(series), step)])
                if not np.isfinite(x):
                    break
        return self.bracketed().quantile(p)

    def bracketed(self):
        from varve.operators.keywise import Terms

        return Terms(self.starts, self.mu, self.spread.var, self.log_w, self.spread.wide)

    def influence(self, x: np.ndarray, p: float) -> np.ndarray:
        """w (F(x) - p) by draw."""
        out = np.empty(len(self.mu))
        for at in range(0, len(out), PIECE):
            s = slice(at, at + PIECE)
            piece = out[s]
            for k, (share, scaled, _) in enumerate(self.spread.parts):
                c = self.spread.pieces.at(x[0], self.mu[s], scaled[s])[1]
                np.multiply(c, share, out=piece) if k == 0 else np.add(piece, np.multiply(c, share, out=c), out=piece)
            piece -= p
            piece *= self.w[s]
        return out


class Tile:
    """Some entities of a fit with all its draws: ``mu`` and ``log_w`` have a row per entity."""

    def __init__(self, members: list[dict[str, float]], spread: Spread, mu: np.ndarray, log_w: np.ndarray):
        self.members, self.spread, self.mu, self.log_w = members, spread, mu, log_w

    def rows(self) -> Iterator[tuple[dict[str, float], Row]]:
        for e, mu, log_w in zip(self.members, self.mu, self.log_w, strict=True):
            yield e, Row(self.spread, mu, log_w)

    def ids(self) -> np.ndarray:
        return np.array([e["entity_id"] for e in self.members])


def tiles(columns: dict[str, np.ndarray], draws: dict[str, np.ndarray], one_by_one: Callable[[dict], tuple], wide: bool = False) -> Iterator[Tile]:
    """Tiles of all entities of a fit, those with the same window together. Windows too short for a regression on
    (1, s) have no such form: there ``one_by_one`` works out an entity's (mu, var, log_w)."""
    n = len(draws["rho"])
    beyond = 8 * draws["sigma_r"] ** 2 if wide else None
    spread_of = lambda var: Spread(var, var + beyond if wide else None)
    windows, which = np.unique(np.array([columns[c] for c in WINDOW]).T, axis=0, return_inverse=True)
    for k, window in enumerate(windows):
        members = np.flatnonzero(which.ravel() == k)
        of = lambda at: [{c: v.item() for c, v in zip(columns, row, strict=True)} for row in zip(*(columns[c][at] for c in columns), strict=True)]
        with np.errstate(all="ignore"):
            found = Coefficients(dict(zip(WINDOW, window, strict=True)), draws)
        if not found.usable:
            for e in of(members):
                mu, var, log_w = (np.array(np.broadcast_to(a, n)) for a in one_by_one(e))
                yield Tile([e], spread_of(var), mu[None], log_w[None])
            continue
        spread, step = spread_of(found.var), max(1, TILE_TERMS // n)
        for at in range(0, len(members), step):
            cut = members[at : at + step]
            yield Tile(of(cut), spread, *found.terms({c: v[cut] for c, v in columns.items()}))
