"""Named common table expressions for the check SQL, resolved with their dependencies."""

from __future__ import annotations

import re

from varve.functions import special as sp
from varve.plans.base import DRAW_PARAMS, READ_LOW, READ_WIDTH, SEED, SHIP_LOW, SHIP_WIDTH

RECURSIVE: set[str] = set()
CTES: dict[str, str] = {}


def hex_chunk(h: str, i: int) -> str:
    return f"('0x' || substr({h}, {8 * i + 1}, 8))::BIGINT"


def digest_mod(h: str, m: str | int) -> str:
    acc = "0::BIGINT"
    for i in range(8):
        acc = f"(({acc} * 4294967296 + {hex_chunk(h, i)}) % ({m}))"
    return acc


def digest(*parts: str) -> str:
    return "sha256(" + " || '|' || ".join(parts) + ")"


def hash_mod(tag: str, ident: str, m: str | int, seed: str = SEED) -> str:
    return digest_mod(digest(f"'{seed}'", tag, f"CAST({ident} AS VARCHAR)"), m)


def _poly(coefs: tuple[float, ...], x: str) -> str:
    out = f"{coefs[0]!r}::DOUBLE"
    for c in coefs[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def phi(v: str) -> str:
    """Normal CDF of an expression (keep ``v`` a column name: it is repeated)."""
    x = f"(-({v}) / {sp.SQRT2!r}::DOUBLE)"
    y = f"abs{x}"
    y2 = f"({y} * {y})"
    inv = f"(1.0::DOUBLE / {y2})"
    small = f"1.0::DOUBLE - {x} * {_poly(sp.ERFC_SMALL_NUM, y2)} / {_poly(sp.ERFC_SMALL_DEN, y2)}"
    mid = f"exp(-{y2}) * {_poly(sp.ERFC_MID_NUM, y)} / {_poly(sp.ERFC_MID_DEN, y)}"
    far = f"exp(-{y2}) / {y} * ({sp.INV_SQRT_PI!r}::DOUBLE - {inv} * {_poly(sp.ERFC_FAR_NUM, inv)} / {_poly(sp.ERFC_FAR_DEN, inv)})"
    tail = f"(CASE WHEN {y} <= 4.0 THEN {mid} ELSE {far} END)"
    return f"(0.5::DOUBLE * (CASE WHEN {y} <= 0.46875 THEN {small} WHEN {x} < 0 THEN 2.0::DOUBLE - {tail} ELSE {tail} END))"


def pdf(v: str) -> str:
    return f"exp(-0.5::DOUBLE * {v} * {v} - {sp.HALF_LOG_2PI!r}::DOUBLE)"


def cte(name: str, sql: str, recursive: bool = False) -> None:
    CTES[name] = sql
    if recursive:
        RECURSIVE.add(name)


def build(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with every CTE it (transitively) names."""
    known = CTES | (extra or {})
    order: list[str] = []

    def need(text: str, stack: tuple[str, ...]) -> None:
        for name in known:
            if name in order or name in stack:
                continue
            if re.search(rf"\b{name}\b", text):
                need(known[name], (*stack, name))
                order.append(name)

    need(body, ())
    if not order:
        return body
    word = "WITH RECURSIVE " if any(n in RECURSIVE for n in order) else "WITH "
    return word + ",\n".join(f"{n} AS ({known[n]})" for n in order) + "\n" + body


cte(
    "s_traj",
    "SELECT l_suppkey AS entity_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS cycle, "
    "l_quantity AS c1, l_extendedprice AS c2, l_extendedprice * (1.0::DOUBLE - l_discount) AS c3, l_extendedprice * (1.0::DOUBLE - l_discount) * (1.0::DOUBLE + l_tax) AS c4, l_discount AS discount, l_tax AS tax FROM lineitem",
)
cte(
    "u_traj",
    "SELECT user_id AS entity_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cycle, "
    "value AS c1, CAST(length(event_type) AS DOUBLE) AS c2 FROM events",
)
for _p, _low, _width in (("s", SHIP_LOW, SHIP_WIDTH), ("u", READ_LOW, READ_WIDTH)):
    cte(f"{_p}_life", f"SELECT entity_id, count(*) AS lifetime FROM {_p}_traj GROUP BY 1")
    cte(
        f"{_p}_hash",
        f"SELECT entity_id, lifetime, row_number() OVER (ORDER BY {digest(repr(SEED), chr(39) + 'split' + chr(39), 'CAST(entity_id AS VARCHAR)')}, entity_id) AS split_rank, "
        f"count(*) OVER () AS n_all, {_low} + {hash_mod(chr(39) + 'cutoff' + chr(39), 'entity_id', _width)} AS cutoff FROM {_p}_life",
    )
    cte(
        f"{_p}_ent",
        f"SELECT entity_id, CASE WHEN split_rank <= floor(n_all * 55 / 100) THEN 'fit' WHEN split_rank <= floor(n_all * 70 / 100) THEN 'tune' ELSE 'calibration' END AS role, "
        f"split_rank, cutoff, lifetime, cutoff < lifetime AS eligible FROM {_p}_hash",
    )
    cte(f"{_p}_prefix", f"SELECT t.*, e.role, e.cutoff, e.lifetime FROM {_p}_traj t JOIN {_p}_ent e USING (entity_id) WHERE e.eligible AND t.cycle <= e.cutoff")

cte(
    "fc_wide",
    "SELECT t.entity_id, e.role, e.cutoff, "
    "quantile_cont(CASE WHEN cycle <= cutoff THEN c2 END, [0.05, 0.5, 0.95]) AS full_q, "
    "quantile_cont(CASE WHEN cycle <= cutoff AND cycle > cutoff - 30 THEN c2 END, [0.05, 0.5, 0.95]) AS last_q, "
    "max(CASE WHEN cycle = cutoff + 1 THEN c2 END) AS y "
    "FROM s_traj t JOIN s_ent e USING (entity_id) WHERE e.eligible AND t.cycle <= e.cutoff + 1 GROUP BY 1, 2, 3",
)
cte(
    "fc",
    "SELECT 'full' AS method, entity_id, role, cutoff, full_q[1] AS lower, full_q[2] AS median, full_q[3] AS upper, y FROM fc_wide "
    "UNION ALL SELECT 'last30', entity_id, role, cutoff, last_q[1], last_q[2], last_q[3], y FROM fc_wide",
)
cte(
    "mix",
    "SELECT entity_id, ((cycle - 1) % 3)::INT AS fit, (((cycle - 1) // 3) % 2)::INT AS chain, (cycle - 1) // 6 AS draw, "
    "ln(c2) AS mu, discount + 0.01::DOUBLE AS var, -tax AS log_w FROM s_traj",
)
_draw_cols = ", ".join(
    f"{c!r}::DOUBLE + {h!r}::DOUBLE * ({hex_chunk(f'h{i // 8}', i % 8)}::DOUBLE / 2147483648.0::DOUBLE - 1) AS {n}"
    for i, (n, (c, h)) in enumerate(DRAW_PARAMS.items())
)
cte(
    "draws0",
    "SELECT c_nationkey AS fit, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS r, c_acctbal, "
    f"sha256('{SEED}|draw0|' || c_custkey) AS h0, sha256('{SEED}|draw1|' || c_custkey) AS h1 FROM customer",
)
cte(
    "draws",
    f"SELECT fit, (r % 4)::INT AS chain, r // 4 AS draw, {_draw_cols}, c_acctbal AS energy, c_acctbal < -950 AS diverging, "
    f"6 + {hex_chunk('h1', 7)} % 7 AS depth FROM draws0",
)

# features and the first principal component (power iteration stands in for the eigensolver)
_CH = ("c1", "c2", "c3", "c4")
cte("fit_rows", "SELECT p.*, 1.0::DOUBLE / (n.n * p.cutoff) AS w FROM s_prefix p, (SELECT count(*) AS n FROM s_ent WHERE eligible AND role = 'fit') n WHERE p.role = 'fit'")
cte("mom1", "SELECT " + ", ".join(f"sum(w * {c}) AS m_{c}" for c in _CH) + ", sum(w) AS weight_sum FROM fit_rows")
cte(
    "mom2",
    "SELECT " + ", ".join(f"sum(w * ({a} - m_{a}) * ({b} - m_{b})) AS cov_{a}_{b}" for i, a in enumerate(_CH) for b in _CH[i:]) + " FROM fit_rows, mom1",
)
cte("corr4", " UNION ALL ".join(
    f"SELECT {i + 1} AS i, {j + 1} AS j, cov_{_CH[min(i, j)]}_{_CH[max(i, j)]} / sqrt(cov_{_CH[i]}_{_CH[i]} * cov_{_CH[j]}_{_CH[j]}) AS v FROM mom2"
    for i in range(4) for j in range(4)))
cte(
    "power",
    "SELECT 0 AS step, i, (1.0 + i * 0.1)::DOUBLE AS x FROM (VALUES (1), (2), (3), (4)) t(i) UNION ALL "
    "SELECT step, i, y / sqrt(sum(y * y) OVER ()) FROM (SELECT p.step + 1 AS step, c.i, sum(c.v * p.x) AS y FROM power p JOIN corr4 c ON c.j = p.i WHERE p.step < 400 GROUP BY 1, 2) g",
    recursive=True,
)
cte("pc_raw", "SELECT i, x FROM power WHERE step = 400")
cte("pc", "SELECT i, x * (SELECT CASE WHEN x < 0 THEN -1 ELSE 1 END FROM pc_raw ORDER BY abs(x) DESC LIMIT 1) AS x FROM pc_raw")
cte("pc_eig", "SELECT sum(a.x * c.v * b.x) AS eig FROM pc a JOIN corr4 c ON c.i = a.i JOIN pc b ON b.i = c.j")
cte(
    "pre",
    "SELECT m1.*, " + ", ".join(f"sqrt(cov_{c}_{c}) AS sd_{c}" for c in _CH) + ", "
    + ", ".join(f"(SELECT x FROM pc WHERE i = {i + 1}) AS pc_{c}" for i, c in enumerate(_CH))
    + ", sqrt((SELECT eig FROM pc_eig)) AS pc_scale, (SELECT eig FROM pc_eig) / 4 AS explained FROM mom1 m1, mom2",
)
cte(
    "scored",
    "SELECT entity_id, cycle, role, cutoff, lifetime, (" + " + ".join(f"(c.{c} - m_{c}) / sd_{c} * pc_{c}" for c in _CH) + ") / pc_scale AS z "
    "FROM s_prefix c, pre WHERE cycle > cutoff - 30",
)
cte(
    "summ",
    "SELECT entity_id, role, cutoff, lifetime, count(*) AS w, ln(cutoff / 100.0::DOUBLE) AS log_age, max_by(z, cycle) AS endpoint, "
    "regr_intercept(z, (cycle - cutoff) / 30.0::DOUBLE) AS level, regr_slope(z, (cycle - cutoff) / 30.0::DOUBLE) AS slope, "
    "sqrt((regr_syy(z, (cycle - cutoff) / 30.0::DOUBLE) - regr_slope(z, (cycle - cutoff) / 30.0::DOUBLE) ** 2 * regr_sxx(z, (cycle - cutoff) / 30.0::DOUBLE)) / (count(*) - 2)) AS resid_sd "
    "FROM scored GROUP BY 1, 2, 3, 4",
)


def precision_ctes(name: str, keys: str, series: str, quant: str) -> None:
    """Batch-means precision of the quantiles of one key set, as SQL."""
    k = keys.replace(" ", "").split(",")
    u = ", ".join(k)
    cte(f"{name}_c", f"SELECT {u}, min(c) AS n FROM (SELECT {u}, chain, count(*) / 3 AS c FROM {series} GROUP BY {u}, chain) GROUP BY {u}")
    cte(f"{name}_z", f"SELECT *, least(greatest(greatest(1, floor(n ** (1.0 / 3.0))) + 1, floor(sqrt(n))), floor(n / 2))::BIGINT AS b2, greatest(1, floor(n ** (1.0 / 3.0)))::BIGINT AS b1 FROM {name}_c WHERE n >= 4")
    cte(f"{name}_bs", f"SELECT {u}, unnest([least(b1, b2 - 1), b2]) AS batch_size FROM {name}_z")
    cte(f"{name}_m", f"SELECT {u}, p, batch_size, chain, draw // batch_size AS g, avg(h) AS m, count(*) AS n FROM {series} JOIN {name}_bs USING ({u}) GROUP BY {u}, p, batch_size, chain, g")
    cte(f"{name}_l", f"SELECT {u}, p, batch_size, chain, sum(n)::BIGINT AS n_chain, count(*) FILTER (WHERE n = batch_size) AS nb, batch_size * var_samp(m) FILTER (WHERE n = batch_size) AS lrv FROM {name}_m GROUP BY {u}, p, batch_size, chain")
    cte(f"{name}_v", f"SELECT {u}, p, batch_size, var_h FROM (SELECT {u}, p, var_samp(h) AS var_h FROM {series} GROUP BY {u}, p) JOIN {name}_bs USING ({u})")
    cte(f"{name}_p", f"SELECT {u}, p, batch_size, n_chain, nb, n_chain * lrv / (n_total ** 2 * mean_w ** 2 * density ** 2) AS part FROM {name}_l JOIN {quant} USING ({u}, p)")
    cte(f"{name}_a", f"SELECT {u}, p, batch_size, count(*) AS chains, sum(part) AS variance, sum(part) ** 2 / nullif(sum(CASE WHEN part > 0 THEN part ** 2 / (nb - 1) END), 0) AS dof FROM {name}_p GROUP BY {u}, p, batch_size")
    cte(f"{name}_rec", f"SELECT {u}, p, batch_size, chains, variance, dof, q.quantile, q.quantile * sqrt(variance) AS mcse, var_h / nullif(variance * (q.density * q.mean_w) ** 2, 0) AS influence_ess, q.weight_ess, q.cdf - p AS residual FROM {name}_a JOIN {quant} q USING ({u}, p) JOIN {name}_v USING ({u}, p, batch_size)")


def upper_ctes(name: str, keys: str, tail: float = 0.025) -> None:
    """Upper MCSE from a chi-square quantile: bisect half of it in the series of the incomplete gamma function."""
    u = ", ".join(keys.replace(" ", "").split(","))
    gamma = "list_sum(list_transform(range(0, 400), lambda n: exp((a + n) * ln((lo + hi) / 2) - (lo + hi) / 2 - lgamma(a + n + 1))))"
    cte(
        f"{name}_chi",
        f"SELECT {u}, p, batch_size, dof / 2 AS a, 0::DOUBLE AS lo, dof / 2 AS hi, 0 AS i FROM {name}_rec WHERE dof IS NOT NULL UNION ALL "
        f"SELECT {u}, p, batch_size, a, CASE WHEN below THEN (lo + hi) / 2 ELSE lo END, CASE WHEN below THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM (SELECT *, {gamma} < {tail!r} AS below FROM {name}_chi WHERE i < 50)",
        recursive=True,
    )
    cte(f"{name}_up", f"SELECT r.*, r.mcse * sqrt(c.a / c.hi) AS upper_mcse FROM {name}_rec r LEFT JOIN {name}_chi c ON {' AND '.join(f'r.{k} = c.{k}' for k in u.split(', '))} AND r.p = c.p AND r.batch_size = c.batch_size AND c.i = 50")
