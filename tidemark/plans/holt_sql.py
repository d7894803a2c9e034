"""Check SQL of the Holt fits: every point of every grid, replayed month by month in lists."""

from __future__ import annotations

from tidemark.operators.holt import ALPHAS, LEAST_ALPHA, SHARES, STEPS

_RUN = ["l0", "b0", "l1", "b1", "l2", "b2", "s0", "s1", "s2", "q00", "q01", "q02", "q11", "q12", "q22"]


def _doubles(values) -> str:
    return "[" + ", ".join(f"'{v!r}'::DOUBLE" for v in values) + "]"


def _replay() -> str:
    """The three runs of a series with weights ``alpha`` and ``share``."""
    start = {"l0": "ys[1]", "l1": "1", "b2": "1"}
    moved = {}
    for k, value in enumerate(("x.v - ", "-", "-")):
        moved[f"e{k}"] = f"({value}(a.l{k} + a.b{k}))"
        moved[f"l{k}"] = f"((a.l{k} + a.b{k}) + alpha * {moved[f'e{k}']})"
        moved[f"b{k}"] = f"(a.b{k} + share * (({moved[f'l{k}']} - a.l{k}) - a.b{k}))"
        moved[f"s{k}"] = f"(a.s{k} + {moved[f'e{k}']})"
    for j in range(3):
        for k in range(j, 3):
            moved[f"q{j}{k}"] = f"(a.q{j}{k} + {moved[f'e{j}']} * {moved[f'e{k}']})"
    first = ", ".join(f"{name}: ({start.get(name, '0')})::DOUBLE" for name in _RUN)
    empty = ", ".join(f"{name}: 0::DOUBLE" for name in _RUN)
    step = ", ".join(f"{name}: {moved[name]}" for name in _RUN)
    months = f"list_transform(ys, lambda y: {{v: y, {empty}}})"
    return f"list_reduce({months}, lambda a, x: {{v: x.v, {step}}}, {{v: 0::DOUBLE, {first}}})"


def holt_ctes(keys: list[str], least: int = 4) -> dict[str, str]:
    """CTEs from ``dense`` (keys, month, y) to ``fits``: one row per series of at least ``least`` months."""
    key = ", ".join(keys)
    ctes = {
        "ser": f"""SELECT {key}, list(y ORDER BY month) AS ys, COUNT(*) AS months, MAX(month) AS last_month,
          arg_max(y, month) AS last_value FROM dense GROUP BY {key}""",
        "p0": f"""SELECT {key}, ys, alpha, share FROM ser, (SELECT unnest({_doubles(ALPHAS)}) AS alpha),
          (SELECT unnest({_doubles(SHARES)}) AS share) WHERE months >= {least}""",
    }
    for k, step in enumerate([*STEPS, None]):
        ctes[f"r{k}"] = f"SELECT {key}, alpha, share, len(ys) AS n, unnest({_replay()}) FROM p{k}"
        ctes[f"d{k}"] = f"""SELECT *, CASE WHEN sure THEN (q02 * q12 - q01 * q22) / det ELSE 0 END AS more,
          CASE WHEN sure THEN (q01 * q12 - q02 * q11) / det ELSE 0 END AS slope
          FROM (SELECT *, abs(det) > 1e-12 * greatest(q11 * q22, 1e-300) AS sure FROM (SELECT *, q11 * q22 - q12 * q12 AS det FROM r{k}))"""
        ctes[f"b{k}"] = f"""SELECT {key}, alpha, share, l0 + more * l1 + slope * l2 AS level, b0 + more * b1 + slope * b2 AS trend, sse,
            sqrt(greatest(sse / n - mean * mean, 0)) AS sigma
          FROM (SELECT *, greatest(q00 + more * more * q11 + slope * slope * q22 + 2.0::DOUBLE * (more * q01 + slope * q02 + more * slope * q12), 0) AS sse,
            (s0 + more * s1 + slope * s2) / n AS mean FROM d{k})
          QUALIFY ROW_NUMBER() OVER (PARTITION BY {key} ORDER BY sse, alpha, share) = 1"""
        if step:
            near = _doubles([j * step for j in range(-2, 3)])
            ctes[f"p{k + 1}"] = f"""SELECT {key}, ys, least(greatest(alpha + da, {LEAST_ALPHA!r}::DOUBLE), 1::DOUBLE) AS alpha,
              least(greatest(share + ds, 0::DOUBLE), 1::DOUBLE) AS share
              FROM b{k} JOIN ser USING ({key}), (SELECT unnest({near}) AS da), (SELECT unnest({near}) AS ds)"""
    ctes["fits"] = f"""SELECT {key}, last_month, last_value, months, alpha, alpha * share AS beta, level, trend, sse, sigma
      FROM b{len(STEPS)} JOIN ser USING ({key})"""
    return ctes


def holt_ahead(keys: list[str], periods: int) -> str:
    """The forecast rows of ``fits``."""
    return f"""SELECT {", ".join(keys)}, CAST(step AS INTEGER) AS step, CAST(last_month + to_months(CAST(step AS INTEGER)) AS TIMESTAMP) AS ds,
      level + trend * step AS yhat, level + trend * step - 1.96::DOUBLE * sigma AS yhat_lower, level + trend * step + 1.96::DOUBLE * sigma AS yhat_upper
      FROM fits, generate_series(1, {periods}) t(step)"""
