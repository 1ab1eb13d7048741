"""SQL for coefficient tables: the sums of products of scaled columns, inverted one column after the other.

The library solves on the driver with numpy; here each pivot is one more step of a query, standard errors are sums over
rows of how far a row moves a coefficient, and p values come from the finite series for whole degrees of freedom.
"""

from __future__ import annotations

from collections.abc import Sequence

from tallyscribe.plans.registry import s6

#: A column without this share of its own sum of squares gets no coefficient.
OWN = 1e-10


def _invert(k: int) -> list[str]:
    """One step per column: its row and column of the matrix are swept; a column that depends on earlier ones stays."""
    steps = []
    for p in range(k):
        cells = [f"a{p}_{p} > {OWN} * n AS u{p}", "n"] + [f"u{i}" for i in range(p)]
        for i in range(k + 1):
            for j in range(k + 1):
                if i == p:
                    swept = f"1 / a{p}_{p}" if j == p else f"a{p}_{j} / a{p}_{p}"
                else:
                    swept = f"-a{i}_{p} / a{p}_{p}" if j == p else f"a{i}_{j} - a{i}_{p} * a{p}_{j} / a{p}_{p}"
                cells.append(f"CASE WHEN a{p}_{p} > {OWN} * n THEN {swept} ELSE a{i}_{j} END AS a{i}_{j}")
        steps.append(f"m{p + 1} AS MATERIALIZED (SELECT {', '.join(cells)} FROM m{p})")
    return steps


def _p_value() -> str:
    """Two-sided p of Student's t for ``df`` whole degrees of freedom, by the angle whose tangent is t / sqrt(df)."""
    angle, c, s = "atan(abs(t) / sqrt(df))", "(1 / sqrt(1 + t * t / df))", "(abs(t) / sqrt(df + t * t))"
    even = f"list_sum(list_transform(range(0, df // 2), lambda k: exp(lgamma(2 * k + 1) - k * ln(4) - 2 * lgamma(k + 1)) * power({c}, 2 * k)))"
    odd = f"coalesce(list_sum(list_transform(range(0, (df - 1) // 2), lambda k: exp(k * ln(4) + 2 * lgamma(k + 1) - lgamma(2 * k + 2)) * power({c}, 2 * k))), 0)"
    return f"CASE WHEN df % 2 = 0 THEN 1 - {s} * {even} ELSE 1 - 2 / pi() * ({angle} + {s} * {c} * {odd}) END"


def coefficients(names: Sequence[str], rows: str, errors: str = "plain", within: bool = False) -> str:
    """Body after ``WITH`` views. ``rows`` selects y, x0, x1 ... and, with ``within``, the group g that is also the cluster.

    ``errors``: "plain", "HC1" or "cluster". The result has the columns of the library's table, rounded.
    """
    k = len(names)
    every = ["y"] + [f"x{i}" for i in range(k)]
    known = " AND ".join(f"{c} IS NOT NULL" for c in every + ["g"] * within)
    means = ", ".join(f"{c} - avg({c}) OVER (PARTITION BY g) AS {c}" for c in every)
    used = f"SELECT g, {means} FROM raw WHERE {known}" if within else f"SELECT *, 0 AS g FROM raw WHERE {known}"
    mean = "0.0" if within else "avg({})"
    figures = [f"{mean.format('y')} AS my"] + [f"{mean.format(f'x{i}')} AS c{i}, coalesce(nullif(stddev_pop(x{i}), 0), 1) AS d{i}" for i in range(k)]
    scaled = [f"(x{i} - c{i}) / d{i} AS z{i}" for i in range(k)] + [f"y - my AS z{k}"]
    products = [f"sum(z{i} * z{j}) AS a{i}_{j}" for i in range(k + 1) for j in range(k + 1)]
    fitted = " + ".join(f"CASE WHEN u{i} THEN a{i}_{k} * z{i} ELSE 0 END" for i in range(k))
    moves = [" + ".join(f"CASE WHEN u{i} AND u{j} THEN a{i}_{j} * z{j} ELSE 0 END" for j in range(k)) + f" AS h{i}" for i in range(k)]
    rank = " + ".join(f"u{i}::INT" for i in range(k))
    factor, weight = {
        "plain": ("sse / df", None),
        "HC1": ("n_rows * 1.0::DOUBLE / df", "e"),
        "cluster": ("n_groups * 1.0::DOUBLE / (n_groups - 1) * (n_rows - 1) / (n_rows - rank)", "e"),
    }[errors]
    terms = [] if within else [("(intercept)", "true", "my - (" + " + ".join(f"CASE WHEN u{i} THEN a{i}_{k} * c{i} / d{i} ELSE 0 END" for i in range(k)) + ")")]
    terms += [(name, f"u{i}", f"a{i}_{k} / d{i}") for i, name in enumerate(names)]
    shift = [] if within else ["1.0::DOUBLE / n_rows - (" + " + ".join(f"h{i} * c{i} / d{i}" for i in range(k)) + ")"]
    by_row = [f"({g}) * {weight or '1.0'} AS q{at}" for at, g in enumerate(shift + [f"h{i} / d{i}" for i in range(k)])]
    squares = ", ".join(f"sum(q{at} * q{at}) AS v{at}" for at in range(len(terms)))
    grouped = f"SELECT {', '.join(f'sum(q{at}) AS q{at}' for at in range(len(terms)))} FROM moved GROUP BY g" if errors == "cluster" else "SELECT * FROM moved"
    long = " UNION ALL ".join(
        f"SELECT '{name}' AS term, {at} AS place, CASE WHEN {there} THEN {estimate} END AS estimate, "
        f"CASE WHEN {there} AND df > 0 THEN sqrt(greatest({factor} * v{at}, 0)) END AS std_error, n_rows AS n, df, r2 FROM m{k}, s, fit, spread"
        for at, (name, there, estimate) in enumerate(terms)
    )
    parts = [
        f"raw AS MATERIALIZED ({rows})",
        f"used AS MATERIALIZED ({used})",
        f"s AS MATERIALIZED (SELECT count(*) AS n_rows, count(DISTINCT g) AS n_groups, {', '.join(figures)} FROM used)",
        f"z AS MATERIALIZED (SELECT g, {', '.join(scaled)} FROM used, s)",
        f"m0 AS MATERIALIZED (SELECT count(*) AS n, {', '.join(products)} FROM z)",
        *_invert(k),
        f"moved0 AS MATERIALIZED (SELECT z.g, z{k} - ({fitted}) AS e, {', '.join(moves)} FROM z, m{k})",
        f"moved AS MATERIALIZED (SELECT g, e, {', '.join(by_row)} FROM moved0, m{k}, s)",
        f"fit AS MATERIALIZED (SELECT {rank} AS rank, n_rows - {'n_groups' if within else 1} - ({rank}) AS df, "
        f"(SELECT sum(e * e) FROM moved) AS sse, CASE WHEN m0.a{k}_{k} > 0 THEN 1 - (SELECT sum(e * e) FROM moved) / m0.a{k}_{k} END AS r2 FROM m{k}, m0, s)",
        f"spread AS MATERIALIZED (SELECT {squares} FROM ({grouped}) clusters)",
        f"long AS MATERIALIZED ({long})",
        "tested AS (SELECT *, estimate / nullif(std_error, 0) AS t FROM long)",
    ]
    shown = ", ".join(s6(c, c) for c in ("estimate", "std_error", "t"))
    return f"WITH {', '.join(parts)} SELECT term, {shown}, {s6(_p_value(), 'p')}, n, {s6('r2', 'r2')} FROM tested ORDER BY place"
