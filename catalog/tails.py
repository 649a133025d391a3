"""Tail probabilities as SQL, by Simpson's rule on a fixed grid. Each takes SQL expressions of the outer row."""


def _simpson(f: str, width: str, steps: int) -> str:
    """Integral of f, an expression of s, over 0 to width."""
    body = f.replace("{s}", f"(i * ({width}) / {steps})")
    return (f"(SELECT sum(CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * ({body})) FROM (SELECT CAST(range AS DOUBLE) AS i FROM range(0, {steps + 1})) g)"
            f" * ({width}) / {steps} / 3")


def normal_upper(z: str) -> str:
    """P(N > |z|): the density at |z| times what follows it, in units of 1 / (|z| + 1)."""
    a = f"abs({z})"
    return f"(exp(-{a} * {a} / 2) / sqrt(2 * pi()) / ({a} + 1) * {_simpson(f'exp(-{a} * {{s}} / ({a} + 1) - {{s}} * {{s}} / (2 * ({a} + 1) * ({a} + 1)))', '60', 6000)})"


def normal_two_sided(z: str) -> str:
    return f"(2 * {normal_upper(z)})"


def normal_sf(z: str) -> str:
    return f"(CASE WHEN {z} >= 0 THEN {normal_upper(z)} ELSE 1 - {normal_upper(z)} END)"


def t_two_sided(t: str, df: str) -> str:
    """Twice the upper tail of Student's t, as an integral over the angle atan(t / sqrt(df))."""
    angle = f"atan2(abs({t}), sqrt({df}))"
    width = f"least(pi() / 2 - {angle}, 40 / sqrt({df}))"
    front = f"exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt(pi())"
    return f"least(1.0, 2 * {front} * {_simpson(f'pow(greatest(cos({angle} + {{s}}), 0), {df} - 1)', width, 4000)})"


def chi2_sf(x: str, df: str) -> str:
    """Upper tail of chi-square, from the density at x on."""
    k = f"(CAST({df} AS DOUBLE) / 2)"
    front = f"exp(({k} - 1) * ln({x}) - {x} / 2 - {k} * ln(2) - lgamma({k}))"
    width = f"greatest(2 * {k} - {x}, 0) + 30 * sqrt({k}) + 100"
    return f"(CASE WHEN {x} <= 0 THEN 1 ELSE {front} * {_simpson(f'exp(({k} - 1) * ln(1 + {{s}} / {x}) - {{s}} / 2)', width, 20000)} END)"


def with_p(sql: str, tail: str, **more: str) -> str:
    """sql with the column p_value, and more columns by name."""
    cols = ", ".join(f"{t} AS {n}" for n, t in {"p_value": tail, **more}.items())
    return f"SELECT *, {cols} FROM ({sql}) AS tested"


#: The p-value of a correlation r over n pairs.
OF_R = t_two_sided("(r * sqrt((n - 2) / (1 - r * r)))", "CAST(n - 2 AS DOUBLE)")
