"""Small SQL text helpers for the DuckDB oracles."""

from __future__ import annotations


def unpivot(table: str, ids, cols, qname: str = "question", vname: str = "score",
            cast: str | None = "DOUBLE") -> str:
    """UNION ALL unpivot that keeps NULL values (DuckDB's UNPIVOT drops them)."""
    idl = ", ".join(ids)
    sel = (lambda c: f"CAST({c} AS {cast})") if cast else (lambda c: c)
    parts = [f"SELECT {idl + ', ' if idl else ''}'{c}' AS {qname}, {sel(c)} AS {vname} FROM {table}"
             for c in cols]
    return "\nUNION ALL ".join(parts)


def values_list(vals) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in vals)


def normal_p(z: str) -> str:
    """Two-sided normal p of |z| as SQL without erf: Phi(z) - 1/2 = phi(z) (z + z^3/3 + z^5/(3*5) + ...)."""
    az = f"abs({z})"
    term = f"exp((2 * k + 1) * ln(greatest({az}, 1e-300)) - {az} * {az} / 2 - (k + 1) * ln(2.0) - lgamma(k + 1.5) + 0.5 * ln(pi()))"
    return f"(CASE WHEN {az} > 8 THEN 0.0 ELSE greatest(0.0, 1 - sqrt(2 / pi()) * list_sum([{term} FOR k IN range(0, 300)])) END)"


def t_p(t: str, df: str) -> str:
    """Two-sided Student t p as SQL: 1 - I_x(1/2, df/2) with x = t^2 / (df + t^2), by its series of positive terms."""
    x = f"greatest({t} * {t} / ({df} + {t} * {t}), 1e-300)"
    term = (f"exp((k + 0.5) * ln({x}) + {df} / 2 * ln({df} / ({df} + {t} * {t})) + lgamma(k + 0.5 + {df} / 2) - lgamma(k + 1.5)"
            f" - lgamma({df} / 2))")
    return f"(CASE WHEN {t} IS NOT NULL THEN greatest(0.0, 1 - list_sum([{term} FOR k IN range(0, 1500)])) END)"
