"""Normalisation, fold changes and marks of significance, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def real(x: Column) -> Column:
    """The value, or null if it is null, NaN or infinite; aggregates then skip it."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def zscore(x: Column, mu: Column | float, sigma: Column | float) -> Column:
    """(x - mu) / sigma; a zero sigma divides by one."""
    s = F.lit(sigma) if not isinstance(sigma, Column) else sigma
    return (x - mu) / F.when(s == 0, 1.0).otherwise(s)


def un_zscore(z: Column, mu: Column | float, sigma: Column | float) -> Column:
    """z * sigma + mu, each column with its own mu."""
    return z * sigma + mu


def log2_change(x: Column, control: Column, floor: float = 1e-4) -> Column:
    return F.log2((x + floor) / (control + floor))


def stars(p: Column) -> Column:
    """``***``, ``**``, ``*`` or ``ns`` at 0.001, 0.01 and 0.05; empty for a value that is not finite."""
    finite = p.isNotNull() & ~F.isnan(p) & (F.abs(p) < float("inf"))
    return F.when(~finite | p.isNull(), "").when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def star_symbols(p: Column) -> Column:
    return F.when(p.isNull() | F.isnan(p), "").when(p < 0.001, "★★★").when(p < 0.01, "★★").when(p < 0.05, "★").otherwise("n.s.")


def sig_letters(p: Column) -> Column:
    """``a``, ``b``, ``c`` at 0.001, 0.01 and 0.05, else empty; for narrow tables."""
    return F.when(p.isNull() | F.isnan(p), "").when(p < 0.001, "a").when(p < 0.01, "b").when(p < 0.05, "c").otherwise("")


def all_real(columns: Sequence[str]) -> Column:
    """Whether every column holds a finite number."""
    return F.forall(F.array(*columns), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def within(bounds: Mapping[str, tuple[float | None, float | None]], keep_nan: bool) -> Column:
    """Whether no bounded column lies outside its closed range.

    NaN counts as inside if ``keep_nan`` (row cleaning keeps unknown values) and
    as outside otherwise (array cleaning drops them).  Spark orders NaN above
    all numbers, so it is tested apart.
    """
    ok = F.lit(True)
    for name, (low, high) in bounds.items():
        x = F.col(name)
        if low is None and high is None:
            continue
        inside = F.lit(True)
        if low is not None:
            inside = inside & (x >= low)
        if high is not None:
            inside = inside & (x <= high)
        missing = x.isNull() | F.isnan(x)
        ok = ok & F.when(missing, keep_nan).otherwise(inside)
    return ok


def frames_of_ms(ms: Column | float, fps: Column | float) -> Column:
    """Frames in so many milliseconds, one at least; halves go to even."""
    return F.greatest(F.lit(1), F.bround((ms if isinstance(ms, Column) else F.lit(ms)) * 1e-3 * fps).cast("int"))


def column_spec(spec: str | None) -> list[int] | None:
    """``0,1,2,16-28`` as a list of column numbers."""
    if spec is None:
        return None
    out: list[int] = []
    for part in spec.split(","):
        first, _, last = part.strip().partition("-")
        out.extend(range(int(first), int(last or first) + 1))
    return out
