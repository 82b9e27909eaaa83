"""Closed-form responses of a cell as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellgauge.functions.draws import _column


@dataclass(frozen=True)
class Geometry:
    """Well constants of the association model. Fixed values."""

    volume: float = 1.01e-6  # of the solution
    concentration: float = 9.95e7  # particles per volume at time 0
    coverage: float = 1.0  # share of the surface covered by cells
    surface: float = 5.31e-5  # of the cell boundary


def compartment_response(t, lam, beta, p, form: str = "balanced") -> tuple[Column, Column]:
    """Surface and internal share (S, I) at time ``t``.

    Internalisation at rate ``lam``, recycling at rate ``beta``, a share ``p`` of which
    is lost. ``form="balanced"`` starts at S(0) = beta / (beta + lam) and obeys
    dI/dt = lam S; ``form="reference"`` keeps the published surface formula, which
    does neither and has a pole at lam = beta (1 - p), where it gives null.

    With a = lam + beta p, the difference d = a - beta cancels against the
    exponentials through phi(x) = (1 - exp(-x)) / x, so the balanced forms have no
    singularity at d = 0. Rates may be negative; a vanishing denominator gives null.
    """
    t, lam, beta, p = (_column(v) for v in (t, lam, beta, p))
    s, a = lam + beta, lam + beta * p
    d = a - beta
    x = d * t
    phi = F.when(F.abs(x) < 1e-9, 1.0 - x / 2.0).otherwise(-F.expm1(-x) / x)
    fading, kept = F.exp(-beta * t), 1.0 - p
    linear = beta * p * s * a * t + lam * kept * (s + beta * p)
    internal = F.try_divide(
        lam * (linear - lam * kept * fading * (beta * beta * t * phi + a + beta)), s * a * a
    )
    if form == "balanced":
        surface = F.try_divide(beta * (p * s + lam * kept * fading * (1.0 + beta * t * phi)), s * a)
    elif form == "reference":
        top = p * s * d + lam * beta * (lam * p - 1.0) * F.exp(-a * t) + lam * p * fading
        surface = F.try_divide(beta * top, s * a * d)
    else:
        raise ValueError(f"unknown form {form!r}")
    return surface, internal


def association_response(t, r, capacity, geometry: Geometry = Geometry()) -> Column:
    """Particles bound to a cell at time ``t`` with finite capacity.

    Null when the well holds no particles or the capacity is not positive.
    """
    t, r, k = (_column(v) for v in (t, r, capacity))
    total = geometry.volume * geometry.concentration
    if total <= 0:
        return F.lit(None).cast("double")
    k = F.when(k > 0, k)
    speed = r * geometry.coverage * geometry.surface
    excess = F.lit(total) - k
    fading = F.exp(-speed * excess * t / (k * geometry.volume))
    # Where the exponential overflows the quotient is 0 and every particle is bound.
    unequal = total * (1.0 - F.try_divide(excess, F.lit(total) - k * fading))
    equal = (
        speed * geometry.concentration**2 * geometry.volume * t
        / (k + speed * geometry.concentration * t)
    )
    return F.when(excess == 0, equal).otherwise(unequal)


def saturating_uptake(r, capacity, exposure, geometry: Geometry = Geometry()) -> Column:
    """Dose taken up after an integrated concentration ``exposure``."""
    r, k, exposure = (_column(v) for v in (r, capacity, exposure))
    k = F.when(k > 0, k)
    speed = geometry.coverage * geometry.surface
    return k * (1.0 - F.exp(-speed * r * exposure / k))


def rescale_voltage(value, v_ref: float, v_det: float) -> Column:
    """Signal as it would read at detector voltage ``v_ref``. Fixed value: slope 0.016."""
    return _column(value) * F.exp(F.lit(0.016 * (v_ref - v_det)))


def clamp_nonnegative(value) -> Column:
    """P5: max(0, x), keeping NaN and null as they are."""
    value = _column(value)
    return F.when(value < 0, F.lit(0.0)).otherwise(value)


def rescale_units(value, factor: float) -> Column:
    """Hours to seconds, raw signal to plotting units."""
    return _column(value) * F.lit(float(factor))
