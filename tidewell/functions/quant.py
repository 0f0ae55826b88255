"""Closed-form pricing as Column expressions, but for the normal distribution; NULL outside a formula's domain."""

from __future__ import annotations

import math
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cash flows of one instrument, at most.
MAX_PERIODS = 12_000
#: Years of a swap, at most.
MAX_YEARS = 200


def normal_density(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


#: Rational approximations of erfc (those of fdlibm), from the lowest power up: below 0.84375, below 1.25, below 1/0.35 and beyond.
NEAR = (1.28379167095512558561e-01, -3.25042107247001499370e-01, -2.84817495755985104766e-02, -5.77027029648944159157e-03, -2.37630166566501626084e-05), (1.0, 3.97917223959155352819e-01, 6.50222499887672944485e-02, 5.08130628187576562776e-03, 1.32494738004321644526e-04, -3.96022827877536812320e-06)
AT_ONE = 8.45062911510467529297e-01
ONE = (-2.36211856075265944077e-03, 4.14856118683748331666e-01, -3.72207876035701323847e-01, 3.18346619901161753674e-01, -1.10894694282396677476e-01, 3.54783043256182359371e-02, -2.16637559486879084300e-03), (1.0, 1.06420880400844228286e-01, 5.40397917702171048937e-01, 7.18286544141962662868e-02, 1.26171219808761642112e-01, 1.36370839120290507362e-02, 1.19844998467991074170e-02)
MID = (-9.86494403484714822705e-03, -6.93858572707181764372e-01, -1.05586262253232909814e01, -6.23753324503260060396e01, -1.62396669462573470355e02, -1.84605092906711035994e02, -8.12874355063065934246e01, -9.81432934416914548592e00), (1.0, 1.96512716674392571292e01, 1.37657754143519042600e02, 4.34565877475229228821e02, 6.45387271733267880336e02, 4.29008140027567833386e02, 1.08635005541779435134e02, 6.57024977031928170135e00, -6.04244152148580987438e-02)
FAR = (-9.86494292470009928597e-03, -7.99283237680523006574e-01, -1.77579549177547519889e01, -1.60636384855821916062e02, -6.37566443368389627722e02, -1.02509513161107724954e03, -4.83519191608651397019e02), (1.0, 3.03380607434824582924e01, 3.25792512996573918826e02, 1.53672958608443695994e03, 3.19985821950859553908e03, 2.55305040643316442583e03, 4.74528541206955367215e02, -2.24409524465858183362e01)


def _ratio(x, coefficients):
    above, below = (reduce(lambda total, c: total * x + c, reversed(cs)) for cs in coefficients)
    return above / below


def _erfc(a):
    """The complementary error function of an array of numbers >= 0 to double precision, near zero and in the tail."""
    import numpy as np

    out = np.where(np.isnan(a), a, 0.0)  # beyond 28 less than any double
    at = a < 0.84375
    v = a[at]
    out[at] = 1 - (v + v * _ratio(v * v, NEAR))
    at = (a >= 0.84375) & (a < 1.25)
    out[at] = 1 - AT_ONE - _ratio(a[at] - 1, ONE)
    for least, most, c in ((1.25, 1 / 0.35, MID), (1 / 0.35, 28, FAR)):
        at = (a >= least) & (a < most)
        v = a[at]
        z = v.astype(np.float32).astype(np.float64)  # the leading bits have an exact square, which keeps exp(-v^2) exact to the last places
        out[at] = np.exp(-z * z - 0.5625) * np.exp((z - v) * (z + v) + _ratio(1 / (v * v), c)) / v
    return out


@cache
def _cdf():
    import numpy as np
    import pyarrow as pa

    def cdf(x: pa.Array) -> pa.Array:
        v = x.to_numpy(zero_copy_only=False)
        upper = 0.5 * _erfc(np.abs(v) / math.sqrt(2))
        return pa.array(np.where(v >= 0, 1 - upper, upper), mask=np.asarray(x.is_null()))

    cdf.__annotations__ = {"x": pa.Array, "return": pa.Array}  # not as text
    return F.arrow_udf(cdf, "double")


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution to double precision: Phi(-a) is erfc(a / sqrt 2) / 2, and that by four quotients of polynomials.

    Spark has no erf, and as an expression each quotient repeats its argument or runs uncompiled: one function over
    batches takes them all. It is given every row, so its argument has to guard its own domain.
    """
    return _cdf()(x)


def _black(spot, strike, t, r, q, vol, is_call):
    sign = F.when(is_call != 0, 1.0).otherwise(-1.0)
    ok = (spot > 0) & (strike > 0) & (t > 0) & (vol > 0)
    sd = vol * F.sqrt(t)
    d1 = F.when(ok, (F.ln(spot / strike) + (r - q) * t) / sd + sd / 2)
    return d1, d1 - sd, sign, lambda v: F.when(ok, v)


def bs_price(spot, strike, t, r, q, vol, is_call):
    d1, d2, s, ok = _black(spot, strike, t, r, q, vol, is_call)
    return ok(s * (spot * F.exp(-q * t) * normal_cdf(s * d1) - strike * F.exp(-r * t) * normal_cdf(s * d2)))


def bs_delta(spot, strike, t, r, q, vol, is_call):
    d1, _, s, ok = _black(spot, strike, t, r, q, vol, is_call)
    return ok(s * F.exp(-q * t) * normal_cdf(s * d1))


def bs_gamma(spot, strike, t, r, q, vol, is_call):
    d1, _, _, ok = _black(spot, strike, t, r, q, vol, is_call)
    return ok(F.exp(-q * t) * normal_density(d1) / (spot * vol * F.sqrt(t)))


def bs_vega(spot, strike, t, r, q, vol, is_call):
    """Per unit of volatility."""
    d1, _, _, ok = _black(spot, strike, t, r, q, vol, is_call)
    return ok(spot * F.exp(-q * t) * normal_density(d1) * F.sqrt(t))


def bs_theta(spot, strike, t, r, q, vol, is_call):
    """Per year; negative for a long option as a rule."""
    d1, d2, s, ok = _black(spot, strike, t, r, q, vol, is_call)
    decay = -spot * F.exp(-q * t) * normal_density(d1) * vol / (2 * F.sqrt(t))
    return ok(decay - s * r * strike * F.exp(-r * t) * normal_cdf(s * d2) + s * q * spot * F.exp(-q * t) * normal_cdf(s * d1))


def _flows(n: Column, value) -> Column:
    """Sum of value(i) for i = 1..n."""
    return F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.lit(0.0), lambda acc, i: acc + value(i.cast("double")))


def _bond(face, coupon, years, yld, freq):
    n = F.bround(years * freq)  # half to even
    ok = (face > 0) & (years > 0) & (freq > 0) & (coupon >= 0) & (n >= 1) & (n <= MAX_PERIODS) & (yld / freq > -1)
    steps = F.when(ok, n).otherwise(1)
    step = F.when(ok, 1 + yld / freq).otherwise(1.0)
    pv = lambda i: (face * coupon / freq + F.when(i == steps, face).otherwise(0.0)) / F.pow(step, i)
    price = _flows(steps, pv)
    weighted = _flows(steps, lambda i: pv(i) * i / freq)
    ok = ok & (price > 0)
    return F.when(ok, price), F.when(ok, weighted / price / step)


def bond_price(face, coupon, years, yld, freq):
    return _bond(face, coupon, years, yld, freq)[0]


def bond_duration(face, coupon, years, yld, freq):
    """Modified duration in years."""
    return _bond(face, coupon, years, yld, freq)[1]


def bond_dv01(face, coupon, years, yld, freq):
    price, duration = _bond(face, coupon, years, yld, freq)
    return price * duration * 1e-4


def irs_npv(notional, fixed, years, flat, pay_fixed):
    """Annual fixed leg against a par floating leg on a flat, annually compounded curve."""
    n = F.bround(years)
    ok = (notional > 0) & (years > 0) & (n >= 1) & (n <= MAX_YEARS) & (flat > -1)
    steps, step = F.when(ok, n).otherwise(1), F.when(ok, 1 + flat).otherwise(1.0)
    fixed_leg = notional * fixed * _flows(steps, lambda i: 1 / F.pow(step, i))
    floating = notional * (1 - 1 / F.pow(step, steps))
    return F.when(ok, F.when(pay_fixed != 0, floating - fixed_leg).otherwise(fixed_leg - floating))


def irs_dv01(notional, fixed, years, flat, pay_fixed):
    """Size of the change of value when the curve moves up one basis point."""
    return F.abs(irs_npv(notional, fixed, years, flat + 1e-4, pay_fixed) - irs_npv(notional, fixed, years, flat, pay_fixed))


def fx_fwd(spot, rd, rf, t):
    return F.when((spot > 0) & (t >= 0), spot * F.exp((rd - rf) * t))


FUNCTIONS = {
    "BS_PRICE": (7, bs_price), "BS_DELTA": (7, bs_delta), "BS_GAMMA": (7, bs_gamma), "BS_VEGA": (7, bs_vega), "BS_THETA": (7, bs_theta),
    "BOND_PRICE": (5, bond_price), "BOND_DV01": (5, bond_dv01), "BOND_DURATION": (5, bond_duration), "IRS_NPV": (5, irs_npv), "IRS_DV01": (5, irs_dv01), "FX_FWD": (4, fx_fwd),
}
