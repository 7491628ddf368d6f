"""European options in closed form, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlume.functions.scalar import norm_cdf, norm_pdf

LEAST, LOW, HIGH, STEPS = 1e-12, 1e-6, 5.0, 23


def _column(x: Column | float | str) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def _d1_d2(s: Column, k: Column, t: Column, r: Column, sigma: Column, q: Column) -> tuple[Column, Column]:
    t, sigma = F.greatest(t, F.lit(LEAST)), F.greatest(sigma, F.lit(LEAST))
    d1 = (F.ln(s / k) + (r - q + sigma * sigma / 2) * t) / (sigma * F.sqrt(t))
    return d1, d1 - sigma * F.sqrt(t)


def bs_price(s, k, t, r, sigma, option_type: str = "call", q=0.0) -> Column:
    """Black-Scholes-Merton price."""
    if option_type not in ("call", "put"):
        raise ValueError("option_type must be 'call' or 'put'")
    s, k, t, r, sigma, q = map(_column, (s, k, t, r, sigma, q))
    d1, d2 = _d1_d2(s, k, t, r, sigma, q)
    paid, held = k * F.exp(-r * t), s * F.exp(-q * t)
    return held * norm_cdf(d1) - paid * norm_cdf(d2) if option_type == "call" else paid * norm_cdf(-d2) - held * norm_cdf(-d1)


def greeks(s, k, t, r, sigma, option_type: str = "call", q=0.0) -> dict[str, Column]:
    """delta, gamma, vega (a unit of volatility), theta (a year), rho."""
    s, k, t, r, sigma, q = map(_column, (s, k, t, r, sigma, q))
    d1, d2 = _d1_d2(s, k, t, r, sigma, q)
    sign = 1 if option_type == "call" else -1
    held, paid, root, bell = F.exp(-q * t), k * F.exp(-r * t), F.sqrt(F.greatest(t, F.lit(LEAST))), norm_pdf(d1)
    n1, n2 = norm_cdf(sign * d1), norm_cdf(sign * d2)
    decay = -s * held * bell * sigma / (2 * root)
    return {
        "delta": sign * held * n1, "gamma": F.try_divide(held * bell, s * sigma * root), "vega": s * held * bell * root,
        "theta": decay - sign * r * paid * n2 + sign * q * s * held * n1, "rho": sign * t * paid * n2,
    }


def implied_vol(price, s, k, t, r, option_type: str | Column = "call", q=0.0) -> Column:
    """The volatility in [1e-6, 5] that gives the price, by bisection folded over 23 steps; null outside the no-arbitrage bounds.

    ``option_type`` may be a column of types. Lambda bodies are not compiled,
    so each value that a step needs twice is bound to a variable once.
    """
    price, s, k, t, r, q = map(_column, (price, s, k, t, r, q))
    sign = F.lit(1.0 if option_type == "call" else -1.0) if isinstance(option_type, str) else F.when(option_type == "call", 1.0).otherwise(-1.0)
    held, paid = s * F.exp(-q * t), k * F.exp(-r * t)
    start = F.struct(F.lit(LOW).alias("lo"), F.lit(HIGH).alias("hi"))

    def value(sigma: Column) -> Column:
        d1, d2 = _d1_d2(s, k, t, r, sigma, q)
        terms = F.array(F.struct((sign * d1).alias("d"), held.alias("w")), F.struct((sign * d2).alias("d"), (-paid).alias("w")))
        return sign * F.aggregate(terms, F.lit(0.0), lambda total, x: total + x["w"] * norm_cdf(x["d"]))

    def halve(b: Column, _: Column) -> Column:
        tried = F.transform(F.array((b["lo"] + b["hi"]) / 2), lambda mid: F.struct(mid.alias("mid"), (value(mid) < price).alias("low")))
        return F.transform(tried, lambda x: F.struct(F.when(x["low"], x["mid"]).otherwise(b["lo"]).alias("lo"), F.when(x["low"], b["hi"]).otherwise(x["mid"]).alias("hi")))[0]

    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, halve, lambda b: (b["lo"] + b["hi"]) / 2)
    least, most = F.greatest(sign * (held - paid), F.lit(0.0)), F.when(sign > 0, held).otherwise(paid)
    return F.when((price > least) & (price < most), found)


def chain_overlay(chain: DataFrame, spot: float, days: Column, r: float = 0.04, top: int | None = 5) -> DataFrame:
    """The strikes nearest to the spot with mid price, years to expiry and implied volatility."""
    df = chain.withColumns({"mid": (F.col("bid") + F.col("ask")) / 2, "years": F.greatest(days, F.lit(1)) / 365})
    out = df.withColumn("iv", implied_vol("mid", spot, "strike", "years", r, F.col("option_type"))).orderBy(F.abs(F.col("strike") - spot), "strike", "option_type")
    return out.limit(top) if top else out


def iv_rank(history: DataFrame, window: int = 252) -> DataFrame:
    """Adds iv_rank: where each implied volatility lies between the least and most of its window."""
    from barlume.functions.windows import trailing

    low, high = F.min("iv").over(trailing(window)), F.max("iv").over(trailing(window))
    return history.withColumn("iv_rank", F.try_divide(F.col("iv") - low, high - low))


def covered_calls(calls: DataFrame, spot: Column | float | str, delta: float = 0.3, days: tuple[int, int] = (20, 40), r: float = 0.04, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """For each underlying the call to write: of those that expire in so many days the one with the delta nearest to the wanted one.

    ``calls`` has strike, days, sigma and mid, the price. The yield is the price over the
    spot, scaled to a year. Ties go to the lower strike, then to fewer days.
    """
    spot, years = _column(spot), F.col("days") / 365
    rows = calls.filter(F.col("days").between(*days)).withColumn("delta", greeks(spot, "strike", years, r, "sigma")["delta"])
    rows = rows.withColumn("annual_yield", F.try_divide(F.col("mid"), spot) / years)
    order = F.struct(F.round(F.abs(F.col("delta") - delta), 9).alias("off"), "strike", "days", "delta", "mid", "annual_yield")
    return rows.groupBy(*keys).agg(F.min(order).alias("best")).select(*keys, *(F.col(f"best.{c}").alias(c) for c in ("strike", "days", "delta", "mid", "annual_yield")))


__all__ = ["bs_price", "chain_overlay", "covered_calls", "greeks", "implied_vol", "iv_rank"]
