"""Row-local column functions. Nulls stand for missing values; NaN is made null at ingest (see clean)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(x: Column) -> Column:
    """x without NaN."""
    return F.when(~F.isnan(x), x)


def share(x: Column) -> Column:
    """x where it can be a rate, else null."""
    return F.when(x.between(0, 1), x)


def clip(x: Column, lo: float, hi: float) -> Column:
    """x limited to lo..hi; null stays null (greatest and least alone would skip it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def log1p_floor(x: Column) -> Column:
    """log(1 + x) with negative x counted as zero."""
    return F.when(x.isNotNull(), F.log1p(F.greatest(x, F.lit(0)).cast("double")))


def logit(p: Column, lo: float = 1e-6, hi: float = 1 - 1e-6) -> Column:
    """Log odds of p limited to lo..hi; the two limits need not mirror each other."""
    q = clip(p, lo, hi)
    return F.ln(q / (1 - q))


def sigmoid(z: Column) -> Column:
    """1 / (1 + exp(-z))."""
    return 1 / (1 + F.exp(-z))


def recalibrate(p: Column, scale: Column | float, bias: Column | float) -> Column:
    """p moved by an affine map of its log odds."""
    return sigmoid(logit(p) * scale + bias)


def counted(n: Column, rate: Column) -> Column:
    """The whole count behind a rate: rint (half to even) of n * rate; a missing rate counts as zero."""
    return F.rint(n * F.coalesce(rate, F.lit(0.0)))


def reliability(n: Column, k: float) -> Column:
    """n / (n + k)."""
    return n / (n + k)


def shrink(total: Column, n: Column, k: float, prior: Column) -> Column:
    """(total + k prior) / (n + k)."""
    return (total + k * prior) / (n + k)


def shrink_rate(rate: Column, n: Column, k: float, prior: Column) -> Column:
    """A rate over n drawn to the prior with weight k; a missing rate gives the prior."""
    return F.when(rate.isNull() | n.isNull(), prior).otherwise((n * rate + k * prior) / (n + k))


def lambda_shrink(rate: Column, n: Column, m: float, prior: Column) -> Column:
    """lambda rate + (1 - lambda) prior, lambda = n / (n + m); null or non-positive n, or null rate, give the prior."""
    if not 0 < m < float("inf"):
        raise ValueError("m must be finite and positive")
    lam = n / (n + m)
    return F.when(rate.isNull() | n.isNull() | (n <= 0), prior).otherwise(lam * rate + (1 - lam) * prior)


def entropy_bits(p: Column) -> Column:
    """Entropy in bits of a coin of probability p; 0 at the ends."""
    term = lambda q: F.when(q > 0, q * F.log2(q)).otherwise(0.0)
    return F.when(p.isNotNull(), -(term(p) + term(1 - p)))


def right_closed(x: Column, edges: list[float], labels: list[str], missing: str = "nan") -> Column:
    """The label of the bin lo < x <= hi that holds x; missing where x is null or in no bin."""
    out = F.lit(missing)
    for lo, hi, label in reversed(list(zip(edges[:-1], edges[1:], labels))):
        out = F.when((x > lo) & (x <= hi), F.lit(label)).otherwise(out)
    return out


def first_match(cases: list[tuple[Column, str]], otherwise: str) -> Column:
    """The value of the first case that holds; a null condition doesn't hold."""
    out = F.lit(otherwise)
    for cond, value in reversed(cases):
        out = F.when(cond, F.lit(value)).otherwise(out)
    return out


def steps(x: Column, bounds: list[float], values: list[float]) -> Column:
    """values[i] for the first bound with x <= bound, the last value beyond all (and for null)."""
    out = F.lit(values[-1])
    for bound, value in reversed(list(zip(bounds, values[:-1]))):
        out = F.when(x <= bound, F.lit(value)).otherwise(out)
    return out


def argmax_name(named: dict[str, Column], none: str) -> Column:
    """The name of the greatest non-null value, the first on ties."""
    top = F.greatest(*named.values())
    return F.coalesce(*[F.when(v == top, F.lit(n)) for n, v in named.items()], F.lit(none))


def composition(parts: list[Column], pseudo: float) -> dict[str, Column]:
    """Shares with pseudo counts, their entropy, greatest share, effective number and log ratio of the first two."""
    total = sum((F.coalesce(p, F.lit(0.0)) + pseudo for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0)) + pseudo)
    shares = [(F.coalesce(p, F.lit(0.0)) + pseudo) / total for p in parts]
    h = -sum((s * F.ln(s) for s in shares[1:]), shares[0] * F.ln(shares[0]))
    return {"entropy": h, "top_share": F.greatest(*shares), "effective": F.exp(h), "log_ratio": F.ln(shares[0] / shares[1])}
