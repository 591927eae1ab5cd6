"""Numeric expressions on scalars and on array columns, all evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from methlake.functions.binding import let

LAYER_NORM_EPS = 1e-5
MASK_PENALTY = 1e4  # subtracted from the logit of a class outside the allowed set


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_norm(a: Column) -> Column:
    return F.sqrt(array_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def logsumexp(a: Column) -> Column:
    return let(
        F.array_max(a).cast("double"),
        lambda top: top + F.ln(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.exp(x.cast("double") - top))),
    )


def log_softmax(a: Column, temperature: Column | float = 1.0) -> Column:
    """Log of the row softmax of a / temperature, shifted by its maximum."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    scaled = F.transform(a, lambda x: x.cast("double") / t)
    return let(scaled, lambda s: let(logsumexp(s), lambda norm: F.transform(s, lambda x: x - norm)))


def softmax(a: Column, temperature: Column | float = 1.0) -> Column:
    return F.transform(log_softmax(a, temperature), lambda x: F.exp(x))


def set_nll(logits: Column, mask: Column) -> Column:
    """-log of the probability of the allowed classes (mask 1 = allowed, 0 = not)."""
    return logsumexp(logits) - logsumexp(masked_logits(logits, mask))


def masked_logits(logits: Column, mask: Column) -> Column:
    return F.zip_with(logits, mask, lambda z, m: z.cast("double") + (m.cast("double") - 1.0) * MASK_PENALTY)


def set_nll_gradient(logits: Column, mask: Column) -> Column:
    """d loss / d logits: predicted minus restricted distribution."""
    return F.zip_with(softmax(logits), softmax(masked_logits(logits, mask)), lambda p, q: p - q)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def silu(x: Column) -> Column:
    return x / (1.0 + F.exp(-x))


def layer_norm(a: Column, gain: Column | None = None, shift: Column | None = None) -> Column:
    """(a - mean) / sqrt(biased variance + eps), optionally times gain plus shift."""
    n = F.size(a).cast("double")
    centred = let(array_sum(a) / n, lambda mean: F.transform(a, lambda x: x.cast("double") - mean))
    out = let(
        centred,
        lambda c: let(
            F.sqrt(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x * x) / n + LAYER_NORM_EPS),
            lambda sd: F.transform(c, lambda x: x / sd),
        ),
    )
    if gain is not None:
        out = F.zip_with(out, gain, lambda x, g: x * g)
    if shift is not None:
        out = F.zip_with(out, shift, lambda x, s: x + s)
    return out


def kd_loss(z: Column, log_t: Column, temperature: float) -> Column:
    """T^2 times the divergence of softened predictions from softened targets, per row."""
    terms = F.zip_with(
        softmax(log_t, temperature),
        log_softmax(z, temperature),
        lambda t, lp: t * (F.ln(t + 1e-12) - lp),
    )
    return array_sum(terms) * float(temperature) ** 2


def level_cross_entropy(target_mass: Column, predicted_mass: Column, weight: float) -> Column:
    """One node's share of the hierarchy loss: -weight * q * ln(max(p, 1e-8))."""
    return -weight * target_mass * F.ln(F.greatest(predicted_mass, F.lit(1e-8)))


def uniform(seed: int | str, *keys: Column) -> Column:
    """A uniform draw in [0, 1) that depends only on the seed and the keys.

    Counter-based, so a retried task or another partitioning repeats the same draw, which `rand()`
    does not promise. 52 bits of an md5 digest.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x))


def ratio_4dp(part: Column, whole: Column) -> Column:
    """part / whole with four decimals, rounding the binary quotient half to even.

    The quotient is scaled by 2^62 into an integer, so the rounding decision is made on its exact
    value and not on its shortest decimal spelling (3/160 is just below 0.01875).
    """
    bits = (part.cast("double") / whole.cast("double") * F.lit(float(1 << 62))).cast("bigint").cast("decimal(20,0)")
    scaled = (bits * F.lit(10000).cast("decimal(5,0)")).cast("decimal(38,0)")
    unit = F.lit(1 << 62).cast("decimal(20,0)")
    rem = scaled % unit
    k = ((scaled - rem) / unit).cast("bigint")
    half = F.lit(1 << 61).cast("decimal(20,0)")
    up = (rem > half) | ((rem == half) & (k % 2 == 1))
    k = k + F.when(up, 1).otherwise(0)
    return F.concat((k / 10000).cast("bigint").cast("string"), F.lit("."), F.lpad((k % 10000).cast("string"), 4, "0"))
