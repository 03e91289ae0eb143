"""Scalar losses as columns and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import mean_abs_diff, mean_sq_diff, norm, softplus

KINDS = ("hinge", "non_saturating")


def _known(kind: str) -> None:
    if kind not in KINDS:
        raise ValueError(f"unknown adversarial loss: {kind}")


def reconstruction(pairs: DataFrame) -> DataFrame:
    """Mean absolute difference over all elements of x and y (arrays of one size)."""
    return pairs.agg(F.avg(mean_abs_diff(F.col("x"), F.col("y"))).alias("recon_l1"))


def quantizer(pairs: DataFrame, beta: float = 0.15, use_ema: bool = False) -> DataFrame:
    """Codebook, commitment and total loss; under moving averages the codebook isn't trained."""
    mse = F.avg(mean_sq_diff(F.col("x"), F.col("y")))
    code = F.lit(0.0) if use_ema else F.col("commitment_loss")
    return pairs.agg(mse.alias("commitment_loss")).withColumn("codebook_loss", code).withColumn("loss", F.col("codebook_loss") + beta * F.col("commitment_loss"))


def generator_term(fake: Column, kind: str = "hinge") -> Column:
    _known(kind)
    return -F.avg(fake) if kind == "hinge" else F.avg(softplus(-fake))


def discriminator_term(real: Column, fake: Column, kind: str = "hinge") -> Column:
    _known(kind)
    if kind == "hinge":
        return 0.5 * (F.avg(F.greatest(F.lit(0.0), 1 - real)) + F.avg(F.greatest(F.lit(0.0), 1 + fake)))
    return 0.5 * (F.avg(softplus(-real)) + F.avg(softplus(fake)))


def adaptive_weight(g1: Column, g2: Column, eps: float = 1e-4) -> Column:
    """Ratio of two gradients' norms, between 0 and 10,000."""
    return F.least(F.lit(1e4), F.greatest(F.lit(0.0), norm(g1) / (norm(g2) + eps)))


def total(recon: Column, codebook: Column, perceptual: Column, adversarial: Column, step: Column, start: int = 30_000, l_perceptual: float = 1.0, l_adversarial: float = 0.1) -> Column:
    """Weighted sum; the adversarial term counts from the start step on."""
    return recon + codebook + l_perceptual * perceptual + l_adversarial * F.when(step >= start, adversarial).otherwise(0.0)


def clip_factor(gradient: Column, most: float = 1.0) -> Column:
    """What a gradient is multiplied by so that its norm stays at most ``most``."""
    return F.least(F.lit(1.0), F.lit(most) / (norm(gradient) + 1e-6))
