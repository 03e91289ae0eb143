"""Image geometry, pixel ranges, schedules, durations and vector arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CROP_MARGIN = 1.05


def half_even(x: Column) -> Column:
    """Rounds like Python's round(): halves go to the even neighbour."""
    return F.rint(x).cast("bigint")


def cover_size(width: Column, height: Column, target_w: Column, target_h: Column, margin: float = 1.0) -> tuple[Column, Column]:
    """Size after the least upscale or downscale that covers the target, times margin."""
    scale = F.greatest(target_w / width, target_h / height) * F.lit(margin)
    return F.greatest(target_w.cast("bigint"), half_even(width * scale)), F.greatest(target_h.cast("bigint"), half_even(height * scale))


def center_offset(size: Column, target: Column) -> Column:
    return half_even((size - target) / F.lit(2.0))


def hash_number(*parts: Column | str | int) -> Column:
    """A number in [0, 2 ** 32) from the MD5 of the parts joined by ':'; equal on any engine."""
    text = F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_key(*parts: Column | str | int) -> Column:
    """An order for shuffles: the MD5 of the parts joined by ':'."""
    return F.md5(F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts)))


#: Rounds of a permutation, and steps after which one that is still outside raises.
ROUNDS, WALK = 6, 24
_MODULUS, _FACTOR = (1 << 31) - 1, 1_597_334_677


def permutation_keys(*parts: Column | str | int) -> Column:
    """The keys of a permutation that the parts select."""
    return F.array(*(hash_number(*parts, i) for i in range(ROUNDS)))


def rectangle(n: Column) -> tuple[Column, Column]:
    """Sides of a rectangle of at least n places, about sqrt(n) each, with fewer than sqrt(n) too many."""
    a = F.ceil(F.sqrt(n.cast("double")))
    return a, F.ceil(n / a)


def walked(v: Column, n: Column, a: Column, b: Column, keys: Column) -> Column:
    """From a place at or beyond n, permuted again until it is below: up to ``WALK`` steps, else it raises."""
    sides = F.transform(keys, lambda k, i: F.struct(k.alias("k"), F.when(i % 2 == 0, a).otherwise(b).alias("side")))

    def once(v: Column) -> Column:
        start = F.struct((v % a).alias("l"), F.floor(v / a).alias("r"))
        mix = lambda r, k: (r * F.lit(_FACTOR) + k) % F.lit(_MODULUS)
        step = lambda s, k: F.struct(s["r"].alias("l"), ((s["l"] + mix(s["r"], k["k"]) * mix(s["r"], k["k"]) % F.lit(_MODULUS)) % k["side"]).alias("r"))
        return F.aggregate(sides, start, step, lambda s: s["r"] * a + s["l"])

    steps = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), v, lambda v, _: F.when(v < n, v).otherwise(once(v)))
    found = F.filter(F.array(steps), lambda v: v < n)
    return F.coalesce(F.get(found, F.lit(0)), F.raise_error(F.lit("a permutation didn't come back to its range")).cast("bigint"))


def permute(df: DataFrame, x: str, n: str, a: str, b: str, keys: str, out: str) -> DataFrame:
    """Adds where a keyed permutation of [0, n) puts x: a function of each row alone, so nothing is sorted. a, b: the ``rectangle`` of n.

    A Feistel network over the rectangle's places; what falls at or beyond n is permuted again, which few rows
    need (fewer than one in sqrt(n)). Any x comes back within ``WALK`` steps where sqrt(n) <= WALK; for larger n one
    in more than WALK ** WALK would not, and raises. Each round is a projection of its own, in generated code.
    """
    d = df.withColumns({"__l": F.col(x) % F.col(a), "__r": F.floor(F.col(x) / F.col(a))})
    for i in range(ROUNDS):
        t = f"((__r * {_FACTOR} + `{keys}`[{i}]) % {_MODULUS})"
        d = d.withColumns({"__l": F.col("__r"), "__r": F.expr(f"(__l + {t} * {t} % {_MODULUS}) % `{b if i % 2 else a}`")})
    d = d.withColumn("__v", F.col("__r") * F.col(a) + F.col("__l"))
    again = walked(F.col("__v"), F.col(n), F.col(a), F.col(b), F.col(keys))
    # filters stop at a generator: pushed below the rounds, they would repeat them
    return d.withColumn(out, F.explode(F.array(F.when(F.col("__v") < F.col(n), F.col("__v")).otherwise(again)))).drop("__l", "__r", "__v")


def normalize(pixels: Column) -> Column:
    """[0, 1] to [-1, 1]."""
    return F.transform(pixels, lambda x: (x - 0.5) / 0.5)


def unit_range(x: Column) -> Column:
    """[-1, 1], clamped, to [0, 1]."""
    return (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) + 1) / 2


def denormalize(values: Column) -> Column:
    return F.transform(values, unit_range)


def side_by_side(x: Column, y: Column, width: int) -> Column:
    """One image with the rows of x, each followed by the same row of y; both are flat, in rows of ``width`` values."""
    row = lambda v, r: F.slice(v, r * width + 1, F.lit(width))
    rows = F.filter(F.sequence(F.lit(0), F.floor(F.size(x) / width).cast("int")), lambda r: r * width < F.size(x))
    return F.flatten(F.transform(rows, lambda r: F.concat(row(x, r), row(y, r))))


def array_sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean_abs_diff(x: Column, y: Column) -> Column:
    return array_sum(F.zip_with(x, y, lambda a, b: F.abs(a - b))) / F.size(x)


def mean_sq_diff(x: Column, y: Column) -> Column:
    return array_sum(F.zip_with(x, y, lambda a, b: (a - b) * (a - b))) / F.size(x)


def norm(x: Column) -> Column:
    return F.sqrt(array_sum(F.transform(x, lambda v: v * v)))


def psnr(x: Column, y: Column) -> Column:
    """Decibels between two arrays in [-1, 1], both clamped; 100 at most."""
    return 10 * F.log10(1.0 / F.greatest(mean_sq_diff(denormalize(x), denormalize(y)), F.lit(1e-10)))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def swish(x: Column) -> Column:
    return x / (1 + F.exp(-x))


def warmup(step: Column, steps: int) -> Column:
    """Linear warm-up factor of the learning rate."""
    return F.lit(1.0) if steps <= 0 else F.least(F.lit(1.0), (step + 1) / F.lit(float(steps)))


def every(step: Column, n: int) -> Column:
    """Whether a step is a multiple of n; never for n <= 0."""
    return (step % F.lit(n) == 0) if n > 0 else F.lit(False)


def format_duration(seconds: Column) -> Column:
    """H:MM:SS, or MM:SS below an hour; negative counts as 0."""
    s = F.greatest(F.lit(0).cast("bigint"), seconds.cast("bigint"))
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s % 60)).otherwise(F.format_string("%02d:%02d", m, s % 60))
