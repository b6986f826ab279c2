"""Image planes: gamma-weighted chroma, quality from sums, and names of what a stream codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenweave.functions.blocks import clip

#: Gamma 0.8 in 12 bits, and its inverse at every 128th, as the chroma sums need them.
TO_LINEAR = [int(4095 * (v / 255) ** 0.8 + 0.5) for v in range(256)]
TO_GAMMA = [int(255 * (128 * v / 4095) ** 1.25 + 0.5) for v in range(33)]

#: Names of luma and chroma modes by number, and the sub-block mode that each stands for (RFC 6386, section 8).
MODE_NAMES = ("DC_PRED", "V_PRED", "H_PRED", "TM_PRED", "B_PRED")
SUBBLOCK_OF = (0, 2, 3, 1)


def looked_up(values: list[int], at: Column) -> Column:
    return F.element_at(F.expr(f"array({', '.join(map(str, values))})"), at.cast("int") + 1).cast("long")


def to_linear(sample: Column) -> Column:
    return looked_up(TO_LINEAR, sample)


def to_gamma(total: Column) -> Column:
    """Four times the sample whose linear value is a quarter of ``total``, straight between the table's places."""
    place, rest = F.shiftright(total, 9), total.bitwiseAND(511)
    return F.shiftright(looked_up(TO_GAMMA, place + 1) * rest + looked_up(TO_GAMMA, place) * (512 - rest) + 64, 7)


def chroma(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    """U and V of four times a colour."""
    scaled = lambda v: clip(F.shiftright(v + (1 << 17) + (128 << 18), 18), 0, 255)
    return scaled(-9719 * r - 19081 * g + 28800 * b), scaled(28800 * r - 24116 * g - 4684 * b)


def ssim(n: Column, x: Column, y: Column, xx: Column, yy: Column, xy: Column) -> Column:
    """From a tile's count of samples and sums of the samples, their squares and products."""
    mx, my = x / n, y / n
    vx, vy, cov = xx / n - mx * mx, yy / n - my * my, xy / n - mx * my
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return ((2 * mx * my + c1) * (2 * cov + c2)) / ((mx * mx + my * my + c1) * (vx + vy + c2))


def scaled_step(step: Column, percent: Column) -> Column:
    """A share of a step, rounded, of 1 to 2047; no percentage is all of it."""
    percent = F.when(percent == 0, 100).otherwise(percent)
    return clip(F.floor((step * percent + 50) / 100), 1, 2047)


def magnitude_cost(level: Column) -> Column:
    """One more than the whole log2 of the magnitude, six at most; zero costs nothing."""
    size = F.abs(level)
    return F.when(size == 0, 0).otherwise(F.least(F.lit(6), F.length(F.bin(size)))).cast("long")


def block_rate(levels: Column) -> Column:
    """Cost proxy of a 4x4 block: its magnitudes, and one for a first coefficient that isn't zero."""
    costs = F.aggregate(levels, F.lit(0).cast("long"), lambda a, v: a + magnitude_cost(v))
    return costs + (F.get(levels, F.lit(0)) != 0).cast("long")


def mode_name(mode: Column) -> Column:
    """The number itself where it has no name."""
    return F.coalesce(F.get(F.array(*map(F.lit, MODE_NAMES)), mode), mode.cast("string"))


def number_text(value: Column) -> Column:
    """Fewer places the larger a number is: none from 100, one from 10, three below."""
    size = F.abs(value)
    return F.when(size >= 100, F.format_string("%.0f", value)).when(size >= 10, F.format_string("%.1f", value)).otherwise(F.format_string("%.3f", value))


def tick(i: Column, low: Column, high: Column, n: int) -> Column:
    """The i-th of n evenly spaced places from low to high."""
    return low + i * (high - low) / (n - 1)
