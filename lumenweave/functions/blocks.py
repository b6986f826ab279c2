"""Blocks as columns: an 8x8 or 4x4 block is an array of longs, row by row. All arithmetic stays in generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

def clip(value: Column, low: int, high: int) -> Column:
    return F.least(F.lit(high).cast("long"), F.greatest(F.lit(low).cast("long"), value))


def wrap16(value: Column) -> Column:
    """What a signed 16-bit store keeps."""
    low = value.bitwiseAND(0xFFFF)
    return F.when(low >= 0x8000, low - 0x10000).otherwise(low)


def pixels(vector: Column) -> Column:
    """Numbers around zero as samples of 0 to 255."""
    return F.transform(vector, lambda v: clip(F.floor((v.cast("double") + 0.5) * 255).cast("long"), 0, 255))


def sub_block(pixels_: Column, k: int) -> Column:
    """The k-th 4x4 block of an 8x8 block."""
    top, left = k // 2 * 4, k % 2 * 4
    return F.array(*(pixels_[(top + y) * 8 + left + x] for y in range(4) for x in range(4)))


def at(block: Column, n: int = 16) -> list[Column]:
    return [block[i] for i in range(n)]


#: A pass over the lines of a 4x4 block: what each of a line's four values becomes, as expressions of {0} to {3}, and whether lines are rows or columns.
Pass = tuple[Sequence[str], bool]

# The multipliers and rounding terms of the transforms and of the colour conversions below are fixed values of the format and of the encoder's dumps.
_EVEN, _ODD, _EDGE = "({0} + {3} + {1} + {2})", "({1} - {2})", "({0} - {3})"
_WALSH = ["({0} + {2}) + ({1} + {3})", "({0} - {2}) + ({1} - {3})", "({0} - {2}) - ({1} - {3})", "({0} + {2}) - ({1} + {3})"]
_BACK = ["({0} + {3}) + ({1} + {2})", "({1} - {2}) + ({0} - {3})", "({0} + {3}) - ({1} + {2})", "({0} - {3}) - ({1} - {2})"]
_SINE, _GROWN = "shiftright({%d} * 35468, 16)", "({%d} + shiftright({%d} * 20091, 16))"
_CROSS, _STRAIGHT = f"({_SINE % 1} - {_GROWN % (3, 3)})", f"({_GROWN % (1, 1)} + {_SINE % 3})"
_TURNED = ["({0} + {2}) + " + _STRAIGHT, "({0} - {2}) + " + _CROSS, "({0} - {2}) - " + _CROSS, "({0} + {2}) - " + _STRAIGHT]
_DCT_ROWS = [
    f"{_EVEN} * 8",
    f"shiftright({_ODD} * 2217 + {_EDGE} * 5352 + 1812, 9)",
    "({0} + {3} - {1} - {2}) * 8",
    f"shiftright({_EDGE} * 2217 - {_ODD} * 5352 + 937, 9)",
]
_DCT_COLUMNS = [
    f"shiftright({_EVEN} + 7, 4)",
    f"shiftright({_ODD} * 2217 + {_EDGE} * 5352 + 12000, 16) + IF({_EDGE} <> 0, 1L, 0L)",
    "shiftright({0} + {3} - {1} - {2} + 7, 4)",
    f"shiftright({_EDGE} * 2217 - {_ODD} * 5352 + 51000, 16)",
]
_HADAMARD = ["({0} + {3}) + ({1} + {2})", "({0} - {3}) + ({1} - {2})", "({0} + {3}) - ({1} + {2})", "({0} - {3}) - ({1} - {2})"]
FORWARD_DCT: list[Pass] = [(_DCT_ROWS, True), (_DCT_COLUMNS, False)]
INVERSE_DCT: list[Pass] = [(_TURNED, False), ([f"shiftright({x} + 4, 3)" for x in _TURNED], True)]
FORWARD_WHT: list[Pass] = [(_WALSH, True), ([f"shiftright({x}, 1)" for x in _WALSH], False)]
INVERSE_WHT: list[Pass] = [(_BACK, False), ([f"shiftright({x} + 3, 3)" for x in _BACK], True)]
HADAMARD: list[Pass] = [(_HADAMARD, True), (_HADAMARD, False)]


def passed(column: str, rules: Sequence[str], rows: bool) -> Column:
    """A 4x4 block after one pass, as one expression: made of text, as thousands of small columns take the driver longer than the engine takes for the work."""
    lines = [[r.format(*(f"{column}[{4 * i + j if rows else 4 * j + i}]" for j in range(4))) for r in rules] for i in range(4)]
    return F.expr(f"array({', '.join(lines[i][j] if rows else lines[j][i] for i in range(4) for j in range(4))})")


def total(values) -> Column:
    values = list(values)
    while len(values) > 1:  # a balanced tree keeps the expression shallow
        values = [values[i] + values[i + 1] if i + 1 < len(values) else values[i] for i in range(0, len(values), 2)]
    return values[0]


def quantized(value: Column, step: Column | int) -> Column:
    """To the nearest multiple, halves away from zero."""
    step = step if isinstance(step, Column) else F.lit(step).cast("long")
    size = F.floor((F.abs(value) + F.shiftright(step, 1)) / step)
    return F.when(step <= 0, F.lit(0).cast("long")).otherwise(clip(F.when(value < 0, -size).otherwise(size), -32768, 32767))


def deadzone(value: Column, step: Column | int, percent: int = 60) -> Column:
    """``quantized``, with magnitudes under a share of the step as zero."""
    step = step if isinstance(step, Column) else F.lit(step).cast("long")
    return F.when(F.abs(value) * 100 < step * percent, F.lit(0).cast("long")).otherwise(quantized(value, step))


def token_class(magnitude: Column) -> Column:
    """0 to 4: that magnitude; 5 to 10: a category with extra bits."""
    return F.when(magnitude <= 4, magnitude).when(magnitude <= 6, 5).when(magnitude <= 10, 6).when(magnitude <= 18, 7).when(magnitude <= 34, 8).when(magnitude <= 66, 9).otherwise(10).cast("long")


def log2_q8(value: Column) -> Column:
    """log2 in 256ths, straight between powers of two, for 1 to 256."""
    whole = F.length(F.bin(value)).cast("long") - 1
    lead = F.pow(F.lit(2), whole).cast("long")
    return F.when(value <= 0, 0).when(value >= 256, 2048).otherwise(whole * 256 + F.floor((value - lead) * 256 / lead)).cast("long")


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(77 * r + 150 * g + 29 * b + 128, 8)


def rgb_to_yuv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Video-range luma, and chroma of four equal samples."""
    y = F.shiftright(16839 * r + 33059 * g + 6420 * b + 32768 + (16 << 16), 16)
    chroma = lambda v: clip(F.shiftright(4 * v + (1 << 17) + (128 << 18), 18), 0, 255)
    return y, chroma(-9719 * r - 19081 * g + 28800 * b), chroma(28800 * r - 24116 * g - 4684 * b)


def yuv_to_rgb(y: Column, u: Column, v: Column) -> tuple[Column, Column, Column]:
    high = lambda x, c: F.shiftright(x * c, 8)
    out = lambda x: clip(F.shiftright(x, 6), 0, 255)
    base = high(y, 19077)
    return out(base + high(v, 26149) - 14234), out(base - high(u, 6419) - high(v, 13320) + 8708), out(base + high(u, 33050) - 17685)


def psnr(sse: Column, n: int) -> Column:
    return F.when(sse == 0, F.lit(float("inf"))).otherwise(10 * F.log10(F.lit(255.0 * 255.0) / (sse / n)))


def fnv1a(values: Column) -> Column:
    """64-bit FNV-1a from 1469598103934665603 over each value's four little-endian bytes, as 16 hex digits; two halves of 32 bits stand in for 64."""
    mask, low_prime = 0xFFFFFFFF, 0x1B3
    start = 1469598103934665603

    def feed(state: Column, byte: Column) -> Column:
        low = state["low"].bitwiseXOR(byte) * low_prime
        high = state["high"] * low_prime + F.shiftleft(state["low"].bitwiseXOR(byte), 8) + F.shiftright(low, 32)
        return F.struct(high.bitwiseAND(mask).alias("high"), low.bitwiseAND(mask).alias("low"))

    bytes_ = F.flatten(F.transform(values, lambda v: F.array(*(F.shiftright(v, s).bitwiseAND(255) for s in (0, 8, 16, 24)))))
    first = F.struct(F.lit(start >> 32).cast("long").alias("high"), F.lit(start & mask).cast("long").alias("low"))
    return F.aggregate(bytes_, first, feed, lambda s: F.lower(F.concat(F.lpad(F.hex(s["high"]), 8, "0"), F.lpad(F.hex(s["low"]), 8, "0"))))


def adler32(values: Column) -> Column:
    start = F.struct(F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    return F.aggregate(values, start, lambda s, v: F.struct(((s["a"] + v) % 65521).alias("a"), ((s["b"] + s["a"] + v) % 65521).alias("b")), lambda s: s["b"] * 65536 + s["a"])


def little_endian(n: Column, size: int = 4) -> Column:
    return F.unhex(F.concat(*(F.lpad(F.hex(F.shiftright(n, 8 * i).bitwiseAND(255)), 2, "0") for i in range(size))))


def load_little_endian(data: Column, at_byte: int, size: int = 4) -> Column:
    """An unsigned number from ``size`` bytes, counted from 1."""
    return total(F.conv(F.hex(F.substring(data, at_byte + i, 1)), 16, 10).cast("long") * (1 << 8 * i) for i in range(size))


def riff_wrapped(payload: Column) -> Column:
    """A RIFF file with one VP8 chunk, padded to even size."""
    n = F.octet_length(payload).cast("long")
    pad = F.when(n % 2 == 1, F.unhex(F.lit("00"))).otherwise(F.lit("").cast("binary"))
    word = lambda s: F.lit(s).cast("binary")
    return F.concat(word("RIFF"), little_endian(12 + n + n % 2), word("WEBPVP8 "), little_endian(n), payload, pad)
