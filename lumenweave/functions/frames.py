"""Frame headers, predictors and filters as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenweave.functions.blocks import clip, load_little_endian, total

#: Fixed value: the three bytes that follow a key frame's tag.
START_CODE = "9D012A"
#: The ten 4x4 predictors by number (RFC 6386, section 12.3).
SUBBLOCK_MODES = ("dc", "tm", "ve", "he", "ld", "rd", "vr", "vl", "hd", "hu")


def keyframe_header(data: Column) -> Column:
    """Tag, sizes and scales of a key frame, and what is wrong with it (null: nothing)."""
    tag, width, height = load_little_endian(data, 1, 3), load_little_endian(data, 7, 2), load_little_endian(data, 9, 2)
    first = F.shiftright(tag, 5)
    error = (
        F.when(F.octet_length(data) < 10, "short")
        .when(tag % 2 == 1, "not a key frame")
        .when(F.hex(F.substring(data, 4, 3)) != START_CODE, "start code")
        .when((width % 16384 == 0) | (height % 16384 == 0), "size")
        .when(first > F.octet_length(data) - 10, "partition")
    )
    return F.struct(
        F.shiftright(tag, 1).bitwiseAND(7).alias("profile"),
        F.shiftright(tag, 4).bitwiseAND(1).alias("shown"),
        first.alias("first_partition"),
        (width % 16384).alias("width"),
        (height % 16384).alias("height"),
        F.shiftright(width, 14).alias("x_scale"),
        F.shiftright(height, 14).alias("y_scale"),
        error.alias("error"),
    )


def taps(line: Column) -> tuple[Column, Column]:
    """Means of two and weighted means of three neighbours along a line of thirteen samples, as arrays; the line's ends stand for what lies beyond them."""
    i, last = F.sequence(F.lit(0), F.lit(12)), F.lit(12)
    own = lambda k: F.get(line, F.greatest(F.lit(0), F.least(last, k)))
    return F.transform(i, lambda k: F.shiftright(own(k) + own(k + 1) + 1, 1)), F.transform(i, lambda k: F.shiftright(own(k - 1) + 2 * own(k) + own(k + 1) + 2, 2))


def subblock_predictions(line: Column, two_: Column, three_: Column) -> list[Column]:
    """4x4 samples, as an array, of each of the ten modes. The samples around the block are one ``line``, from the lowest of four left ones over the corner to the
    last of eight above; ``two_`` and ``three_`` are its ``taps``, best given as columns so that they are computed once a row.

    But for two modes, a prediction is a mean of two or a weighted mean of three around a place that moves along the mode's direction.
    """
    two, three = lambda i: two_[i], lambda i: three_[i]
    left, above, corner = [line[3 - i] for i in range(4)], [line[5 + i] for i in range(8)], line[4]
    mean = F.shiftright(total(above[:4] + left) + 4, 3)

    def right_of_vertical(y: int, x: int) -> Column:
        if x < y // 2:
            return three(5 - y)
        return (three if y % 2 else two)(4 + x - y // 2)

    def left_of_vertical(y: int, x: int) -> Column:
        if x == 3 and y > 1:
            return three(8 + y)
        return three(6 + x + y // 2) if y % 2 else two(5 + x + y // 2)

    def down_from_left(y: int, x: int) -> Column:
        k = 2 * (3 - y) + x
        return three(k - 3) if k > 7 else three((k + 1) // 2) if k % 2 else two(k // 2)

    def up_from_left(y: int, x: int) -> Column:
        k = 2 * y + x
        return left[3] if k > 5 else three(2 - k // 2) if k % 2 else two(2 - k // 2)

    rules = {
        "dc": lambda y, x: mean,
        "tm": lambda y, x: clip(left[y] + above[x] - corner, 0, 255),
        "ve": lambda y, x: three(5 + x),
        "he": lambda y, x: three(3 - y),
        "ld": lambda y, x: three(6 + y + x),
        "rd": lambda y, x: three(4 - y + x),
        "vr": right_of_vertical,
        "vl": left_of_vertical,
        "hd": down_from_left,
        "hu": up_from_left,
    }
    return [F.array(*(rules[mode](y, x) for y in range(4) for x in range(4))) for mode in SUBBLOCK_MODES]


def upsampled(chroma: Column, side: int, y: Column, x: Column) -> Column:
    """The sample at (y, x) of a plane of ``side`` by ``side`` doubled both ways: nine, three, three and one parts of the four nearest, rounded twice."""

    def beside(v: Column) -> Column:
        own = F.shiftright(v, 1)
        return F.greatest(F.lit(0), F.least(F.lit(side - 1), own + F.when(v % 2 == 1, 1).otherwise(-1)))

    sample = lambda r, c: F.get(chroma, r * side + c)
    near, side_x, side_y, far = (sample(r, c) for r in (F.shiftright(y, 1), beside(y)) for c in (F.shiftright(x, 1), beside(x)))
    return F.shiftright(F.shiftright(near + far + 8 + 3 * (side_x + side_y), 3) + near, 1)


def filter_level(frame: Column, segment: Column, absolute: Column, reference: Column, mode: Column) -> Column:
    """A macroblock's filter level of 0 to 63: the frame's, moved or replaced by its segment's, then moved by the deltas; null means none."""
    base = clip(F.when(segment.isNull(), frame).when(absolute, segment).otherwise(frame + segment), 0, 63)
    return F.when(reference.isNull() & mode.isNull(), base).otherwise(clip(base + F.coalesce(reference, F.lit(0)) + F.coalesce(mode, F.lit(0)), 0, 63))


def filter_limits(level: Column, sharpness: Column) -> tuple[Column, Column]:
    """Interior limit and high-variance threshold of a filter level of 0 to 63."""
    reduced = F.when(sharpness > 4, F.shiftright(level, 2)).when(sharpness > 0, F.shiftright(level, 1)).otherwise(level)
    capped = F.when(sharpness > 0, F.least(reduced, 9 - sharpness)).otherwise(reduced)
    return F.greatest(capped, F.lit(1).cast("long")), F.when(level >= 40, 2).when(level >= 15, 1).otherwise(0)


def filtered_edge(p1: Column, p0: Column, q0: Column, q1: Column, limit: int) -> tuple[Column, Column]:
    """The two samples at an edge after the simple loop filter; samples that differ by more than the limit stay."""
    small = lambda v: clip(v, -128, 127)
    step = small(small(p1 - q1) + 3 * (q0 - p0))
    smooth = F.abs(p0 - q0) * 2 + F.shiftright(F.abs(p1 - q1), 1) <= limit
    moved = lambda v, by: small(v - 128 + by) + 128
    down, up = F.shiftright(small(step + 4), 3), F.shiftright(small(step + 3), 3)
    return F.when(smooth, moved(p0, up)).otherwise(p0), F.when(smooth, moved(q0, -down)).otherwise(q0)


def edge_kind(line: list[Column], edge: Column, interior: Column, variance: Column) -> Column:
    """What the normal loop filter does at an edge between the fourth and fifth of eight samples: skip, smooth, or sharp where the variance is high."""
    p3, p2, p1, p0, q0, q1, q2, q3 = line
    far = lambda a, b, limit: F.abs(a - b) > limit
    rough = F.abs(p0 - q0) * 2 + F.shiftright(F.abs(p1 - q1), 1) > 2 * edge + interior
    for a, b in ((p3, p2), (p2, p1), (p1, p0), (q3, q2), (q2, q1), (q1, q0)):
        rough = rough | far(a, b, interior)
    return F.when(rough, "skip").when(far(p1, p0, variance) | far(q1, q0, variance), "sharp").otherwise("smooth")
