"""Sample and level vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SAMPLE_MIN, SAMPLE_MAX = -32768, 32767


def _int(value: Column) -> Column:
    return value.cast("bigint")


def saturate(value: Column) -> Column:
    """Clamp to a 16-bit sample."""
    return F.greatest(F.least(value, F.lit(SAMPLE_MAX)), F.lit(SAMPLE_MIN))


def _weighted(vector: Column, weight: Column) -> Column:
    return F.transform(vector, lambda x: F.shiftright(_int(x) * weight, 16))


def mix(vectors: list[Column], weights: list[Column] | None = None) -> Column:
    """Weighted sum per position, saturated; a weight of 65536 is one and zero mutes."""
    scaled = vectors
    if weights is not None:
        scaled = [_weighted(v, w) for v, w in zip(vectors, weights)]
    acc = scaled[0]
    for other in scaled[1:]:
        acc = F.zip_with(acc, other, lambda a, b: _int(a) + _int(b))
    return F.transform(acc, saturate)


def mix_pair(a: Column, b: Column) -> Column:
    """``a + b - ab/32767``, the product's sign turned when both are negative; saturated."""

    def one(x, y):
        both = (x < 0) & (y < 0)
        bend = x * y / F.lit(float(SAMPLE_MAX))
        whole = x + y - F.when(both, -bend).otherwise(bend)
        # Stored in an integer sample: the fraction is cut towards zero.
        return saturate(whole.cast("bigint"))

    return F.zip_with(a, b, one)


def interleave(channels: list[Column]) -> Column:
    """One frame after another: first sample of every channel, then the second."""
    return F.flatten(
        F.transform(channels[0], lambda _, i: F.array(*[F.get(c, i) for c in channels]))
    )


def deinterleave(samples: Column, channels: int, index: int) -> Column:
    return F.filter(samples, lambda x, i: (i % channels) == index)


def to_stereo(mono: Column) -> Column:
    return F.flatten(F.transform(mono, lambda x: F.array(x, x)))


def to_mono(stereo: Column) -> Column:
    """Mean of each pair, cut towards zero."""
    left, right = deinterleave(stereo, 2, 0), deinterleave(stereo, 2, 1)
    return F.zip_with(left, right, lambda a, b: ((a + b) / 2).cast("bigint"))


def average(levels: Column) -> Column:
    """Mean level by integer division; levels are not negative."""
    total = F.aggregate(levels, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.floor(total / F.size(levels))


def merge(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.greatest(x, y))


def scale(levels: Column, target: int) -> Column:
    """Bring the largest level to ``target`` keeping ratios; all zero becomes all target."""
    top = F.array_max(levels)
    goal = F.lit(target).cast("bigint")
    # Levels are not negative, so the quotient rounds down; a double would lose digits above 2^53.
    return F.transform(
        levels,
        lambda x: F.when(top <= 0, goal).otherwise(F.call_function("div", x * goal, top)),
    )


# Positions of a level vector and the side each is on.
SIDES = {
    "front-left": "left", "rear-left": "left", "side-left": "left",
    "front-left-of-center": "left", "top-front-left": "left", "top-rear-left": "left",
    "front-right": "right", "rear-right": "right", "side-right": "right",
    "front-right-of-center": "right", "top-front-right": "right", "top-rear-right": "right",
    "front-center": "center", "rear-center": "center", "top-center": "center",
    "top-front-center": "center", "top-rear-center": "center", "mono": "center",
    "lfe": "lfe",
}


def remap(levels: Column, source: list[str], target: list[str]) -> Column:
    """Levels for another layout: mean of equal positions, else of the side, else of all."""
    if source == target:
        return levels

    def mean_of(indexes):
        picked = [F.get(levels, F.lit(i)) for i in indexes]
        return F.floor(sum(picked[1:], picked[0]) / len(picked))

    out = []
    for place in target:
        same = [i for i, p in enumerate(source) if p == place]
        side = SIDES.get(place)
        near = [i for i, p in enumerate(source) if side and SIDES.get(p) == side]
        out.append(mean_of(same or near or range(len(source))))
    return F.array(*out)
