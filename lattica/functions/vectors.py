"""Arithmetic on array columns, for scores over embeddings. For bulk work see operators.ranking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: x / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def _halves(a: Column, width: int) -> tuple[Column, Column]:
    return F.slice(a, 1, width), F.slice(a, width + 1, width)


def transe_score(h: Column, r: Column, t: Column) -> Column:
    """Negative distance of h + r from t, entities of unit length."""
    gap = F.zip_with(F.zip_with(unit(h), r, lambda x, y: x + y), unit(t), lambda x, y: x - y)
    return -norm(gap)


def complex_score(h: Column, r: Column, t: Column, width: int) -> Column:
    """Real part of the trilinear product with the conjugate of t; the halves are real and imaginary parts."""
    (hr, hi), (rr, ri), (tr, ti) = _halves(h, width), _halves(r, width), _halves(t, width)
    prod = lambda x, y: F.zip_with(x, y, lambda a, b: a * b)
    return dot(prod(hr, rr), tr) + dot(prod(hi, rr), ti) + dot(prod(hr, ri), ti) - dot(prod(hi, ri), tr)


def rotate_score(h: Column, phase: Column, t: Column, width: int) -> Column:
    """Negative sum of the moduli of h turned by the phases, less t."""
    (hr, hi), (tr, ti) = _halves(h, width), _halves(t, width)
    cos, sin = F.transform(phase, F.cos), F.transform(phase, F.sin)
    index = F.sequence(F.lit(0), F.lit(width - 1))

    def modulus(i: Column) -> Column:
        re = F.get(hr, i) * F.get(cos, i) - F.get(hi, i) * F.get(sin, i) - F.get(tr, i)
        im = F.get(hr, i) * F.get(sin, i) + F.get(hi, i) * F.get(cos, i) - F.get(ti, i)
        return F.sqrt(re * re + im * im + 1e-9)

    return -F.aggregate(F.transform(index, modulus), F.lit(0.0), lambda acc, x: acc + x)


def margin_loss(positive: Column, negative: Column, margin: float = 1.0) -> Column:
    return F.greatest(F.lit(0.0), margin - positive + negative)


def log_sigmoid(x: Column) -> Column:
    return -(F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))))


def adversarial_loss(positive: Column, negatives: Column, gamma: float, temperature: float = 1.0) -> Column:
    """Self-adversarial loss of one positive score and the array of its negatives' scores."""
    miss = F.transform(negatives, lambda s: -log_sigmoid(-(gamma + s)))
    if temperature > 0:
        top = F.array_max(negatives)
        raw = F.transform(negatives, lambda s: F.exp(temperature * (s - top)))
        total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
        weighted = dot(raw, miss) / total
    else:
        weighted = F.aggregate(miss, F.lit(0.0), lambda a, x: a + x) / F.size(negatives)
    return (-log_sigmoid(gamma + positive) + weighted) / 2


# Boxes: arrays of x0, y0, x1, y1


def box_crop(a: Column, b: Column) -> Column:
    """The box that two boxes share; null if they share none."""
    low = [F.greatest(F.get(a, i), F.get(b, i)) for i in (0, 1)]
    high = [F.least(F.get(a, i), F.get(b, i)) for i in (2, 3)]
    return F.when((low[0] < high[0]) & (low[1] < high[1]), F.array(*low, *high))


def box_area(a: Column) -> Column:
    return F.greatest(F.get(a, 2) - F.get(a, 0), F.lit(0.0)) * F.greatest(F.get(a, 3) - F.get(a, 1), F.lit(0.0))


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where both are empty."""
    shared = F.coalesce(box_area(box_crop(a, b)), F.lit(0.0))
    return F.coalesce(F.try_divide(shared, box_area(a) + box_area(b) - shared), F.lit(0.0))
