"""Scalar column expressions: all of them stay inside whole-stage code."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTINEL = 255


def missing(c: Column) -> Column:
    """NaN and null as null."""
    return F.when(~F.isnan(c), c)


def with_sentinel(c: Column, sentinel: int = SENTINEL) -> Column:
    """A label as a small integer, NaN and null as the sentinel."""
    return F.coalesce(missing(c).cast("smallint"), F.lit(sentinel).cast("smallint"))


def without_sentinel(c: Column, sentinel: int = SENTINEL) -> Column:
    return F.when(c != sentinel, c)


def finite(c: Column) -> Column:
    """NaN and both infinities as null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def finite_array(c: Column) -> Column:
    return F.transform(c, finite)


def close(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    return F.abs(a - b) <= tolerance


def quadrature(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def code_of(value: Column, vocabulary: Sequence) -> Column:
    """Position of a value in a vocabulary whose last entry stands for all other values and null."""
    lookup = F.create_map(*(F.lit(x) for i, v in enumerate(vocabulary[:-1]) for x in (v, i)))
    return F.coalesce(F.try_element_at(lookup, value), F.lit(len(vocabulary) - 1))


def index_or_last(items: Column, value: Column) -> Column:
    """Position of a value in an array, the last position where it is absent or null."""
    at = F.array_position(items, value)
    return F.when(at > 0, at - 1).otherwise(F.size(items) - 1)


def mapped(value: Column, table: Mapping, default) -> Column:
    lookup = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.coalesce(F.try_element_at(lookup, value), F.lit(default))


def tag_in_brackets(smiles: Column) -> Column:
    """A bare tag atom with its brackets."""
    return F.regexp_replace(smiles, r"(?<!\[)Dy", "[Dy]")


def tag_as_carbon(smiles: Column) -> Column:
    return F.replace(smiles, F.lit("[Dy]"), F.lit("[C]"))


def unpack_bits(c: Column, width: int, total: int = 8) -> Column:
    """The ``total // width`` fields of ``width`` bits of an integer, lowest first."""
    mask = (1 << width) - 1
    return F.transform(F.sequence(F.lit(0), F.lit(total - width), F.lit(width)), lambda k: F.call_function("shiftright", c.cast("int"), k).bitwiseAND(F.lit(mask)))


def tanimoto(both: Column, a: Column, b: Column) -> Column:
    """Shared over all bits from the two counts and the shared count; 0 for two empty sets."""
    union = a + b - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def recode_hops(d: Column, same: Column) -> Column:
    """Hops as the attention layer reads them: self 0, unreachable -1, d as d + 1."""
    return F.when(same, 0).when(d < 0, -1).otherwise(d + 1)


def bucket_hops(d: Column, most: int) -> Column:
    """Bias bucket of a recoded distance: unreachable is the pad bucket, far ones share the last."""
    return F.when(d < 0, most + 2).otherwise(F.least(d, F.lit(most + 1)))


def attention_mask(d: Column) -> Column:
    """0 where a key can be attended to, minus infinity where it is unreachable."""
    return F.when(d < 0, float("-inf")).otherwise(0.0)


SOFTPLUS_0 = math.log(2)


def gaussian_kernels(distance: Column, kernels: int = 128, low: float = 0.0, high: float = 10.0, sigma: float = SOFTPLUS_0) -> Column:
    """The distance under Gaussian kernels with evenly spaced means; a whole array per distance."""
    step = (high - low) / (kernels - 1)
    scale = -1 / math.sqrt(2 * math.pi * sigma)
    return F.transform(F.sequence(F.lit(0), F.lit(kernels - 1)), lambda k: scale * F.exp(-0.5 * F.pow(distance - (low + k * step), 2) / sigma))


def electronegativity_code(mean: Column, middle: float = 2.5, step: float = 0.05, bins: int = 11) -> Column:
    """Bin of a ring's mean electronegativity, half-way values to the even bin; outside the bins the last code."""
    code = F.bround((mean - middle) / step, 0)
    inside = (code >= 0) & (code < bins)
    return F.when(inside, code.cast("int")).otherwise(F.lit(bins))


def learning_rate_factor(epoch: Column, warmup: int, total: int, lowest: float) -> Column:
    """Linear warm-up to 1, then linear decay to ``lowest``."""
    up = (epoch + 1) / warmup
    down = 1 - (1 - lowest) * (epoch - warmup) / max(1, total - warmup)
    return F.when(epoch < warmup, up).otherwise(F.greatest(down, F.lit(lowest)))


def hashed_uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the key and the seed only: the same on every engine and in every partition."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string"))), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def hashed_normal(key: Column, seed: int) -> Column:
    """A standard normal number from two hashed uniform ones."""
    return F.sqrt(-2 * F.ln(hashed_uniform(key, seed))) * F.cos(2 * math.pi * hashed_uniform(key, seed + 1))


def one_hot_labels(category: Column, label: Column, categories: Sequence[str]) -> Column:
    """The label at the place of its category, 0 elsewhere."""
    return F.array(*(F.when(category == c, label).otherwise(0).cast("int") for c in categories))


def shingle_bits(text: Column, size: int = 6, width: int = 2048) -> Column:
    """Sorted set bits of a text's runs of ``size`` characters, hashed to ``width``; a shorter text sets the bit of itself."""
    run = lambda k: F.conv(F.substring(F.md5(F.substr(text, k, F.lit(size))), 1, 6), 16, 10).cast("int") % width
    return F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (size - 1), F.lit(1))), run)))
