"""Distances and labels as Column expressions over token arrays, slot maps and slot rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.functions.lexicon import N_SLOTS, SLOT_NAMES

#: Fixed values.
PAD = 32
PENALTY = 200
NO_SHARED = 9999.0
MISMATCH = 30.0


def half_even(c: Column, digits: int) -> Column:
    """Rounds as Python does, up to the last bit."""
    return F.bround(c, digits)


def _fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def semantic_distance(a: Column, b: Column) -> Column:
    """Mean difference of two token arrays, the shorter padded; null for two empty arrays."""
    gaps = F.zip_with(a, b, lambda x, y: F.abs(F.coalesce(x, F.lit(PAD)) - F.coalesce(y, F.lit(PAD))).cast("double"))
    return half_even(F.try_divide(_fold(gaps), F.size(gaps).cast("double")), 4)


def _bands(d: Column, limits: list[float], names: list[str]) -> Column:
    out = F.when(d <= limits[0], names[0])
    for limit, name in zip(limits[1:], names[1:], strict=False):
        out = out.when(d <= limit, name)
    return out.otherwise(names[-1])


#: The names of the bands, nearest first.
BANDS = ["Nearly identical", "Very similar", "Related topic", "Different topic", "Completely unrelated"]


def semantic_label(d: Column) -> Column:
    return _bands(d, [5, 20, 100, 500], BANDS)


def blueprint_distance(a: Column, b: Column, penalty: int = PENALTY) -> Column:
    """Mean over the union of slots; a slot of one side only costs the penalty; 0 for two empty maps."""
    merged = F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.when(x.isNull() | y.isNull(), F.lit(float(penalty))).otherwise(F.abs(x - y).cast("double"))))
    return F.coalesce(half_even(F.try_divide(_fold(merged), F.size(merged).cast("double")), 4), F.lit(0.0))


def blueprint_label(d: Column) -> Column:
    return _bands(d, [10, 50, 150, 350], BANDS)


def slot_row(blueprint: Column) -> Column:
    """Slot-sorted (slot, value) pairs; value 0 and slots out of range drop out."""
    pairs = F.filter(F.map_entries(blueprint), lambda e: (e["value"] != 0) & (e["key"] < N_SLOTS))
    return F.array_sort(F.transform(pairs, lambda e: F.struct(e["key"].alias("slot"), e["value"].alias("value"))))


def signature(row: Column) -> Column:
    """Bit mask of the filled slots."""
    return F.aggregate(row, F.lit(0), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", F.lit(1), x["slot"])))


def shared_slots(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseAND(b))


def slot_names(blueprint: Column) -> Column:
    names = F.create_map(*[x for k, name in enumerate(SLOT_NAMES) for x in (F.lit(k), F.lit(name))])
    return F.transform_keys(blueprint, lambda k, _: F.coalesce(F.try_element_at(names, k), k.cast("string")))


def row_distance(n_shared: Column, total_gap: Column, min_shared: int = 2) -> Column:
    """Mean over shared slots from their count and summed difference; the sentinel below min_shared."""
    return F.when(n_shared >= min_shared, total_gap / F.greatest(n_shared, F.lit(1))).otherwise(F.lit(NO_SHARED))


def weighted_distance(n_shared: Column, weighted_gap: Column, weight: Column, sig_a: Column, sig_b: Column, weight_a: Column, weight_b: Column, mismatch: float = MISMATCH, min_shared: int = 1) -> Column:
    """Weighted mean over shared slots, divided by the harmonic mean of the clamped weights, plus the share of one-sided slots."""
    wa, wb = (F.greatest(F.lit(0.5), F.least(w, F.lit(5.0))) for w in (weight_a, weight_b))
    shared = F.coalesce(F.try_divide(weighted_gap, weight), F.lit(0.0)) / (2 * wa * wb / (wa + wb))
    union = F.bit_count(sig_a.bitwiseOR(sig_b))
    apart = F.coalesce(F.try_divide(F.bit_count(sig_a.bitwiseXOR(sig_b)).cast("double"), union.cast("double")), F.lit(0.0))
    return F.when(n_shared >= min_shared, half_even(shared + apart * mismatch, 4)).otherwise(F.lit(NO_SHARED))
