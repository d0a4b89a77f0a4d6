"""Expressions on arrays of stops and on route texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with the value computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def collapse_runs(array: Column) -> Column:
    """The array without elements equal to the one before."""
    return let(array, lambda a: F.filter(a, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(a, i - 1))))


def ordered(key: Column, value: Column) -> Column:
    """Aggregate: the values as an array in the order of key, which should be unique."""
    return F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), value.alias("v")))), lambda s: s["v"])


def parse_route(text: Column) -> Column:
    """array<struct<stop_id, minutes>> of "(142, '19:30:00'), ..." in either quoting; empty if nothing fits."""
    pattern = r"\((\d+),\s*'?(\d{1,2}):(\d{2}):(\d{2})'?\)"
    stops = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = lambda s, i: F.regexp_extract(s, pattern, i).cast("double")
    return F.transform(stops, lambda s: F.struct(F.regexp_extract(s, pattern, 1).cast("int").alias("stop_id"), (part(s, 2) * 60 + part(s, 3) + part(s, 4) / 60).alias("minutes")))


def unwrap_midnight(minutes: Column) -> Column:
    """Times of day made to rise: 1440 is added whenever one is before the last."""
    zero = F.struct(F.array().cast("array<double>").alias("out"), F.lit(0.0).alias("shift"), F.lit(None).cast("double").alias("last"))

    def step(acc: Column, m: Column) -> Column:
        shift = acc["shift"] + F.when(m + acc["shift"] < acc["last"], 1440.0).otherwise(0.0)
        return F.struct(F.concat(acc["out"], F.array(m + shift)).alias("out"), shift.alias("shift"), (m + shift).alias("last"))

    return F.aggregate(minutes, zero, step, lambda acc: acc["out"])


def rises(values: Column) -> Column:
    """Whether no element is less than the one before."""
    return let(values, lambda a: F.size(F.filter(a, lambda x, i: (i > 0) & (x < F.get(a, i - 1)))) == 0)


#: Templates up to this length have their row of the table in the bits of a long.
_BITS = 62


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, folded over a.

    The row of the table that belongs to an element of a is kept as differences of neighbours, one
    bit for each element of b; longer b have it in chunks' place as an array of numbers.
    """
    return F.when(F.size(b) <= _BITS, _lcs_bits(a, b)).otherwise(_lcs_cells(a, b))


def _lcs_bits(a: Column, b: Column) -> Column:
    full = F.call_function("shiftleft", F.lit(1).cast("long"), F.size(b)) - 1
    one = F.lit(1).cast("long")

    def step(v: Column, x: Column) -> Column:
        places = F.aggregate(b, F.struct(F.lit(0).cast("long").alias("m"), one.alias("p")), lambda acc, y: F.struct(F.when(y.eqNullSafe(x), acc["m"] + acc["p"]).otherwise(acc["m"]).alias("m"), (acc["p"] * 2).alias("p")), lambda acc: acc["m"])
        return let(v.bitwiseAND(places), lambda u: ((v + u).bitwiseOR(v - u)).bitwiseAND(full))

    return F.aggregate(a, full, step, lambda v: F.size(b) - F.bit_count(v))


def _lcs_cells(a: Column, b: Column) -> Column:
    zeros = F.concat(F.array(F.lit(0)), F.transform(b, lambda _: F.lit(0)))

    def row(prev: Column, x: Column) -> Column:
        def cell(acc: Column, j: Column) -> Column:
            same = F.get(b, j - 1).eqNullSafe(x)
            value = F.when(same, F.get(prev, j - 1) + 1).otherwise(F.greatest(F.get(prev, j), F.element_at(acc, -1)))
            return F.concat(acc, F.array(value))

        return F.aggregate(F.sequence(F.lit(1), F.size(b)), F.array(F.lit(0)), cell)

    return F.aggregate(a, zeros, row, lambda last: F.element_at(last, -1))


def longest_rise(values: Column) -> Column:
    """Length of the longest non-decreasing subsequence: tails[k] is the least end of one of length k + 1."""
    def step(tails: Column, x: Column) -> Column:
        keep = F.filter(tails, lambda t: t <= x)
        return F.concat(keep, F.array(x), F.slice(tails, F.size(keep) + 2, F.greatest(F.lit(0), F.size(tails) - F.size(keep) - 1)))

    return F.aggregate(values, F.array().cast("array<int>"), step, lambda t: F.size(t))


def monotone_share(values: Column) -> Column:
    """longest_rise over the length; 0.5 under two elements."""
    return F.when(F.size(values) < 2, F.lit(0.5)).otherwise(longest_rise(values) / F.size(values))


def positions(observed: Column, template: Column) -> Column:
    """0-based places in template of the observed stops that it has."""
    return F.filter(F.transform(observed, lambda s: (F.array_position(template, s) - 1).cast("int")), lambda p: p >= 0)


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def stop_list(text: Column) -> Column:
    """array<int> of a JSON list of stops; null for anything else."""
    return F.from_json(text, "array<int>")


def schedule_list(text: Column) -> Column:
    """array<double> of a JSON list of minutes, empty for null."""
    return F.coalesce(F.from_json(text, "array<double>"), F.array().cast("array<double>"))
