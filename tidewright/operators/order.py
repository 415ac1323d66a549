"""Positions and running totals over all rows without one task that sees them all.

A window without a partition key sends every row to one task. Here rows are dealt into cells that follow the
order (ranges of a digest, or of a column's approximate percentiles), each cell is numbered alone, and
the cells' small table of counts or sums gives every cell its offset."""

from __future__ import annotations

from math import sin

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells for each group.
CELLS = 4096


def digest(key: Column, seed: int) -> Column:
    """48 bits of md5('seed:key'): a pseudo-random number that any SQL engine can repeat."""
    return F.conv(F.substr(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary")), F.lit(1), F.lit(12)), 16, 10).cast("long")


# md5's constants (RFC 1321) and all ends of five digits.
_SINES = [int(abs(sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [r for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for r in 4 * four]
_WORDS = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]
_FIRST = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_ENDS = (np.arange(100_000)[:, None] // 10 ** np.arange(4, -1, -1) % 10 + 48).astype(np.uint8)


def digests(before: str, start: int, stop: int) -> np.ndarray:
    """48 bits of the md5 of ``before`` and a number, for all numbers from start until before stop: what digest() gives for them, by
    arrays. The texts must be shorter than 56 letters of ASCII."""
    out, at = np.empty(stop - start, np.int64), start
    while at < stop:
        # Numbers of as many digits that differ in the last five at most, few enough for a processor's cache.
        width = min(5, len(str(at)))
        end = min(stop, at + 25_000, at - at % 10**width + 10**width)
        head = f"{before}{at // 100_000 if at >= 100_000 else ''}".encode()
        size = len(head) + width
        text = np.zeros(64, np.uint8)
        text[: len(head)], text[size], text[56:] = list(head), 128, list((8 * size).to_bytes(8, "little"))
        words, first, last = text.view("<u4").tolist(), len(head) // 4, (size + 3) // 4
        differ = np.tile(text[4 * first : 4 * last], (end - at, 1))
        differ[:, len(head) - 4 * first : size - 4 * first] = _ENDS[at % 100_000 : at % 100_000 + end - at, 5 - width :]
        words[first:last] = [w.copy() for w in differ.view("<u4").T]
        a, b, c, d = (np.full(end - at, x, np.uint32) for x in _FIRST)
        f = np.empty_like(a)
        for i in range(64):
            if i < 16:
                np.bitwise_xor(c, d, out=f)
                f &= b
                f ^= d
            elif i < 32:
                np.bitwise_xor(b, c, out=f)
                f &= d
                f ^= c
            elif i < 48:
                np.bitwise_xor(b, c, out=f)
                f ^= d
            else:
                np.invert(d, out=f)
                f |= b
                f ^= c
            word = words[_WORDS[i]]
            a += f
            if isinstance(word, int):
                a += (word + _SINES[i]) % 2**32
            else:
                a += word
                a += _SINES[i]
            np.left_shift(a, _TURNS[i], out=f)
            a >>= 32 - _TURNS[i]
            a |= f
            a += b
            a, b, c, d = d, a, b, c
        a += _FIRST[0]
        b += _FIRST[1]
        out[at - start : end - start] = a.byteswap().astype(np.int64) << 16 | b.byteswap() >> 16
        at = end
    return out


def range_cell(df: DataFrame, column: str, rows: int = 1 << 20, least: int = 512, most: int = 20_000) -> Column:
    """A column's cell among ranges of about equal counts; equal values share a cell, and null goes to the first.

    There is a cell for each ``rows`` rows, ``least`` and ``most`` bounding their number. A row finds its cell
    by halving: the cuts are dealt into groups, and only those of its group are compared."""
    cells = min(most, max(least, df.count() // rows))
    shares = ",".join(f"{i / cells}D" for i in range(1, cells))
    cuts = df.agg(F.expr(f"percentile_approx(`{column}`, array({shares}), {10 * cells})")).first()[0] or []
    cuts = sorted(set(cuts))
    if not cuts:
        return F.lit(0)
    width = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    below = lambda a, v: F.size(F.filter(a, lambda c: c < v))
    value = F.coalesce(F.col(column).cast("long"), F.lit(-(2**63)))
    # The greatest cuts of the groups say which group holds the first cut that isn't below the value.
    fixed = lambda a: f"array({','.join(f'{c}L' for c in a)})"
    group = below(F.expr(fixed(g[-1] for g in groups)), value)
    return F.when(group >= len(groups), len(cuts)).otherwise(group * width + below(F.get(F.expr(f"array({','.join(map(fixed, groups))})"), group), value))


def _offset(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    """by, _cell, _before: the sum of all cells before each one."""
    sums = df.groupBy(*by, "_cell").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*[F.col(b).alias(f"_by_{b}") for b in by], F.col("_cell").alias("_at"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).cast("long").alias("_before"))


def _with_offset(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    on = F.col("_cell") == F.col("_at")
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    return df.join(_offset(df, by, value), on, "left").drop("_at", *[f"_by_{b}" for b in by])


def shuffled_index(df: DataFrame, key: str, seed: int, by: list[str] | None = None, name: str = "position") -> DataFrame:
    """Number the rows from 0 in the order of (digest of key, key), within each group of ``by`` if given.

    A null key comes first. Rows with equal keys stand in the order of a digest of all their columns, so that
    only wholly equal rows can change places."""
    by = by or []
    # Maps have no order and no hash; they are compared as JSON.
    whole = [F.to_json(f.name) if f.dataType.typeName() in ("map", "struct", "array") else F.col(f"`{f.name}`") for f in df.schema]
    df = df.withColumn("_tie", F.xxhash64(*whole)).withColumn("_h", F.coalesce(digest(F.col(key), seed), F.lit(0))).withColumn("_cell", F.shiftright("_h", 36))
    within = F.row_number().over(Window.partitionBy(*by, "_cell").orderBy("_h", F.col(key).asc_nulls_first(), "_tie")) - 1
    out = _with_offset(df, by, F.lit(1)).withColumn(name, (within + F.col("_before")).cast("long"))
    return out.drop("_h", "_cell", "_before", "_tie")


def ordered_index(df: DataFrame, key: str, by: list[str] | None = None, name: str = "position") -> DataFrame:
    """Number the rows from 0 in the order of a whole-number key, within each group of ``by`` if given."""
    by = by or []
    df = df.withColumn("_cell", range_cell(df, key))
    within = F.row_number().over(Window.partitionBy(*by, "_cell").orderBy(key)) - 1
    return _with_offset(df, by, F.lit(1)).withColumn(name, (within + F.col("_before")).cast("long")).drop("_cell", "_before")


def running_total(df: DataFrame, key: str, value: str, name: str = "before", then: tuple[str, ...] = ()) -> DataFrame:
    """The sum of ``value`` over all rows before each one, in the order of a whole-number key, of equal ones of ``then``."""
    df = df.withColumn("_cell", range_cell(df, key))
    frame = Window.partitionBy("_cell").orderBy(key, *then).rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum(value).over(frame), F.lit(0))
    return _with_offset(df, [], F.col(value)).withColumn(name, (within + F.col("_before")).cast("long")).drop("_cell", "_before")
