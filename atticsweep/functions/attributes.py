"""Decoding of raw attribute bits, sizes and file times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Attribute bits, and the microseconds from 1601-01-01 to 1970-01-01.
DIRECTORY = 0x10
HIDDEN = 0x02
SYSTEM = 0x04
REPARSE_POINT = 0x400
MICROS_1601_TO_1970 = 11_644_473_600_000_000


def has_bit(bits: Column, mask: int) -> Column:
    return bits.cast("bigint").bitwiseAND(F.lit(mask).cast("bigint")) != 0


def decode_attributes(bits: Column) -> Column:
    """Attribute bits to a struct of four flags."""
    return F.struct(
        has_bit(bits, DIRECTORY).alias("is_directory"),
        has_bit(bits, HIDDEN).alias("is_hidden"),
        has_bit(bits, SYSTEM).alias("is_system"),
        has_bit(bits, REPARSE_POINT).alias("is_reparse_point"),
    )


def decode_size(hi: Column, lo: Column) -> Column:
    """Two unsigned 32-bit halves to one bigint."""
    low = lo.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
    return F.shiftleft(hi.cast("bigint"), 32).bitwiseOR(low)


def decode_filetime(hi: Column, lo: Column) -> Column:
    """100 ns ticks since 1601 to a timestamp; NULL where the ticks are not positive."""
    ticks = decode_size(hi, lo)
    micros = F.call_function("div", ticks, F.lit(10))
    return F.when(ticks > 0, F.timestamp_micros(micros - F.lit(MICROS_1601_TO_1970)))
