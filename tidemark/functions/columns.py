"""Column expressions of integer coding: everything stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Quantized values stay below this, so that second differences fit 64 bits.
LARGEST = float(1 << 59)


def quantize(r: Column, bits: Column | int) -> Column:
    """Null for values that aren't finite or too large for integers."""
    scaled = F.rint(r * F.pow(F.lit(2.0), F.lit(bits) if isinstance(bits, int) else bits))
    return F.when(F.abs(scaled) < LARGEST, scaled.cast("long"))


def quantize_all(r: Column, bits: int) -> Column:
    """For codecs without a way out: NaN and infinite values count as 0, too large ones as the largest."""
    scaled = F.rint(F.when(finite(r), r).otherwise(0.0) * float(1 << bits))
    return F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), scaled)).cast("long")


def size_text(n: Column) -> Column:
    """Bytes as B, KB or MB."""
    return F.when(n < 1024, F.format_string("%dB", n)).when(n < 1024 * 1024, F.format_string("%.1fKB", n / 1024 + 1e-9)).otherwise(F.format_string("%.2fMB", n / (1024 * 1024) + 1e-9))


def ratio_text(raw: Column, n: Column) -> Column:
    return F.when(n > 0, F.format_string("%.1fx", raw / n + 1e-9)).otherwise("N/A")


def error_text(e: Column) -> Column:
    return F.when(e.isNull(), "N/A").when(e == 0, "0 (exact)").otherwise(F.format_string("%.2e", e))


def throughput(n_bytes: Column, seconds: Column) -> Column:
    """MB (a million bytes) a second; null where no time was measured."""
    return F.when(seconds > 0, n_bytes / 1e6 / seconds)


def zigzag(n: Column) -> Column:
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 63))


def bit_length(z: Column) -> Column:
    """Bits of a non-negative integer, at least 1."""
    return F.length(F.bin(z))


def varint_length(z: Column) -> Column:
    return F.greatest(F.lit(1), F.expr("int(1)") * F.ceil(bit_length(z) / 7)).cast("long")


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
