"""Column functions: integer codes, encoded sizes, ratios and report texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.functions.patterns import CANONICAL_INT


def zigzag(v: Column) -> Column:
    """Signed to unsigned: 0, -1, 1, -2... to 0, 1, 2, 3..."""
    return F.when(v >= 0, v * 2).otherwise(v * -2 - 1)


def unzigzag(u: Column) -> Column:
    return F.shiftright(u, 1).bitwiseXOR(-(u.bitwiseAND(1)))


def varint_size(u: Column) -> Column:
    """Bytes of an unsigned LEB128 integer; a negative one is an error.

    A comparison ladder, as logarithms of large integers aren't exact.
    """
    size = F.lit(1)
    for n in range(1, 9):
        size = size + F.when(u >= F.lit(1 << (7 * n)), 1).otherwise(0)
    return F.when(u < 0, F.raise_error(F.lit("varint of a negative integer"))).otherwise(size).cast("long")


def str_size(octets: Column) -> Column:
    """Bytes of a packed string of so many bytes."""
    return octets + F.when(octets <= 31, 1).when(octets <= 255, 2).when(octets <= 65535, 3).otherwise(5)


def array_header(n: Column) -> Column:
    return F.when(n <= 15, 1).when(n <= 65535, 3).otherwise(5)


def bin_size(n: Column) -> Column:
    """Bytes of a packed byte string of n bytes."""
    return n + F.when(n <= 255, 2).when(n <= 65535, 3).otherwise(5)


def is_canonical_int(v: Column) -> Column:
    return v.rlike(CANONICAL_INT)


def ratio(raw: Column, packed: Column) -> Column:
    """raw / packed, null if packed is zero."""
    return F.try_divide(raw.cast("double"), packed.cast("double"))


def delta_pct(candidate: Column, baseline: Column) -> Column:
    """Percentage by which candidate exceeds baseline, null without a positive baseline."""
    return F.when(baseline > 0, (candidate - baseline) / baseline * 100.0)


def verdict(pct: Column) -> Column:
    """The limits and labels of a size comparison in percent."""
    return F.when(pct <= -10.0, "strong win").when(pct < 0.0, "win").when(pct <= 10.0, "acceptable").when(pct.isNotNull(), "loss")


def mode_label(mode: Column) -> Column:
    return F.when(mode == "row_template", "row").when(mode.like("columnar%"), "columnar").otherwise(mode)


def fixed(x: Column, places: int) -> Column:
    """A number with so many decimals, as printf writes it: the double's exact value is rounded, ties to even.

    ``format_number`` does that (``format_string`` rounds the shortest decimal of the double, ties up).  From 2^53 on doubles are
    whole numbers, all of whose digits are written.
    """
    high = F.floor(F.abs(x) / (1 << 32))
    whole = high.cast("decimal(22,0)") * F.lit(1 << 32).cast("decimal(10,0)") + (F.abs(x) - high * float(1 << 32)).cast("long").cast("decimal(10,0)")
    digits = F.concat(F.when(x < 0, "-").otherwise(""), whole.cast("string"), F.lit("." + "0" * places))
    return F.when(F.abs(x) < 1 << 53, F.call_function("format_number", x, F.lit("0." + "0" * places))).otherwise(digits)


def format_bytes(n: Column) -> Column:
    """B, KB, MB or GB, null as n/a."""
    kb, mb = 1024.0, 1024.0 * 1024
    text = F.when(n < 1024, F.format_string("%d B", n)).when(n < 1 << 20, F.concat(fixed(n / kb, 1), F.lit(" KB")))
    text = text.when(n < 1 << 30, F.concat(fixed(n / mb, 1), F.lit(" MB"))).otherwise(F.concat(fixed(n / (1024 * mb), 2), F.lit(" GB")))
    return F.when(n.isNull(), "n/a").otherwise(text)


def format_delta(size: Column, baseline: Column, subject: str, label: str) -> Column:
    """A sentence that compares two sizes."""
    off = F.abs(size - baseline)
    pct = fixed(F.try_divide(off, baseline) * 100, 1)
    said = F.concat(F.lit(f"{subject} is "), F.format_number(off, 0), F.lit(" bytes ("), pct, F.lit("%) "))
    return (
        F.when(baseline == 0, "(baseline size is 0, delta not meaningful)")
        .when(size < baseline, F.concat(said, F.lit(f"SMALLER than {label}.")))
        .when(size > baseline, F.concat(said, F.lit(f"LARGER than {label}.")))
        .otherwise(f"{subject} is equal in size to {label}.")
    )
