"""Big-endian reads from binary columns, built from Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uint(data, offset, size: int) -> Column:
    """Unsigned big-endian integer of ``size`` bytes at 0-based ``offset``; null past the end."""
    start = offset if isinstance(offset, Column) else F.lit(offset)
    piece = F.substring(data, start + 1, F.lit(size))
    return F.when(
        F.length(piece) == size, F.conv(F.hex(piece), 16, 10).cast("bigint")
    )


def bits(value, shift: int, width: int) -> Column:
    return F.shiftright(value, shift).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))


# Fixed value: the generator polynomial of the MPEG section check (ISO/IEC 13818-1, annex B).
POLYNOMIAL = 0x04C11DB7




def _before(register: int) -> bytes:
    """The four bytes that take the check's register from all ones to ``register``."""
    for _ in range(32):
        register = (register ^ POLYNOMIAL) >> 1 | 1 << 31 if register & 1 else register >> 1
    return (register ^ 0xFFFFFFFF).to_bytes(4, "big")


def _mirrored(byte: int) -> int:
    return int(f"{byte:08b}"[::-1], 2)


#: Bytes as characters, without those that read the same from both ends, and their mirrored ones.
_BYTES = [b for b in range(256) if _mirrored(b) != b]
_PLAIN, _MIRRORED = ("".join(map(chr, bytes_)) for bytes_ in (_BYTES, map(_mirrored, _BYTES)))


def crc32_mpeg(data, start: int = 0) -> Column:
    """CRC-32 without reflection over the whole value, from ``start``.

    It is the common, reflected check (``crc32``) of the bytes with their bits mirrored, itself
    mirrored and without the last inversion. That one starts from all ones, so four bytes that
    lead from there to ``start`` go in front.
    """
    begun = F.concat(F.lit(_before(start & 0xFFFFFFFF)), data)
    chars = F.translate(F.decode(begun, "ISO-8859-1"), _PLAIN, _MIRRORED)
    value = F.crc32(F.encode(chars, "ISO-8859-1")).bitwiseXOR(F.lit(0xFFFFFFFF).cast("bigint"))
    return F.conv(F.reverse(F.lpad(F.bin(value), 32, "0")), 2, 10).cast("bigint")
