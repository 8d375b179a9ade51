"""Column expressions over base-4 sequences (digits 0-3 for A, C, G, T)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KMER, TMER, SMER, WINDOW, FREQ = 40, 12, 8, 5, 10  # fixed values of the seeding scheme
BAND_BITS = 6  # a band is 64 diagonals wide
CHAIN_BREAK, CHAIN_MIN = 2000, 170
ALIGN_MIN, ALIGN_RATE, FUZZ = 100, 0.3, 10  # least length, most differences a base, slack of boxes
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def encode(text: Column) -> Column:
    """Letters of a text as digits, a-z dealt to 0-3 in turn; everything else is dropped."""
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), LETTERS, ("0123" * 7)[:26])


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "0123", "3210")


def rank4(code, factor: int = 167, shift: int = 13):
    """Rank of a 4-mer's code (a column or an array): a permutation of 0-255 by a linear rule (factor odd)."""
    return (code * factor + shift) % 256


def shared_symbols(a: Column, b: Column, symbols: int) -> Column:
    """Length of the common prefix of two packed sequences of ``symbols`` base-4 digits (2 * symbols bits of a long)."""
    apart = F.bin(a.bitwiseXOR(b))
    return F.when(a == b, symbols).otherwise(symbols - F.ceil(F.length(apart) / 2)).cast("int")


def packed_number(digits: str) -> int:
    """A string of base-4 digits as a number."""
    return int(digits, 4) if digits else 0


def digits_of(packed: Column, symbols: int) -> Column:
    """A packed sequence as a string of digits."""
    return F.lpad(F.conv(packed.cast("string"), 10, 4), symbols, "0")


def turned(packed: Column, symbols: int) -> Column:
    """The reverse complement of a packed sequence of up to 32 digits: neighbours of 1, 2, 4, ... digits change places."""
    x = packed.bitwiseXOR(F.lit((1 << 2 * symbols) - 1).cast("long"))
    for n, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        x = F.shiftrightunsigned(x, n).bitwiseAND(F.lit(mask)).bitwiseOR(F.shiftleft(x.bitwiseAND(F.lit(mask)), n))
    x = F.shiftrightunsigned(x, 32).bitwiseOR(F.shiftleft(x, 32))
    return F.shiftrightunsigned(x, 64 - 2 * symbols)


def letters(seq: Column) -> Column:
    """Digits as bases ACGT."""
    return F.translate(seq, "0123", "ACGT")


def digits(bases: Column) -> Column:
    """Bases in either case as digits; other symbols count as A."""
    return F.translate(F.regexp_replace(F.upper(bases), "[^ACGT]", "A"), "ACGT", "0123")
