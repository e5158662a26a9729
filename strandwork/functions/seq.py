"""Column expressions on sequences and k-mers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The alphabet and its complement, and the IUPAC codes with theirs.
BASES, COMPLEMENT = "ACGT", "TGCA"
IUPAC, IUPAC_COMPLEMENT = "acgtrymkbvdh", "tgcayrkmvbhd"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TILE = 256


def dna(text: Column) -> Column:
    """Letters of a text projected onto A, C, G, T in turn; white space goes, all else becomes N."""
    to = ("ACGT" * 7)[:26]
    return F.regexp_replace(F.regexp_replace(F.translate(text, LETTERS + LETTERS.lower(), to * 2), "[ \n]", ""), "[^ACGT]", "N")


_PROJECTED = bytearray(b"N" * 256)
for _i, _x in enumerate(LETTERS):
    _PROJECTED[ord(_x)] = _PROJECTED[ord(_x.lower())] = ord(BASES[_i % 4])
_PROJECTED = bytes(_PROJECTED)
#: White space, and what follows the first byte of a letter in UTF-8.
_DROPPED = b" \n" + bytes(range(0x80, 0xC0))


def dna_bytes(text) -> bytes:
    """dna() of a text's UTF-8 bytes: a letter of several bytes is one N."""
    return bytes(text).translate(_PROJECTED, _DROPPED)


def revcomp(seq: Column) -> Column:
    return F.translate(F.reverse(seq), BASES, COMPLEMENT)


def canonical(kmer: Column, double_stranded: bool = True) -> Column:
    return F.least(kmer, revcomp(kmer)) if double_stranded else kmer


def iupac_revcomp(seq: Column) -> Column:
    """Lower case; codes outside the IUPAC set become n, s and w stand for themselves."""
    return F.translate(F.reverse(F.regexp_replace(F.lower(seq), "[^acgtrymkbvdhsw]", "n")), IUPAC, IUPAC_COMPLEMENT)


def push_right(kmer: Column, base: Column) -> Column:
    return F.concat(F.substr(kmer, F.lit(2)), base)


def push_left(kmer: Column, base: Column) -> Column:
    return F.concat(base, F.substr(kmer, F.lit(1), F.length(kmer) - 1))


def windows(df: DataFrame, seq: str, k: int, keep: list[str]) -> DataFrame:
    """keep + (pos from 1, w): all windows of length k. Long sequences are cut into overlapping tiles first, for a window's cost
    would otherwise grow with its distance from the start."""
    base = df.where(F.length(seq) >= k)
    tiles = base.select(*keep, F.col(seq).alias("_s"), F.explode(F.sequence(F.lit(0), F.floor((F.length(seq) - k) / TILE).cast("int"))).alias("_t"))
    tiles = tiles.select(*keep, "_t", F.substr("_s", F.col("_t") * TILE + 1, F.lit(TILE + k - 1)).alias("_s"))
    wide = tiles.select(*keep, "_t", "_s", F.explode(F.sequence(F.lit(1), F.length("_s") - k + 1)).alias("_q"))
    return wide.select(*keep, (F.col("_t") * TILE + F.col("_q")).alias("pos"), F.substr("_s", F.col("_q"), F.lit(k)).alias("w"))


def valid(w: Column) -> Column:
    return ~w.rlike("[^ACGT]")


def log_gamma(x: Column) -> Column:
    """ln Gamma for x > 0: Stirling's series at x + 8, carried back by the recurrence."""
    y = x + 8.0
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    shift = F.lit(0.0)
    for i in range(8):
        shift = shift + F.log(x + float(i))
    return series - shift


def poisson_pdf(k: Column, mu: Column) -> Column:
    n = F.floor(k).cast("double")
    return F.when(mu > 0, F.exp(n * F.log(mu) - mu - log_gamma(n + 1.0))).otherwise(F.when(n == 0, 1.0).otherwise(0.0))


#: Overlap mask: high nibble left A, C, G, T, low nibble right A, C, G, T, from the highest bit.
def right_bit(base: Column) -> Column:
    return F.element_at(F.create_map(*[x for i, b in enumerate(BASES) for x in (F.lit(b), F.lit(1 << (3 - i)))]), base)


def left_bit(base: Column) -> Column:
    return right_bit(base) * 16


def reversed_mask(mask: Column) -> Column:
    """The mask of the reverse complement: nibbles swapped and each read backwards."""
    out = F.lit(0)
    for i in range(8):
        out = out + F.shiftright(mask, i).bitwiseAND(F.lit(1)) * (1 << (7 - i))
    return out
