"""Identity keys: a row is its source and its address, nothing else."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The separator of source and address, and the constants of 64-bit FNV-1a.
SEPARATOR = "\x1f"
FNV_OFFSET = 14695981039346656037
FNV_PRIME = 1099511628211


def blank_to_null(c: Column | str) -> Column:
    """Empty text means missing everywhere in the model."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.trim(c) != "", c)


def effective_url(asset: Column | str = "pdf_url", page: Column | str = "url") -> Column:
    """The asset's address if there is one, else the page's."""
    return F.trim(F.coalesce(blank_to_null(asset), blank_to_null(page), F.lit("")))


def identity(source: Column | str, url: Column | str) -> Column:
    source = F.col(source) if isinstance(source, str) else source
    url = F.col(url) if isinstance(url, str) else url
    return F.concat(F.trim(F.coalesce(source, F.lit(""))), F.lit(SEPARATOR), F.coalesce(url, F.lit("")))


def notice_key(source: Column | str, url: Column | str) -> Column:
    """SHA-256 of source and address: equal addresses in two sources stay two rows."""
    return F.sha2(identity(source, url), 256)


def fnv1a_64(text: Column) -> Column:
    """64-bit FNV-1a as 16 hex digits, in decimals because the product passes 64 bits. One fold over the bytes, no UDF."""
    digits = F.hex(F.encode(text, "UTF-8"))
    n = F.length(digits)
    starts = F.when(n > 0, F.sequence(F.lit(1), n - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    wide = "decimal(38,0)"
    modulus = F.lit(str(1 << 64)).cast(wide)

    def step(h: Column, at: Column) -> Column:
        byte = F.conv(F.substring(digits, at, F.lit(2)), 16, 10).cast("int")
        low = (h % 256).cast("int")
        return (((h - low + low.bitwiseXOR(byte)).cast("decimal(20,0)") * F.lit(FNV_PRIME).cast("decimal(14,0)")) % modulus).cast(wide)

    h = F.aggregate(starts, F.lit(str(FNV_OFFSET)).cast(wide), step)
    half = F.lit(1 << 32).cast(wide)
    high = F.floor(h / half).cast("long")
    low = (h % half).cast("long")
    return F.lower(F.concat(F.lpad(F.hex(high), 8, "0"), F.lpad(F.hex(low), 8, "0")))


def notice_id(source: Column | str, url: Column | str) -> Column:
    """The short public id of a row."""
    return fnv1a_64(identity(source, url))
