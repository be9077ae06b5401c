"""IPv4 addresses and range lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: four numbers of at most three digits.
IPV4 = r"^[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}$"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def ip_number(ip: Column | str) -> Column:
    """IPv4 text as a number; null when it is no address."""
    ip = F.trim(_col(ip))
    parts = [F.substring_index(F.substring_index(ip, ".", i), ".", -1).try_cast("bigint") for i in (1, 2, 3, 4)]
    in_range = ip.rlike(IPV4)
    for part in parts:
        in_range = in_range & (part <= 255)
    return F.when(in_range, ((parts[0] * 256 + parts[1]) * 256 + parts[2]) * 256 + parts[3])


def cidr_ranges(df: DataFrame, lists: str, keep: Sequence[str]) -> DataFrame:
    """One row (``lo``, ``hi``) per address or CIDR block of a comma-separated list."""
    items = df.select(*keep, F.explode(F.split(lists, ",")).alias("_item")).withColumn("_item", F.trim("_item"))
    bits = F.coalesce(F.nullif(F.split_part("_item", F.lit("/"), F.lit(2)), F.lit("")).try_cast("int"), F.lit(32))
    start = ip_number(F.split_part("_item", F.lit("/"), F.lit(1)))
    width = F.pow(F.lit(2), F.lit(32) - bits).cast("bigint")
    lo = start - F.pmod(start, width)
    return items.where(start.isNotNull()).select(*keep, lo.alias("lo"), (lo + width - 1).alias("hi"))


def lookup_ranges(df: DataFrame, ip: str, ranges: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``df`` with the columns of the narrowest range that holds the address, null when none does.

    Equal widths: the range with the smallest ``keep`` values. Ranges are cut into /16 blocks and met
    by equality on the block; each distinct address is looked up once.
    """
    blocks = ranges.withColumn("_block", F.explode(F.sequence(F.shiftright("lo", 16), F.shiftright("hi", 16))))
    # text that is no address gets a number outside every range
    addresses = (
        df.select(ip).distinct().withColumn("_n", F.coalesce(ip_number(ip), F.lit(-1)))
        .withColumn("_block", F.shiftright("_n", 16))
    )
    best = (
        addresses.join(blocks, "_block")
        .where((F.col("_n") >= F.col("lo")) & (F.col("_n") <= F.col("hi")))
        .groupBy(ip)
        .agg(F.min_by(F.struct(*keep), F.struct(F.col("hi") - F.col("lo"), *keep)).alias("_best"))
        .select(ip, *[F.col("_best")[c].alias(c) for c in keep])
    )
    return df.join(best, ip, "left")
