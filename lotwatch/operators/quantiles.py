"""Exact medians without a buffer of all values: counts by value range, refined around the middle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranges that one round tells apart.
RANGES = 4096
#: Rounds that end by halving the range's bits where its ends are very far apart.
MOST_ROUNDS = 200


def exact_median(df: DataFrame, column: str, ranges: int = RANGES) -> float | None:
    """The median of a column as a double: nulls and NaNs are skipped, of an even number the two in the middle count half each; None without a value.

    Every round is one scan that counts the values of equal ranges between two
    bounds, by partial sums, and goes on with the range that holds the middle;
    at most `ranges` rows reach the driver.  It ends where the middle range
    holds one value alone, however often.
    """
    x = F.col(column).cast("double")
    df = df.select(x.alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    first = df.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).first()
    if not first["n"]:
        return None
    found = {}
    below, low, high = 0, first["low"], first["high"]
    middle = sorted({(first["n"] - 1) // 2, first["n"] // 2})
    for rank in middle:
        if rank in found:
            continue
        low_, high_, below_ = low, high, below
        for _ in range(MOST_ROUNDS):
            if low_ == high_:
                found[rank] = low_
                break
            # Halves of the bounds, so that their distance is finite.
            width = high_ / 2 - low_ / 2
            at = F.least(F.lit(ranges - 1), F.floor((F.col("x") / 2 - low_ / 2) / width * ranges)) if width > 0 else F.when(F.col("x") == high_, ranges - 1).otherwise(0)
            counts = df.filter(F.col("x").between(low_, high_)).groupBy(at.cast("int").alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
            rows, past = sorted(counts.collect(), key=lambda r: r["low"]), below_
            for k, r in enumerate(rows):
                if past + r["n"] > rank:
                    break
                past += r["n"]
            for other in middle:  # ends of ranges need no further round
                if other == past + r["n"] - 1:
                    found[other] = r["high"]
                elif other == past + r["n"] and k + 1 < len(rows):
                    found[other] = rows[k + 1]["low"]
                elif other == past:
                    found[other] = r["low"]
            if rank in found:
                break
            below_, low_, high_ = past, r["low"], r["high"]
        else:
            raise ArithmeticError("the middle range doesn't shrink")
        below, low, high = below_, low_, high_ if len(found) == len(middle) else high
    a, b = found[middle[0]], found[middle[-1]]
    return a * 0.5 + b * 0.5
