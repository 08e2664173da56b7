"""Aggregate and hash expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_digest(key: Column | str, seed: int) -> Column:
    """Seeded digest of a row key: the same in every run, partitioning and engine."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def digest_number(digest: Column) -> Column:
    """The first eight hex digits of a digest as a number below 2**32."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def digest_limit(share: float) -> str:
    """The digest below which a ``share`` of all digests lies."""
    return f"{int(share * 2**32):08x}"


def correlation(n: Column, x: Column, y: Column, xx: Column, yy: Column, xy: Column) -> Column:
    """Pearson correlation from counts, sums and sums of products of values near their means."""
    var_x, var_y = xx / n - (x / n) * (x / n), yy / n - (y / n) * (y / n)
    return F.try_divide(xy / n - x / n * (y / n), F.sqrt(var_x) * F.sqrt(var_y))


def n_log_n(n: Column) -> Column:
    """``n ln n``, the term entropies of counts are sums of."""
    return n * F.log(n.cast("double"))


def digamma(x: Column) -> Column:
    """The logarithmic derivative of the gamma function, for x >= 1, to about 1e-12."""
    x = x.cast("double")
    # psi(x) = psi(x + 8) - the sum of 1 / (x + i); beyond 8 the asymptotic series is exact enough.
    far = x + 8
    square = 1 / (far * far)
    series = F.log(far) - 0.5 / far - square * (1 / 12 - square * (1 / 120 - square * (1 / 252 - square * (1 / 240 - square / 132))))
    return series - sum((1 / (x + i) for i in range(1, 8)), 1 / x)
