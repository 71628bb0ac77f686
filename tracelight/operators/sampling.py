"""Deterministic per-partition sampling of messages.

``row_number() <= n`` is planned as a group limit: each task keeps its own best ``n`` rows of a
partition before the shuffle, so a partition that holds a third of all messages still sends only
``n`` rows per task.
"""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

READ_CAP = 200
KEEP_CAP = 100

_PARTITION = ["topic", "partition"]
_PLACE = "row_number() over (partition by topic, partition order by offset)"


def _first(msgs: DataFrame, n: int, latest: bool = False) -> DataFrame:
    order = F.col("offset").desc() if latest else F.col("offset").asc()
    rank = F.row_number().over(Window.partitionBy(*_PARTITION).orderBy(order))
    return msgs.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def fraction(percentage: float) -> float:
    """A share: numbers above 1 are percent."""
    share = percentage / 100.0 if percentage > 1.0 else percentage
    if not 0.0 < share <= 1.0:
        raise ValueError("the sampling percentage must be above 0 and at most 100")
    return share


def tail_size(
    percentage: float | None = None,
    max_per_partition: int = KEEP_CAP,
    min_per_partition: int = 10,
    read_cap: int | None = READ_CAP,
) -> int:
    """How many of the latest messages of a partition a sampler looks at."""
    if percentage is None:
        n = max_per_partition * 10
    else:
        n = max(int(max_per_partition / fraction(percentage)) * 2, min_per_partition * 10)
    return n if read_cap is None else min(n, read_cap)


def tail_per_partition(msgs: DataFrame, n: int) -> DataFrame:
    """The latest ``n`` messages of each partition."""
    return _first(msgs, n, latest=True)


def _tail(
    msgs: DataFrame, percentage: float, most: int | None, least: int, read_cap: int | None
) -> DataFrame:
    if most is not None:
        return tail_per_partition(msgs, tail_size(percentage, most, least, read_cap))
    return msgs if read_cap is None else tail_per_partition(msgs, read_cap)


def sample_percentage(
    msgs: DataFrame,
    percentage: float = 5,
    min_per_partition: int = 10,
    max_per_partition: int | None = None,
    read_cap: int | None = None,
) -> DataFrame:
    """An even stride through each partition, for about ``percentage`` of it.

    With ``max_per_partition`` the stride goes through the tail that is enough for that many, and
    with ``read_cap`` through at most so many of the latest messages.
    """
    share = fraction(percentage)
    tail = _tail(msgs, percentage, max_per_partition, min_per_partition, read_cap)
    size = F.count(F.lit(1)).over(Window.partitionBy(*_PARTITION))
    most = F.col("_size") if max_per_partition is None else F.lit(max_per_partition)
    target = F.greatest(F.lit(min_per_partition), F.least(F.floor(F.col("_size") * share).cast("long"), most))
    return (
        tail.withColumn("_size", size)
        .withColumn("_place", F.expr(f"{_PLACE} - 1"))
        .withColumn("_step", F.greatest(F.lit(1), F.floor(F.col("_size") / target).cast("int")))
        .where(
            (F.col("_place") % F.col("_step") == 0)
            & (F.col("_place") / F.col("_step") < most)
        )
        .drop("_size", "_place", "_step")
    )


def sample_every_nth(
    msgs: DataFrame,
    percentage: float = 5,
    max_per_partition: int | None = None,
    min_per_partition: int = 10,
    read_cap: int | None = None,
    fill_min: bool = False,
) -> DataFrame:
    """The Nth, 2Nth … message of each partition (of its tail, see ``sample_percentage``), N being ``1 / percentage``.

    A partition shorter than N yields nothing, unless ``fill_min`` adds its first messages up to
    the minimum.
    """
    interval = max(1, int(1 / fraction(percentage)))
    tail = _tail(msgs, percentage, max_per_partition, min_per_partition, read_cap)
    picked = (
        tail.withColumn("_place", F.expr(_PLACE))
        .withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy(*_PARTITION)))
    )
    keep = F.col("_place") % interval == 0
    if max_per_partition is not None:
        keep &= F.col("_place") / interval <= max_per_partition
    if fill_min:
        short = F.floor(F.col("_size") / interval) < min_per_partition
        keep = F.when(short, F.col("_place") <= min_per_partition).otherwise(keep)
    return picked.where(keep).drop("_place", "_size")


def sample_count(msgs: DataFrame, count: int, compat_caps: bool = False) -> DataFrame:
    """The first ``count`` messages of each partition; ``compat_caps``: of its tail, at most 100."""
    if not compat_caps:
        return _first(msgs, count)
    return _first(tail_per_partition(msgs, tail_size()), min(count, KEEP_CAP))


def sample_all(msgs: DataFrame, compat_caps: bool = False) -> DataFrame:
    """Every message; ``compat_caps`` keeps the first 100 of the latest 200 per partition."""
    return sample_count(msgs, KEEP_CAP, compat_caps=True) if compat_caps else msgs


def parse_time_window(text: str) -> timedelta:
    """``30m``, ``1h``, ``2d`` or bare hours; text without a number means one hour."""
    match = re.fullmatch(r"\s*(.*?)([hmd]?)\s*", text.lower())
    number, unit = match.group(1), match.group(2)
    if unit:
        return {"h": timedelta(hours=1), "m": timedelta(minutes=1), "d": timedelta(days=1)}[unit] * float(number)
    try:
        return timedelta(hours=float(number))
    except ValueError:
        return timedelta(hours=1)


def sample_time_window(msgs: DataFrame, window: str, ref_time: str | None = None) -> DataFrame:
    """Messages not older than the window, counted back from ``ref_time`` (now if not given).

    A message without a timestamp is left out. Both bounds are literals, so the filter reaches
    the scan.
    """
    now = F.current_timestamp() if ref_time is None else F.lit(ref_time).cast("timestamp")
    return msgs.where(F.col("timestamp") >= now - F.lit(parse_time_window(window)))


def limit_partitions(msgs: DataFrame, max_partitions: int) -> DataFrame:
    """Only the first partitions of each topic."""
    return msgs.where(F.col("partition") < max_partitions)


def bernoulli_fill(
    msgs: DataFrame,
    percentage: float,
    min_per_partition: int = 10,
    max_per_partition: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """The first ``min`` messages of each partition, then a coin per message, up to ``max`` if that is given.

    The coin is a digest of the message position, so a repeated task, and any other engine, decides
    alike: the first eight hex digits of the MD5 of ``topic:partition:offset:seed`` under the share of
    all. The first messages and the cap are group limits, which prune before the shuffle; the earliest
    ``max`` of both parts are the earliest ``max`` overall. Without a cap the lucky messages are not shuffled.
    """
    share = fraction(percentage)
    position = F.concat_ws(":", "topic", "partition", "offset", F.lit(str(seed)))
    coin = F.conv(F.substring(F.md5(position.cast("binary")), 1, 8), 16, 10).cast("long")
    lucky = coin < int(share * (1 << 32))
    first = min_per_partition if max_per_partition is None else min(min_per_partition, max_per_partition)
    always = _first(msgs, first)
    if max_per_partition is None:
        # what is among the first and has no luck is added; all others are kept where they are
        return msgs.where(lucky).unionByName(always.where(~lucky))
    both = always.where(~lucky).unionByName(_first(msgs.where(lucky), max_per_partition))
    return _first(both, max_per_partition)


def target_sample_count(
    profile: DataFrame,
    strategy: str,
    percentage: float = 5,
    count: int = 100,
    min_per_partition: int = 10,
    max_per_partition: int = 1000,
) -> DataFrame:
    """Planned sample size of each topic, from its partition profile."""
    topics = profile.groupBy("topic").agg(
        F.count(F.lit(1)).alias("partitions"), F.sum("message_count").alias("total")
    )
    parts = F.col("partitions")
    if strategy == "all":
        target = F.when(F.col("total") > 0, F.col("total")).otherwise(1_000_000)
    elif strategy == "percentage":
        share = fraction(percentage)
        wanted = F.when(F.col("total") > 0, F.floor(F.col("total") * share)).otherwise(
            F.floor(parts * max_per_partition * share)
        )
        target = F.greatest(parts * min_per_partition, F.least(wanted, parts * max_per_partition))
    elif strategy == "count":
        target = parts * count
    elif strategy == "time_based":
        target = parts * 100
    else:
        raise ValueError(f"unknown sampling strategy: {strategy}")
    return topics.select("topic", "partitions", "total", target.cast("long").alias("target"))


def sample(msgs: DataFrame, strategy: str = "percentage", **options) -> DataFrame:
    """Sampling by strategy name; an unknown name is an error."""
    strategies = {
        "all": sample_all,
        "count": sample_count,
        "time_based": sample_time_window,
        "percentage": sample_percentage,
        "every_nth": sample_every_nth,
        "bernoulli": bernoulli_fill,
    }
    if strategy not in strategies:
        raise ValueError(f"unknown sampling strategy: {strategy}")
    return strategies[strategy](msgs, **options)
