"""Forecasts packed into profiles: one row per series of a challenge.

A profile is ``(resource_id, challenge_id, user_id, variable, n, points)``: ``points`` are the
series' slots in order, (datetime, value), and ``n`` counts the slots with a value.  A challenge
bounds the list (24 to 100 slots a day), so there are that many times fewer rows to join,
count and shuffle, and a gate or a weight is decided per profile.  ``unpacked`` gives
the rows back without a shuffle; operators that take a block accept either form.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumcast.functions.metrics import QUANTILES
from quorumcast.functions.timegrid import elapsed_seconds, minutes_interval, slot_count, slot_start
from quorumcast.operators.gates import complete_normal_submitters
from quorumcast.operators.grid import range_join

SERIES = ["resource_id", "challenge_id", "user_id", "variable"]


def is_packed(block: DataFrame) -> bool:
    return "points" in block.columns


def unpacked(block: DataFrame) -> DataFrame:
    """One row per slot; rows that are not packed stay as they are."""
    if not is_packed(block):
        return block
    others = [c for c in block.columns if c not in ("points", "n", "rows")]
    return block.select(*others, F.explode("points").alias("_p")).select(*others, F.col("_p.datetime").alias("datetime"), F.col("_p.value").alias("value"))


def _packed(rows: DataFrame, keys: Sequence[str], slot_minutes: int) -> DataFrame:
    """Profiles of rows, listed where the rows are if they lie together already."""
    point = F.struct(slot_start(F.col("datetime"), slot_minutes).alias("datetime"), F.col("value").cast("double").alias("value"))
    lists = rows.groupBy(*keys).agg(F.collect_list(point).alias("_p"))
    times = F.array_distinct(F.transform("_p", lambda p: p["datetime"]))

    def mean(t: Column) -> Column:
        own = F.transform(F.filter("_p", lambda p: p["datetime"].eqNullSafe(t) & p["value"].isNotNull()), lambda p: p["value"])
        return F.when(F.size(own) > 0, F.aggregate(own, F.lit(0.0), lambda a, v: a + v) / F.size(own))

    def known(points: str) -> Column:
        return F.size(F.filter(points, lambda p: p["value"].isNotNull())).cast("bigint")

    repeated = F.transform(F.sort_array(times), lambda t: F.struct(t.alias("datetime"), mean(t).alias("value")))
    points = F.when(F.size(times) == F.size("_p"), F.sort_array("_p")).otherwise(repeated)
    return lists.select(*keys, points.alias("points"), known("_p").alias("rows")).select(*keys, "points", known("points").alias("n"), "rows")


def pack(rows: DataFrame, slot_minutes: int = 15) -> DataFrame:
    """Profiles of (resource, challenge, user, variable, datetime, value) rows, averaged per slot.

    One shuffle, by challenge and variable: profiles that are combined or compared lie together
    behind it, so that what groups their slots needs no other.
    """
    return _packed(rows.select(*SERIES, "datetime", "value").repartition("challenge_id", "variable"), SERIES, slot_minutes).drop("rows")


def pack_with_continuous(rows: DataFrame, challenges: DataFrame, continuous: DataFrame, submissions: DataFrame,
                         quantiles: Sequence[str] = QUANTILES, slot_minutes: int = 15) -> DataFrame:
    """``pack``, with rolling forecasts in place of what a user sent for a challenge where they qualify.

    They do when the normal submissions are not complete and the rolling forecasts hold exactly
    the quantiles, each with exactly the expected slots.  Sent and rolling rows go through the
    same shuffle, and the choice is made per (challenge, user), where their profiles meet.
    """
    window = challenges.select("challenge_id", "resource_id", "start_datetime", "end_datetime")
    inside = range_join(continuous, window, "start_datetime", "end_datetime")
    expected = slot_count(F.col("start_datetime"), F.col("end_datetime"), slot_minutes)
    columns = [*SERIES, "datetime", "value"]
    both = rows.select(*columns, F.lit(None).cast("bigint").alias("_expected")).unionByName(inside.select(*columns, expected.alias("_expected")))
    series = _packed(both, [*SERIES, "_expected"], slot_minutes)
    users = series.groupBy("resource_id", "challenge_id", "user_id").agg(
        F.collect_list(F.struct("variable", "_expected", "points", "n", "rows")).alias("_all"))
    rolling, sent = (F.filter("_all", lambda s: s["_expected"].isNotNull()), F.filter("_all", lambda s: s["_expected"].isNull()))
    whole = F.forall(rolling, lambda s: (s["rows"] == s["_expected"]) & s["variable"].isin(*quantiles)) & (F.size(rolling) == len(quantiles))
    normal = complete_normal_submitters(submissions, quantiles).withColumn("_done", F.lit(True))
    chosen = users.join(normal, ["challenge_id", "user_id"], "left").withColumn("_use", F.when(whole & F.col("_done").isNull(), rolling).otherwise(sent))
    return chosen.select("resource_id", "challenge_id", "user_id", F.explode("_use").alias("_s")).select(*SERIES[:3], "_s.variable", "_s.points", "_s.n")


def _first() -> Column:
    return F.element_at("points", 1)["datetime"]


def _last() -> Column:
    return F.element_at("points", -1)["datetime"]


def presence(slot_minutes: int, known_only: bool = True) -> Column:
    """Bits of the slots with a value (or of all rows), counted from the profile's first slot, in words of 64."""
    first = _first()

    def place(p: Column) -> Column:
        return F.floor(F.timestamp_diff("MINUTE", first, p["datetime"]) / slot_minutes).cast("int")

    words = F.sequence(F.lit(0), F.floor(F.timestamp_diff("MINUTE", first, _last()) / (64 * slot_minutes)).cast("int"))
    known = F.transform(F.filter("points", lambda p: p["value"].isNotNull()) if known_only else F.col("points"), place)
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(i, F.lit(64)).cast("int"))
    return F.transform(words, lambda w: F.aggregate(
        F.filter(known, lambda i: F.floor(i / 64) == w), F.lit(0).cast("bigint"), lambda bits, i: bits.bitwiseOR(bit(i))))


def _count_from(present: Column, first: Column, edge: Column, slot_minutes: int) -> Column:
    """Slots with a value at or after ``edge``."""
    skip = F.ceil(elapsed_seconds(first, edge) / (60 * slot_minutes)).cast("int")

    def kept(word: Column, w: Column) -> Column:
        past = F.least(F.greatest(skip - w * 64, F.lit(0)), F.lit(64))
        mask = F.when(past >= 64, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftleft", F.lit(-1).cast("bigint"), past))
        return F.bit_count(word.bitwiseAND(mask))

    return F.aggregate(F.transform(present, kept), F.lit(0).cast("bigint"), lambda n, x: n + x)


def series_days(profiles: DataFrame, slot_minutes: int = 15, with_rows: bool = False) -> DataFrame:
    """Per profile: its series, first and last slot, ``n`` and the bits of known slots (``present``; with ``sent``, those of all rows); no values."""
    more = [presence(slot_minutes, known_only=False).alias("sent")] if with_rows else []
    return profiles.select("resource_id", "challenge_id", "user_id", "variable", _first().alias("first"), _last().alias("last"), "n",
                           presence(slot_minutes).alias("present"), *more)


def pack_history(rows: DataFrame, slot_minutes: int = 15) -> DataFrame:
    """Profiles of a history that belongs to no challenge: one for each series and day, named by the day."""
    return pack(rows.withColumn("challenge_id", F.to_date("datetime").cast("string")), slot_minutes)


def _passed(counts: DataFrame, keys: Sequence[str], guard: str, needed: int) -> DataFrame:
    """Users with ``needed`` values in each variable; where nobody has, all."""
    per_user = counts.groupBy(*keys, "user_id").agg((F.min("_n") >= needed).alias("_ok"))
    if guard == "global":
        nobody = per_user.agg((F.count(F.when(F.col("_ok"), 1)) == 0).alias("_none")).scalar()
        return per_user.filter(F.col("_ok") | nobody).select(*keys, "user_id")
    any_ok = per_user.groupBy(*keys).agg(F.max("_ok").alias("_any"))
    return per_user.join(any_ok, list(keys)).filter(F.col("_ok") | ~F.col("_any")).select(*keys, "user_id")


def history_gate(days: DataFrame, lookback_days: int = 7, min_days: int = 6, slots_per_day: int = 96, guard: str = "resource") -> DataFrame:
    """``gates.submission_history_gate`` over ``series_days``: (resource_id, user_id) with enough recent values."""
    if guard not in ("resource", "global"):
        raise ValueError("guard must be 'resource' or 'global'")
    series = ["resource_id", "user_id", "variable"]
    edge = F.col("_end") - minutes_interval(lookback_days * 1440)
    ends = days.groupBy(*series).agg(F.max("last").alias("_end"))
    inside = F.when(F.col("first") >= edge, F.col("n")).otherwise(_count_from(F.col("present"), F.col("first"), edge, 1440 // slots_per_day))
    counts = days.join(ends, series).filter(F.col("last") >= edge).groupBy(*series).agg(F.sum(inside).alias("_n"))
    return _passed(counts, ["resource_id"], guard, min_days * slots_per_day)


def complete_users(profiles: DataFrame, challenges: DataFrame, quantiles: Sequence[str] = QUANTILES, slot_minutes: int = 15) -> DataFrame:
    """(challenge_id, user_id) with a value for every slot of every quantile; reads no points."""
    counts = profiles.groupBy("challenge_id", "user_id").agg(*[F.max(F.when(F.col("variable") == q, F.col("n"))).alias(q) for q in quantiles])
    expected = challenges.select("challenge_id", slot_count(F.col("start_datetime"), F.col("end_datetime"), slot_minutes).alias("_expected"))
    full = F.lit(True)
    for q in quantiles:
        full = full & (F.col(q) == F.col("_expected"))
    return counts.join(expected, "challenge_id").filter(full).select("challenge_id", "user_id")


def sized(block: DataFrame) -> DataFrame:
    """Profiles laid out by challenge and variable with ``n_forecasters``, counted where they lie.

    The path of huge groups joins on the keys, so none without one has a size that leads there.
    """
    if "n_forecasters" in block.columns:
        return block
    whole = F.concat("resource_id", "challenge_id", "variable").isNotNull()
    n = F.when(whole, F.count(F.lit(1)).over(Window.partitionBy("challenge_id", "variable"))).otherwise(F.lit(0))
    return block.repartition("challenge_id", "variable").withColumn("n_forecasters", n)


def with_group_size(block: DataFrame) -> DataFrame:
    """Adds ``n_forecasters``: profiles of the (challenge, variable), which bounds every slot's group."""
    sizes = block.groupBy("challenge_id", "variable").agg(F.count(F.lit(1)).alias("n_forecasters"))
    return block.join(sizes, ["challenge_id", "variable"])


def observed_chunks(measurements: DataFrame, chunk_minutes: int, slot_minutes: int) -> DataFrame:
    """(resource_id, chunk, observed): the measured values of a chunk by slot, NULL where there is none."""
    place = F.floor(F.timestamp_diff("MINUTE", F.col("chunk"), F.col("datetime")) / slot_minutes).cast("int")
    known = measurements.filter(F.col("value").isNotNull()).withColumn("chunk", slot_start(F.col("datetime"), chunk_minutes))
    slots = F.sequence(F.lit(0), F.lit(chunk_minutes // slot_minutes - 1))
    pairs = known.groupBy("resource_id", "chunk").agg(F.map_from_entries(F.collect_list(F.struct(place.alias("k"), F.col("value").alias("v")))).alias("_m"))
    return pairs.select("resource_id", "chunk", F.transform(slots, lambda i: F.element_at("_m", i)).alias("observed"))


def chunk_losses(profiles: DataFrame, measurements: DataFrame, chunk_minutes: int, slot_minutes: int, loss) -> DataFrame:
    """Loss sums and counts per (resource, user, variable, chunk), as ``scoring.series_losses`` has them.

    Profiles meet the measured values chunk by chunk; single slots only exist between the join
    and the partial sums of the same task.  ``loss`` is a function of variable, observed, forecast.
    """
    # They meet by whole days where chunks fit into days: a profile is sent once for each, however many chunks it has.
    meet = 1440 if 1440 % chunk_minutes == 0 else chunk_minutes
    chunk = lambda p: slot_start(p["datetime"], meet)
    cut = profiles.select("resource_id", "user_id", "variable", "points", F.explode(F.array_distinct(F.transform("points", chunk))).alias("chunk"))
    met = cut.join(observed_chunks(measurements, meet, slot_minutes), ["resource_id", "chunk"])
    rows = met.select("resource_id", "user_id", "variable", "chunk", "observed", F.explode("points").alias("_p")).filter(
        (chunk(F.col("_p")) == F.col("chunk")) & F.col("_p.value").isNotNull())
    place = F.floor(F.timestamp_diff("MINUTE", F.col("chunk"), F.col("_p.datetime")) / slot_minutes).cast("int")
    pairs = rows.select("resource_id", "chunk", "user_id", "variable", slot_start(F.col("_p.datetime"), chunk_minutes).alias("datetime"),
                        F.get("observed", place).alias("observed"), F.col("_p.value").alias("forecast")).filter(F.col("observed").isNotNull())
    # By the day too, which the slot decides: the rows of a group lie together since they met.
    return pairs.groupBy("resource_id", "chunk", "user_id", "variable", "datetime").agg(
        F.sum(loss(F.col("variable"), F.col("observed"), F.col("forecast"))).alias("loss"), F.count(F.lit(1)).alias("n")).drop("chunk")
