"""Budget accounting in integer nano-euros over a recorded log of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: bytes of framing that a reservation adds to the prompt's.
FRAMING = 4096


def nano(value: Column | int) -> Column:
    return (F.lit(value) if isinstance(value, int) else value).cast("decimal(20,0)")


def cost(input_tokens: Column, output_tokens: Column, input_price: Column | int, output_price: Column | int) -> Column:
    """Price of the tokens; null when a count is."""
    return (nano(input_tokens) * nano(input_price) + nano(output_tokens) * nano(output_price)).cast("decimal(38,0)")


def reservation(prompt: Column, max_output: Column | int, input_price: Column | int, output_price: Column | int) -> Column:
    """What a request can cost at most: the prompt's bytes and framing as tokens, and all output tokens."""
    return cost(F.octet_length(prompt) + FRAMING, max_output if isinstance(max_output, Column) else F.lit(max_output), input_price, output_price)


def upper_bound(reservations: DataFrame, limit: int, *by: str) -> DataFrame:
    """What a dry run may cost at most: `requests`, the sum of `reserved`, and whether it is `within` the limit. A sum beyond 38 digits is null, and not within."""
    found = reservations.groupBy(*by).agg(F.count(F.lit(1)).alias("requests"), F.try_sum(F.col("reserved").cast("decimal(38,0)")).cast("decimal(38,0)").alias("reserved"))
    none = (F.col("requests") == 0) | (F.col("reserved") <= F.lit(limit).cast("decimal(38,0)"))
    return found.withColumn("within", F.coalesce(none, F.lit(False)))


def settlement(log: DataFrame, limit: int) -> DataFrame:
    """Each request of a run in order (`run`, `seq`, `reserved`, `observed`, `failed`): charge, running account, outcome.

    An unknown or unpriceable cost keeps the reservation. A run stops before the first request whose
    reservation would pass `limit` (`over_limit`), and behind one that cost more than was reserved
    (`exceeded`) or, with `fail_fast`, failed; later requests of the run are `not_sent`.
    """
    w = Window.partitionBy("run").orderBy("seq")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = log.withColumn("charged", F.coalesce("observed", "reserved").cast("decimal(38,0)"))
    rows = rows.withColumn("before", F.coalesce(F.sum("charged").over(earlier), F.lit(0)).cast("decimal(38,0)"))
    over = F.col("before") + F.col("reserved") > F.lit(limit).cast("decimal(38,0)")
    exceeded = F.col("charged") > F.col("reserved")
    fast = F.col("failed") & F.col("fail_fast")
    rows = rows.withColumn("stop", F.when(over, "over_limit").when(exceeded, "exceeded").when(fast, "failed"))
    rows = rows.withColumn("stopped", F.coalesce(F.max(F.col("stop").isNotNull()).over(earlier), F.lit(False)))
    state = F.when(F.col("stopped"), "not_sent").otherwise(F.coalesce("stop", F.lit("settled")))
    sent = state.isin("settled", "exceeded", "failed")
    return rows.select("run", "seq", state.alias("state"), F.when(sent, F.col("charged")).alias("charged"), (sent & F.col("observed").isNull()).alias("reservation_retained"), F.when(sent, F.col("before") + F.col("charged")).alias("account"))


def totals(settled: DataFrame) -> DataFrame:
    return settled.groupBy("run").agg(F.count_if(F.col("charged").isNotNull()).alias("sent"), F.coalesce(F.sum("charged"), F.lit(0)).cast("decimal(38,0)").alias("charged"), F.count_if("reservation_retained").alias("uncertain"))


def imbalances(settled: DataFrame, stored: DataFrame) -> DataFrame:
    """Runs whose stored total (`run`, `total`) is not the sum of their charges."""
    return totals(settled).join(stored, "run", "full_outer").filter(~F.col("charged").eqNullSafe(F.col("total").cast("decimal(38,0)")))


#: Fixed value: what an interrupted request is recorded as.
INTERRUPTED = "interrupted request: outcome and billing unknown; not replayed; full reservation retained"


def requests(log: DataFrame, wait: int) -> DataFrame:
    """The requests of runs from their events: `run`, `place`, `case_id`, `state`, `charged`, `reservation_retained`, `account`, `error`.

    `log` has `run`, `at` (time), `seq`, `kind`, `place`, `case_id`, `reserved` and `observed` (whole nano-euros). A run
    reserves a place, then settles it; an unknown cost keeps the reservation (`uncertain`). A reservation
    is `interrupted` if it is not settled within `wait` milliseconds, or before the run resumes: its
    reservation stays, and what comes later is passed over. Places only go up, so no request is sent twice:
    another reservation of a place, or of an earlier one, is passed over too. `account` is what the run has
    settled and reserved up to a settlement.
    """
    ms = F.unix_millis("at")
    run = Window.partitionBy("run").orderBy(ms, "seq")
    later, earlier = run.rowsBetween(1, Window.unboundedFollowing), run.rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("run", "place").orderBy(ms, "seq").rowsBetween(1, Window.unboundedFollowing)
    key = F.struct(ms.alias("ms"), "seq")
    settled = F.struct(key.alias("key"), "observed")
    rows = log.withColumns({
        "ms": ms, "resumed": F.min(F.when(F.col("kind") == "resume", key)).over(later),
        "before": F.max(F.when(F.col("kind") == "reserve", F.col("place"))).over(earlier), "settled": F.first(F.when(F.col("kind") == "settle", settled), True).over(own),
    })
    rows = rows.filter((F.col("kind") == "reserve") & (F.col("before").isNull() | (F.col("place") > F.col("before"))))
    in_time = F.coalesce((F.col("settled.key.ms") < F.col("ms") + wait) & (F.col("resumed").isNull() | (F.col("settled.key") < F.col("resumed"))), F.lit(False))
    observed = F.when(in_time, F.col("settled.observed"))
    rows = rows.select(
        "run", "place", "case_id", "reserved", F.when(~in_time, "interrupted").when(observed.isNull(), "uncertain").otherwise("settled").alias("state"), F.coalesce(observed, "reserved").alias("charged"),
        F.struct(F.col("ms"), F.col("seq")).alias("begun"), F.when(in_time, F.col("settled.key")).alias("ended"),
    )
    changes = F.array(F.struct(F.col("begun").alias("key"), F.col("reserved").alias("by"), F.lit(False).alias("ends")), F.struct(F.col("ended").alias("key"), (F.col("charged") - F.col("reserved")).alias("by"), F.lit(True).alias("ends")))
    moved = rows.select("*", F.explode(F.filter(changes, lambda x: x["key"].isNotNull() | x["ends"])).alias("c"))
    account = F.sum(F.coalesce("c.by", F.lit(0))).over(Window.partitionBy("run").orderBy(F.col("c.key").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0))
    moved = moved.withColumn("account", F.when(F.col("c.key").isNotNull(), account)).filter("c.ends")
    lost = F.col("state") == "interrupted"
    return moved.select("run", "place", "case_id", "state", F.col("charged").cast("long").alias("charged"), (F.col("state") != "settled").alias("reservation_retained"), F.col("account").cast("long").alias("account"), F.when(lost, INTERRUPTED).alias("error"))
