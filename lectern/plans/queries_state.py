"""Stateful queries: batch forms with SQL, and streams run to the end of the available input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.plans.registry import query
from lectern.plans.views import table
from lectern.streaming import jobs


@query("T04")
def fixed_hour_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests against site-wide caps and a window for each key; order decides, so it is tested against a plain fold."""
    from lectern.streaming import quota

    requests = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.col("ts").alias("at"))
    return quota.consume(requests).select(F.col("id").alias("event_id"), "verdict")


@query("T03 P03", """WITH n AS (SELECT CAST(max(ts) AS DATE) AS today FROM events) SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events, n WHERE CAST(ts AS DATE) BETWEEN today - 6 AND today""")
def rolling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven days that end today, both ends included."""
    events = table(spark, sf_dir, "events")
    today = events.agg(F.to_date(F.max("ts")).alias("today"))
    day = F.to_date("ts")
    return events.crossJoin(F.broadcast(today)).where(day.between(F.date_sub("today", 6), F.col("today"))).select("event_id", day.cast("string").alias("day"))


@query("T05", """WITH n AS (SELECT max(ts) - INTERVAL 1 DAY AS now FROM events), b AS (SELECT user_id, CASE WHEN user_id % 17 <> 0 THEN max(ts) + INTERVAL 6 HOUR END AS until FROM events GROUP BY user_id)
SELECT count(*) FILTER (WHERE until IS NULL OR until <= now) AS deleted, count(*) FILTER (WHERE until > now) AS live, min(until) FILTER (WHERE until > now) AS next_alarm FROM b, n""")
def expiry_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets whose time is up, or that have none, go; the first of the others sets the next alarm."""
    events = table(spark, sf_dir, "events")
    now = events.agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("now"))
    buckets = events.groupBy("user_id").agg((F.max("ts") + F.expr("INTERVAL 6 HOUR")).alias("until")).withColumn("until", F.when(F.col("user_id") % 17 != 0, F.col("until")))
    live = F.coalesce(F.col("until") > F.col("now"), F.lit(False))
    return buckets.crossJoin(F.broadcast(now)).agg(F.count_if(~live).alias("deleted"), F.count_if(live).alias("live"), F.min(F.when(live, F.col("until"))).alias("next_alarm"))


@query("T01 T02", """SELECT user_id, min(ts) AS first_seen, count(*) AS hits FROM events WHERE user_id IS NOT NULL GROUP BY user_id""")
def seen_state_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of arrivals merged into one state, as an idempotent upsert."""
    events = table(spark, sf_dir, "events").where("user_id is not null")
    def state(part: DataFrame) -> DataFrame:
        return part.groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.count("*").alias("hits"))

    both = state(events.where("event_id % 2 = 0")).unionByName(state(events.where("event_id % 2 = 1")))
    return both.groupBy("user_id").agg(F.min("first_seen").alias("first_seen"), F.sum("hits").alias("hits"))


@query("T09", """WITH p AS (SELECT c_nationkey AS venue, CAST(year(o_orderdate) AS BIGINT) AS y, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL), l AS (SELECT *, lag(n) OVER (PARTITION BY venue ORDER BY y) AS before FROM p)
SELECT venue, y, n, CASE WHEN n < greatest(20, coalesce(CAST(floor(before * 0.8) AS BIGINT), 0)) THEN 'below_minimum' WHEN n > CAST(ceil(before * 1.25) AS BIGINT) THEN 'above_maximum' ELSE 'passed' END AS state FROM l""")
def previous_edition_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts between a floor or a share of the edition before, and a multiple of it."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").cast("long").alias("y"))
    counts = orders.join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("venue")), "c_custkey").groupBy("venue", "y").agg(F.count("*").alias("n"))
    before = F.lag("n").over(Window.partitionBy("venue").orderBy("y"))
    least = F.greatest(F.lit(20), F.coalesce(F.floor(F.col("before") * F.lit(0.8)), F.lit(0)))
    state = F.when(F.col("n") < least, "below_minimum").when(F.col("n") > F.ceil(F.col("before") * F.lit(1.25)), "above_maximum").otherwise("passed")
    return counts.withColumn("before", before).select("venue", "y", "n", state.alias("state"))


@query("T10 G22", """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, CASE WHEN event_type IN ('error', 'purchase') THEN event_type ELSE '' END AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r(user_id, event_id, k, told, since, decision) AS (SELECT user_id, event_id, k, p, CASE WHEN p <> '' THEN ts END, CASE WHEN p <> '' THEN 'new' ELSE 'none' END FROM e WHERE k = 1
UNION ALL SELECT e.user_id, e.event_id, e.k, CASE WHEN e.p = '' THEN '' WHEN e.p <> r.told OR e.ts - r.since >= INTERVAL 72 HOUR THEN e.p ELSE r.told END, CASE WHEN e.p = '' THEN NULL WHEN e.p <> r.told OR e.ts - r.since >= INTERVAL 72 HOUR THEN e.ts ELSE r.since END,
  CASE WHEN e.p = '' THEN CASE WHEN r.told <> '' THEN 'resolved' ELSE 'none' END WHEN e.p <> r.told THEN 'new' WHEN e.ts - r.since >= INTERVAL 72 HOUR THEN 'reminder' ELSE 'none' END FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT event_id, decision FROM r""")
def alert_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as looks of a watchdog: errors and purchases are its problems, told again after three days."""
    from lectern.streaming import alerts

    problem = F.when(F.col("event_type").isin("error", "purchase"), F.array("event_type")).otherwise(F.array().cast("array<string>"))
    looks = table(spark, sf_dir, "events").where("user_id is not null").select(F.col("user_id").alias("watch"), F.col("event_id").alias("id"), F.col("ts").alias("at"), alerts.fingerprint(problem).alias("problems"))
    return alerts.decisions(looks, interval_hours=72).select(F.col("id").alias("event_id"), "decision")


@query("T06", """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, event_type = 'purchase' AS done, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r(user_id, event_id, k, owner, until, outcome) AS (SELECT user_id, event_id, k, CASE WHEN NOT done THEN event_id % 3 END, CASE WHEN NOT done THEN ts + INTERVAL 6 HOUR END, CASE WHEN done THEN 'not_owner' ELSE 'claimed' END FROM e WHERE k = 1
UNION ALL SELECT e.user_id, e.event_id, e.k, CASE WHEN e.done THEN CASE WHEN r.owner = e.event_id % 3 THEN NULL ELSE r.owner END WHEN coalesce(r.until > e.ts AND r.owner IS NOT NULL, false) THEN r.owner ELSE e.event_id % 3 END,
  CASE WHEN e.done THEN CASE WHEN r.owner = e.event_id % 3 THEN NULL ELSE r.until END WHEN coalesce(r.until > e.ts AND r.owner IS NOT NULL, false) THEN r.until ELSE e.ts + INTERVAL 6 HOUR END,
  CASE WHEN e.done THEN CASE WHEN r.owner = e.event_id % 3 THEN 'released' ELSE 'not_owner' END WHEN coalesce(r.until > e.ts AND r.owner IS NOT NULL, false) THEN 'held' ELSE 'claimed' END FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT event_id, outcome FROM r""")
def single_flight_lease(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of six hours per key; a purchase releases the claim if its owner makes it."""
    moves = table(spark, sf_dir, "events").where("user_id is not null").select("user_id", "event_id", "ts", (F.col("event_id") % 3).alias("owner"), (F.col("event_type") == "purchase").alias("done"))
    return jobs.leases(moves, hours=6)


@query("T12", """SELECT event_id, CASE max(CASE WHEN value < 5 THEN 2 WHEN value < 20 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) WHEN 2 THEN 'open' WHEN 1 THEN 'searches-blocked' ELSE 'closed' END AS breaker FROM events""")
def budget_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credits left below the cost of a list open the breaker, below that of a search block searches; within a run (a
    user's events) it never relaxes."""
    rank = F.when(F.col("value") < 5, 2).when(F.col("value") < 20, 1).otherwise(0)
    worst = F.max(rank).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select("event_id", F.when(worst == 2, "open").when(worst == 1, "searches-blocked").otherwise("closed").alias("breaker"))


@query("T14", """WITH c AS (SELECT user_id, event_type, event_id % 2 AS prompt, max(ts) AS at FROM events WHERE ts < TIMESTAMP '2024-01-10' AND user_id IS NOT NULL GROUP BY ALL)
SELECT e.event_id, CASE WHEN c.at IS NULL THEN 'miss' WHEN e.ts - c.at > INTERVAL 10 DAY THEN 'stale' ELSE 'hit' END AS cache FROM events e LEFT JOIN c ON c.user_id = e.user_id AND c.event_type = e.event_type AND c.prompt = e.event_id % 2 WHERE e.ts >= TIMESTAMP '2024-01-10'""")
def classification_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers are kept by pair, model and prompt, for ten days."""
    day, keys = F.lit("2024-01-10").cast("timestamp"), ["user_id", "event_type", "prompt"]
    events = table(spark, sf_dir, "events").withColumn("prompt", F.col("event_id") % 2)
    cached = events.where((F.col("ts") < day) & F.col("user_id").isNotNull()).groupBy(*keys).agg(F.max("ts").alias("at"))
    state = F.when(F.col("at").isNull(), "miss").when(F.col("ts") - F.col("at") > F.expr("INTERVAL 10 DAY"), "stale").otherwise("hit")
    return events.where(F.col("ts") >= day).join(cached, keys, "left").select("event_id", state.alias("cache"))


@query("T15 P26", """WITH l AS (SELECT event_type, user_id % 20 AS repo, max(struct_pack(ts := ts, id := event_id, v := value)) AS l FROM events GROUP BY ALL), n AS (SELECT max(ts) AS now FROM events)
SELECT event_type || ' [' || repo || ']' AS workflow, l.id AS last_run, CASE WHEN l.v < 10 THEN 'http' WHEN l.v < 15 THEN 'auth' WHEN now - l.ts > INTERVAL 1 DAY THEN 'stale' END AS problem FROM l, n""")
def workflow_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest run of each workflow, found by the marker at its title's end; errors and old runs are problems."""
    events = table(spark, sf_dir, "events")
    titled = events.select("ts", "event_id", "value", F.concat(F.lit("run of "), "event_type", F.lit(" ["), F.col("user_id") % 20, F.lit("]")).alias("title"))
    marked = titled.select("ts", "event_id", "value", F.regexp_extract("title", r"(\S+ \[[0-9]+\])$", 1).alias("workflow"))
    last = marked.groupBy("workflow").agg(F.max(F.struct("ts", "event_id", "value")).alias("l")).crossJoin(F.broadcast(events.agg(F.max("ts").alias("now"))))
    problem = F.when(F.col("l.value") < 10, "http").when(F.col("l.value") < 15, "auth").when(F.col("now") - F.col("l.ts") > F.expr("INTERVAL 1 DAY"), "stale")
    return last.select("workflow", F.col("l.event_id").alias("last_run"), problem.alias("problem"))


@query("T01 T04", """SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL""")
def streamed_hour_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.hour_counts(spark, f"{sf_dir}/events.parquet")


@query("T01", """SELECT DISTINCT user_id FROM events""")
def streamed_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.first_seen(spark, f"{sf_dir}/events.parquet")


def _probes(events: DataFrame) -> DataFrame:
    """A user is an edition: errors fail, signups publish, clicks find nothing, other events list as many items as
    their value tells, and another list with every forty."""
    hours = F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "publish").when(F.col("event_type") == "click", "unavailable").otherwise("snapshot")
    count = F.greatest(F.floor(F.col("value") / 40), F.lit(1)).cast("int") * 12
    items = F.array_join(F.transform(F.sequence(F.lit(1), count), lambda x: x.cast("string")), "\n")
    return events.select(F.col("user_id").alias("edition"), "event_id", hours.alias("hours"), kind.alias("kind"), count.cast("string").alias("listing"), items.alias("items_"))


@query("T07 T08")
def readiness_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.streaming import readiness

    return readiness.verdicts(_probes(table(spark, sf_dir, "events")))


@query("T07 T08")
def streamed_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.streaming import readiness

    return jobs.drained(readiness.streamed(_probes(jobs.landed(spark, f"{sf_dir}/events.parquet"))), "readiness", "append")
