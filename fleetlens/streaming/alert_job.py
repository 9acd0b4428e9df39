"""The alert job: polled snapshots in, a lasting store, its status history and an outbox out.

``AlertStore.apply`` is a ``foreachBatch`` function.  A micro-batch of polls becomes events per alert (new,
recurrence, resolved, repeat), which are appended under the batch's version, together with the current state
of every fingerprint, one row each.  A version counts once its commit is written; one that failed half-way
is overwritten when the batch comes again, and a batch or poll that was already applied changes nothing.
The store's rows, the history and the outbox are views of the events up to a version, so that
every earlier version stays readable and no row is ever changed in place.

Verdicts are those of ``alerts.decide``: by start time, stored state and seconds since the resolution.  Polls
are taken in the order of their times; a poll without alerts resolves everything, one that failed is not
there.  What a task holds of an alert is bounded by the polls of a micro-batch, so limit the files of a trigger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetlens.functions.alerts import is_live
from fleetlens.operators.alerts import AlertFilter, filter_condition, route, valid
from fleetlens.params import AlertLimits
from fleetlens.plans.ordered import OrderedGroups

#: what a snapshot says of an alert
FACTS = {"state": "string", "starts_us": "bigint", "ends_us": "bigint", "alertname": "string", "severity": "string",
         "summary": "string", "description": "string", "raw_data": "string"}
#: what is known of a fingerprint between two batches
STATE = {"fingerprint": "string", "status": "string", "starts_us": "bigint", "resolved_us": "bigint", "push_us": "bigint",
         "repeats": "bigint", "alertname": "string", "severity": "string"}
EVENT = {"us": "bigint", "kind": "string", "repeats": "bigint", **FACTS}
INSERTS = ("new", "recurrence")


def _ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"{k} {v}" for k, v in fields.items())


def poll_rows(alerts: DataFrame, rule: AlertFilter | None = None) -> DataFrame:
    """Parsed alerts with ``poll_us`` as rows of the job.  Alerts that are not valid or that the filter leaves out
    lose their fingerprint, so that their poll still counts."""
    keep = valid(alerts) if rule is None else valid(alerts) & filter_condition(rule)
    label, note = F.col("labels"), F.col("annotations")
    return alerts.select(
        "poll_us", F.when(keep, F.col("fingerprint")).alias("fingerprint"), "state",
        F.unix_micros("starts_at").alias("starts_us"), F.unix_micros("ends_at").alias("ends_us"),
        label["alertname"].alias("alertname"), label["severity"].alias("severity"), note["summary"].alias("summary"),
        note["description"].alias("description"), F.to_json(F.struct("fingerprint", "state", "labels", "annotations"))
        .alias("raw_data"))


def _fold(polls: list[int], limits: AlertLimits) -> Column:
    """State after the polls, and the events on the way, of one fingerprint; a row has its state before them
    and ``seen``, a map from poll to facts."""
    event = f"array<struct<{', '.join(f'{k}:{v}' for k, v in EVENT.items())}>>"
    names = ("status", "starts_us", "resolved_us", "push_us", "repeats", "alertname", "severity")
    begin = F.struct(*[F.col(c) for c in names], F.array().cast(event).alias("events"))

    def step(acc, poll):
        seen = F.try_element_at("seen", poll)
        here, live = seen.isNotNull(), F.coalesce(is_live(acc["status"]), F.lit(False))
        showing = here & F.coalesce(is_live(seen["state"]), F.lit(False))
        ended = acc["resolved_us"]
        back = (acc["status"] == "resolved") & ~acc["starts_us"].eqNullSafe(seen["starts_us"]) & (
            ended.isNull() | (poll - ended >= limits.recurrence_s * 1_000_000))
        late = poll - acc["push_us"] >= limits.repeat_push_s * 1_000_000
        kind = (F.when(showing & acc["status"].isNull(), "new").when(showing & back, "recurrence")
                .when(~here & live, "resolved").when(here & live & late, "repeat"))
        fresh = kind.isin(*INSERTS)
        facts = [F.when(fresh, seen[c]).otherwise(acc[c] if c in names else F.lit(None)).cast(t).alias(c)
                 for c, t in FACTS.items()]
        item = F.struct(poll.alias("us"), kind.alias("kind"), acc["repeats"].alias("repeats"), *facts)

        def after(name, value):
            return value.alias(name)
        return F.struct(
            after("status", F.when(fresh, seen["state"]).when(kind == "resolved", F.lit("resolved")).otherwise(acc["status"])),
            after("starts_us", F.when(fresh, seen["starts_us"]).otherwise(acc["starts_us"])),
            after("resolved_us", F.when(kind == "resolved", poll).otherwise(acc["resolved_us"])),
            after("push_us", F.when(fresh | (kind == "repeat"), poll).otherwise(acc["push_us"])),
            after("repeats", acc["repeats"] + F.when(kind == "repeat", 1).otherwise(0)),
            after("alertname", F.when(fresh, seen["alertname"]).otherwise(acc["alertname"])),
            after("severity", F.when(fresh, seen["severity"]).otherwise(acc["severity"])),
            after("events", F.when(kind.isNull(), acc["events"]).otherwise(F.concat(acc["events"], F.array(item)))))
    return F.aggregate(F.array(*[F.lit(p).cast("bigint") for p in polls]), begin, step)


class AlertStore:
    """Versions of the alert tables in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, limits: AlertLimits = AlertLimits()):
        self.spark, self.path, self.limits = spark, path.rstrip("/"), limits

    # ---- versions ---------------------------------------------------------------------------
    def _table(self, name: str, fields: dict[str, str], version: int | None, exact: bool = False) -> DataFrame:
        folder, schema = f"{self.path}/{name}", _ddl(fields | {"version": "bigint"})
        place = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(folder)
        if version is None:
            return rows
        return rows.where(F.col("version") == version) if exact else rows.where(F.col("version") <= version)

    def head(self) -> tuple[int, int]:
        """Newest committed version and its last poll; (-1, -1) for none.  One row per version is read."""
        last = self._table("commits", {"last_poll_us": "bigint"}, None).agg(
            F.max(F.struct("version", "last_poll_us")).alias("m")).first().m
        return (last.version, last.last_poll_us) if last else (-1, -1)

    def _write(self, df: DataFrame, name: str, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/version={version}")

    # ---- the job ----------------------------------------------------------------------------
    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Add one micro-batch: rows of ``poll_us``, fingerprint (null: nothing, but the poll counts), ``FACTS``.

        Rows of a fingerprint that a poll repeats count once (the one with the newest start).  Polls that
        are not after the last applied one are left out.
        """
        done, last = self.head()
        if batch_id <= done:
            return
        fresh = batch.where(F.col("poll_us") > last).persist()
        try:
            polls = sorted(r.poll_us for r in fresh.select("poll_us").distinct().collect())  # the batch's polls
            if polls:
                self._advance(fresh, polls, done, batch_id)
            else:
                self._write(self.state(done).drop("version"), "state", batch_id)
            commit = self.spark.createDataFrame([(polls[-1] if polls else last,)], "last_poll_us bigint")
            self._write(commit.coalesce(1), "commits", batch_id)
        finally:
            fresh.unpersist()

    def _advance(self, fresh: DataFrame, polls: list[int], done: int, version: int) -> None:
        facts = F.struct("starts_us", "state", *[c for c in FACTS if c not in ("starts_us", "state")])
        seen = (fresh.where("fingerprint <> ''").groupBy("fingerprint", "poll_us").agg(F.max(facts).alias("f"))
                .groupBy("fingerprint").agg(F.map_from_entries(F.collect_list(F.struct("poll_us", "f"))).alias("seen")))
        before = self.state(done).drop("version")
        both = before.join(seen, "fingerprint", "full").fillna({"repeats": 0})
        after = both.select("fingerprint", _fold(polls, self.limits).alias("a")).persist()
        try:
            self._write(after.select("fingerprint", F.explode("a.events").alias("e")).select("fingerprint", "e.*"),
                        "events", version)
            known = after.select("fingerprint", "a.*").drop("events").where("status IS NOT NULL")
            self._write(known.select(*STATE), "state", version)
        finally:
            after.unpersist()

    def start(self, polls: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Run the job over a stream of polls."""
        return (polls.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
                .trigger(**(trigger or {"availableNow": True})).start())

    # ---- what it knows ----------------------------------------------------------------------
    def state(self, version: int | None = None) -> DataFrame:
        """One row per fingerprint that was ever stored."""
        return self._table("state", STATE, self.head()[0] if version is None else version, exact=True)

    def events(self, version: int | None = None) -> DataFrame:
        return self._table("events", {"fingerprint": "string", **EVENT}, self.head()[0] if version is None else version)

    def rows(self, version: int | None = None) -> DataFrame:
        """The store's nineteen columns as of a version: a row per new or recurring alert.

        A resolution settles all rows of its fingerprint, so they carry the latest one since they were stored.
        ``id`` is a hash of fingerprint and time.
        """
        events = self.events(version)
        kind = F.col("kind")

        def last(*kinds):
            return F.max(F.when(kind.isin(*kinds), F.col("us")))

        def times(name):
            return F.sum((kind == name).cast("bigint"))
        facts = events.groupBy("fingerprint").agg(
            last("resolved").alias("_ended"), last(*INSERTS, "repeat").alias("_group"), last(*INSERTS).alias("_table"),
            times("repeat").alias("_repeats"), times("recurrence").alias("recurrence_count"))
        told = events.where("kind = 'resolved'").select("fingerprint", "starts_us", F.lit(True).alias("_told")).distinct()
        rows = events.where(kind.isin(*INSERTS)).join(facts, "fingerprint")
        theirs = told.withColumnsRenamed({"fingerprint": "_f", "starts_us": "_s"})
        rows = rows.join(theirs, (F.col("fingerprint") == F.col("_f")) & F.col("starts_us").eqNullSafe(F.col("_s")), "left")
        ended = F.when(F.col("_ended") >= F.col("us"), F.col("_ended"))

        def at(column):
            return F.timestamp_micros(column)
        return rows.select(
            F.xxhash64("fingerprint", "us").alias("id"), "fingerprint", "alertname",
            F.when(ended.isNotNull(), "resolved").otherwise(F.col("state")).alias("status"), "severity", "summary",
            "description", at(F.col("starts_us")).alias("starts_at"), at(F.col("ends_us")).alias("ends_at"),
            F.when(F.col("_told"), "recovery_reported").otherwise("reported").alias("push_status"),
            at(F.col("_group")).alias("group_push_time"), at(F.col("_table")).alias("table_push_time"),
            (F.col("_repeats") - F.col("repeats")).alias("repeat_push_count"), at(ended).alias("resolved_at"),
            "recurrence_count", (kind == "recurrence").alias("is_recurrence"),
            at(F.coalesce(ended, F.col("us"))).alias("updated_at"), at(F.col("us")).alias("created_at"), "raw_data")

    def history(self, version: int | None = None, row_floor: int | None = None) -> DataFrame:
        """Every status of every fingerprint with the times from and to which it held; the last has no end."""
        changes = self.events(version).where("kind <> 'repeat'").select(
            "fingerprint", F.when(F.col("kind") == "resolved", "resolved").otherwise(F.col("state")).alias("status"),
            F.col("us").alias("valid_from"), (-F.col("us")).alias("_back"))
        groups = OrderedGroups(changes, ["fingerprint"], ["_back"], halo=1, row_floor=row_floor)
        # walking backwards, the lag is the next change in time
        return groups.trim(groups.rows().withColumn("valid_to", F.lag("valid_from").over(groups.window()))).drop("_back")

    def outbox(self, version: int | None = None) -> DataFrame:
        """Messages to send, a row per channel: fingerprint, starts_us, state, us, severity, channel.

        A recovery is told once for each fingerprint and start, however often that start is resolved.
        """
        events = self.events(version)
        gone = (events.where("kind = 'resolved'").groupBy("fingerprint", "starts_us")
                .agg(F.min("us").alias("us"), F.min_by("severity", "us").alias("severity"),
                     F.min_by("alertname", "us").alias("alertname"), F.lit("resolved").alias("state")))
        rest = events.where("kind <> 'resolved'").select("fingerprint", "starts_us", "us", "severity", "alertname",
                                                         F.col("kind").alias("state"))
        return route(rest.unionByName(gone))
