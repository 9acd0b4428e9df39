"""Alert filters, the alert life cycle, routing and weekly reports."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.alerts import is_live, severity_level
from fleetlens.params import AlertLimits
from fleetlens.plans.automata import states_before
from fleetlens.plans.ordered import OrderedGroups


# ---- filters ------------------------------------------------------------------------------

@dataclass(frozen=True)
class AlertFilter:
    min_severity: str = "warning"
    exclude_names: tuple[str, ...] = ()
    include_names: tuple[str, ...] = ()
    exclude_labels: dict[str, str] = field(default_factory=dict)
    include_labels: dict[str, str] = field(default_factory=dict)


def _any_label(wanted: dict[str, str]) -> Column:
    out = F.lit(False)
    for key, value in wanted.items():
        out = out | F.coalesce(F.col("labels")[key] == value, F.lit(False))
    return out


def filter_condition(rule: AlertFilter) -> Column:
    """Names, lowest severity, excluded labels, at least one included label."""
    name = F.coalesce(F.col("labels")["alertname"], F.lit(""))
    level = severity_level(F.coalesce(F.col("labels")["severity"], F.lit("")))
    ok = level >= severity_level(F.lit(rule.min_severity))
    if rule.exclude_names:
        ok = ok & ~name.isin(*rule.exclude_names)
    if rule.include_names:
        ok = ok & name.isin(*rule.include_names)
    if rule.exclude_labels:
        ok = ok & ~_any_label(rule.exclude_labels)
    if rule.include_labels:
        ok = ok & _any_label(rule.include_labels)
    return ok


def keep_alerts(alerts: DataFrame, rule: AlertFilter) -> DataFrame:
    """Alerts that pass the configured filter."""
    return alerts.where(filter_condition(rule))


def find_alerts(alerts: DataFrame, alertname: str | None = None, status: str = "all",
                labels: dict[str, str] | None = None) -> DataFrame:
    """Ad-hoc filter: exact name, live / resolved state, label substrings that must all match."""
    out = alerts
    if alertname:
        out = out.where(F.col("labels")["alertname"] == alertname)
    if status == "active":
        out = out.where(is_live(F.col("state")))
    elif status == "resolved":
        out = out.where(F.col("state") == "resolved")
    for key, part in (labels or {}).items():
        out = out.where(F.contains(F.col("labels")[key], F.lit(part)))
    return out


def valid(alerts: DataFrame) -> Column:
    return ((F.coalesce("fingerprint", F.lit("")) != "") &
            (F.coalesce(F.col("labels")["alertname"], F.lit("")) != ""))


def checked_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.where(valid(alerts))


def rejected_alerts(alerts: DataFrame) -> DataFrame:
    """Quarantine with the reason."""
    reason = F.when(F.coalesce("fingerprint", F.lit("")) == "", "no_fingerprint").otherwise(
        "no_alertname")
    return alerts.where(~valid(alerts)).withColumn("reason", reason)


# ---- store --------------------------------------------------------------------------------

def latest_alerts(store: DataFrame) -> DataFrame:
    """Newest stored row per fingerprint; ``place = 1`` cuts before the shuffle."""
    order = [c for c in ("created_at", "event_id") if c in store.columns]
    new = Window.partitionBy("fingerprint").orderBy(*[F.col(c).desc() for c in order])
    return store.withColumn("_p", F.row_number().over(new)).where("_p = 1").drop("_p")


def newest_first(store: DataFrame) -> DataFrame:
    return store.orderBy(F.col("created_at").desc(), F.col("event_id").desc())


def active_fingerprints(store: DataFrame) -> DataFrame:
    return store.where("status <> 'resolved'").select("fingerprint").distinct()


def match_store(snapshot: DataFrame, store: DataFrame) -> DataFrame:
    """Snapshot rows with the newest stored state of their fingerprint (null: never stored)."""
    known = latest_alerts(store).select("fingerprint", F.col("status").alias("stored_status"),
                                        F.col("created_at").alias("stored_at"))
    return snapshot.join(known, "fingerprint", "left")


def snapshot_changes(snapshot: DataFrame, store: DataFrame) -> DataFrame:
    """Fingerprints only in the snapshot (new) and live in the store but gone now (resolved)."""
    now = snapshot.select("fingerprint").distinct()
    fresh = now.join(store.select("fingerprint").distinct(), "fingerprint", "left_anti")
    gone = active_fingerprints(store).join(now, "fingerprint", "left_anti")
    return fresh.withColumn("change", F.lit("new")).unionByName(
        gone.withColumn("change", F.lit("resolved")))


def decide(snapshot: DataFrame, store: DataFrame, as_of_us: int,
           limits: AlertLimits = AlertLimits()) -> DataFrame:
    """Verdict on every fingerprint of one snapshot, and on stored ones that are gone from it.

    new          never stored
    ongoing      newest stored row is live
    other        newest stored row is neither live nor resolved
    unchanged    resolved, and the snapshot still shows the same start
    recurrence   resolved, with another start, and no resolution in the last ``recurrence_s`` seconds
    suppressed   the same, but resolved more recently
    resolved     some stored row is unresolved, and the snapshot misses the fingerprint

    ``snapshot`` has fingerprint (once), state and starts_us; ``store`` has fingerprint, status,
    starts_us, resolved_us, us and event_id.  ``notify`` marks new and recurring alerts that the
    snapshot shows as live.  The store is reduced to a row per fingerprint before the join.
    """
    known = store.groupBy("fingerprint").agg(
        F.max_by(F.struct("status", "starts_us"), F.struct("us", "event_id")).alias("_last"),
        F.max("resolved_us").alias("_ended"), F.bool_or(F.col("status") != "resolved").alias("_open"))
    both = snapshot.withColumn("_here", F.lit(True)).join(known, "fingerprint", "full")
    status, ended = F.col("_last.status"), F.col("_ended")
    long_ago = ended.isNull() | (F.lit(as_of_us) - ended >= limits.recurrence_s * 1_000_000)
    verdict = (F.when(F.col("_here").isNull(), F.when(F.col("_open"), "resolved"))
               .when(F.col("_open").isNull(), "new").when(is_live(status), "ongoing")
               .when(status != "resolved", "other")
               .when(F.col("_last.starts_us").eqNullSafe(F.col("starts_us")), "unchanged")
               .when(long_ago, "recurrence").otherwise("suppressed"))
    fresh = F.col("verdict").isin("new", "recurrence")
    return (both.withColumn("verdict", verdict).where("verdict IS NOT NULL")
            .select("fingerprint", "verdict", (fresh & F.coalesce(is_live(F.col("state")), F.lit(False)))
                    .alias("notify")))


def settle_status(store: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Rows that exist when their fingerprint is resolved get state ``resolved`` and that time.

    ``us`` is when a row was stored; the first resolution at or after it settles the row, so a
    recurrence stored later stays as it is.
    """
    rows = store.drop("resolved_at").withColumns({
        "_back": -F.col("us"), "_stored": F.lit(1), "_end": F.lit(None).cast("bigint")})
    ends = resolutions.select("fingerprint", (-F.col("resolved_at")).alias("_back"),
                              F.lit(0).alias("_stored"), F.col("resolved_at").alias("_end"))
    # backwards in time, the nearest resolution is the smallest so far
    groups = OrderedGroups(rows.unionByName(ends, allowMissingColumns=True), ["fingerprint"],
                           ["_back", "_stored"])
    walked = groups.trim(groups.rows(), keep_piece=True)
    walked = groups.finish(groups.running(walked, -F.col("_end"), "_next", "max"))
    return (walked.where("_stored = 1").withColumn("resolved_at", -F.col("_next"))
            .withColumn("status", F.when(F.col("resolved_at").isNotNull(), "resolved")
                        .otherwise(F.col("status"))).drop("_back", "_stored", "_end", "_next"))


# ---- life cycle ---------------------------------------------------------------------------

def poll_list(polls: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """All polls between the first and the last; numbers are consecutive."""
    seen = polls.agg(F.min("poll").alias("a"), F.max("poll").alias("b"))
    a = F.lit(first) if first is not None else F.col("a")
    b = F.lit(last) if last is not None else F.col("b")
    return seen.select(F.explode(F.sequence(a.cast("bigint"), b.cast("bigint"))).alias("poll"))


def replay(polls: DataFrame, hold: int = 3, row_floor: int | None = None) -> DataFrame:
    """State of every alert at every poll it is present in, from the whole history at once.

    new          first sight of the fingerprint
    ongoing      stored as live by the poll before
    recurrence   back ``hold`` or more polls after the poll that resolved it
    suppressed   back sooner; neither stored nor notified, the old resolution stays in force

    A suppressed sighting changes nothing in the store, so a verdict depends on how many polls ago the last
    *live* sighting was.  Up to ``hold`` that number is the state of a small automaton, which
    ``automata.states_before`` runs without an array of an alert's polls.
    """
    rows = polls.select("fingerprint", "poll").distinct()
    groups = OrderedGroups(rows, ["fingerprint"], ["poll"], halo=1, row_floor=row_floor, sizes_from=polls)
    rows = groups.trim(groups.rows().withColumn("_prev", F.lag("poll").over(groups.window())))
    # polls since the sighting before; all that are beyond the hold are alike
    since = F.when(F.col("_prev").isNotNull(), F.least(F.col("poll") - F.col("_prev"), F.lit(hold + 1)).cast("int"))

    def after(state: int) -> Column:
        gap = F.lit(state) + F.col("_since")
        return F.when(F.col("_since").isNull() | (gap == 1) | (gap > hold), 0).otherwise(gap)
    rows = rows.select("fingerprint", "poll", since.alias("_since"))
    rows = rows.withColumn("_move", F.array(*[after(s) for s in range(hold + 1)]))
    met = states_before(rows, ["fingerprint"], ["poll"], "_move", hold + 1, "_state", row_floor=row_floor, like=groups,
                        sizes_from=polls)
    gap = F.col("_state") + F.col("_since")
    state = (F.when(F.col("_since").isNull(), "new").when(gap == 1, "ongoing").when(gap > hold, "recurrence")
             .otherwise("suppressed"))
    return met.select("fingerprint", "poll", state.alias("state"))


def lifecycle(polls: DataFrame, hold: int = 3, ok_polls: DataFrame | None = None,
              row_floor: int | None = None) -> DataFrame:
    """``replay`` plus a ``resolved`` row at the poll that first misses a live alert.

    A poll without alerts resolves everything.  Polls that failed are left out of ``ok_polls`` and
    resolve nothing; the default takes every poll of the range as good.
    """
    states = replay(_renumber(polls, ok_polls), hold, row_floor)
    live = states.where("state <> 'suppressed'")
    last = _renumber(polls, ok_polls).agg(F.max("poll")).scalar() if ok_polls is None else (
        _poll_numbers(ok_polls).agg(F.max("n")).scalar())
    here = live.select("fingerprint", F.col("poll").alias("_next"))
    gone = (live.withColumn("_next", F.col("poll") + 1).where(F.col("_next") <= last)
            .join(here, ["fingerprint", "_next"], "left_anti")
            .select("fingerprint", F.col("_next").alias("poll"), F.lit("resolved").alias("state")))
    out = states.unionByName(gone)
    if ok_polls is None:
        return out
    names = _poll_numbers(ok_polls).select(F.col("n").alias("poll"), F.col("poll").alias("_poll"))
    return out.join(names, "poll").select("fingerprint", F.col("_poll").alias("poll"), "state")


def _poll_numbers(ok_polls: DataFrame) -> DataFrame:
    return OrderedGroups(ok_polls.select(F.lit(0).alias("_all"), "poll").distinct(), ["_all"],
                         ["poll"]).numbered("n", None).select("poll", F.col("n").cast("bigint"))


def _renumber(polls: DataFrame, ok_polls: DataFrame | None) -> DataFrame:
    """Good polls count 0, 1, 2, ...; without a list the poll numbers are taken as they are."""
    if ok_polls is None:
        return polls
    return (polls.join(_poll_numbers(ok_polls), "poll").drop("poll")
            .withColumnRenamed("n", "poll"))


def started_at(polls: DataFrame, row_floor: int | None = None) -> DataFrame:
    """First poll of the unbroken run each sighting belongs to."""
    rows = polls.select("fingerprint", "poll").distinct()
    groups = OrderedGroups(rows, ["fingerprint"], ["poll"], halo=1, row_floor=row_floor,
                           sizes_from=polls)
    before = F.lag("poll").over(groups.window())
    marked = groups.trim(groups.rows().withColumn(
        "_new", before.isNull() | (before != F.col("poll") - 1)), keep_piece=True)
    return groups.finish(groups.running(marked, F.when(F.col("_new"), F.col("poll")),
                                        "starts_poll")).drop("_new")


def stored_rows(polls: DataFrame, hold: int = 3) -> DataFrame:
    """Rows the store receives: one per new or recurring sighting, pushed and with its start."""
    facts = polls.groupBy("fingerprint", "poll").agg(F.min("alertname").alias("alertname"),
                                                     F.min("severity").alias("severity"))
    return (replay(polls, hold).where("state IN ('new', 'recurrence')")
            .join(started_at(polls), ["fingerprint", "poll"])
            .join(facts, ["fingerprint", "poll"])
            .select("fingerprint", "alertname", "severity", F.col("poll").alias("created_poll"),
                    "starts_poll", (F.col("state") == "recurrence").alias("is_recurrence")))


def history_recurrences(history: DataFrame, row_floor: int | None = None) -> DataFrame:
    """Transitions from resolved to a live state per fingerprint."""
    groups = OrderedGroups(history, ["fingerprint"], ["us", "event_id"], halo=1,
                           row_floor=row_floor)
    rows = groups.trim(groups.rows().withColumn("_before", F.lag("status").over(groups.window())))
    back = (F.col("_before") == "resolved") & is_live(F.col("status"))
    return rows.groupBy("fingerprint").agg(
        F.sum(F.coalesce(back.cast("bigint"), F.lit(0))).alias("recurrences"))


# ---- pushes -------------------------------------------------------------------------------

def push_state(store: DataFrame, pushes: DataFrame) -> DataFrame:
    """Counters of each fingerprint, derived from the push facts instead of mutable columns."""
    kind = F.col("kind")
    agg = pushes.groupBy("fingerprint").agg(
        F.max(F.when(kind.isin("group", "repeat"), F.col("us"))).alias("group_push_us"),
        F.max(F.when(kind == "table", F.col("us"))).alias("table_push_us"),
        F.sum((kind == "repeat").cast("bigint")).alias("repeat_count"),
        F.max((kind == "recovery").cast("int")).alias("_rec"))
    return (store.select("fingerprint").distinct().join(agg, "fingerprint", "left")
            .select("fingerprint", "group_push_us", "table_push_us",
                    F.coalesce("repeat_count", F.lit(0)).alias("repeat_count"),
                    F.when(F.col("_rec") == 1, "recovery_reported")
                    .when(F.col("group_push_us").isNotNull(), "reported")
                    .otherwise("unreported").alias("push_status")))


def repeat_due(store: DataFrame, pushes: DataFrame, as_of_us: int,
               limits: AlertLimits = AlertLimits(), enabled: bool = True) -> DataFrame:
    """Live alerts never pushed to their group, or not within the repeat interval."""
    live = latest_alerts(store).where(is_live(F.col("status"))).select("fingerprint")
    state = push_state(store, pushes).join(live, "fingerprint", "left_semi")
    wait = (F.lit(as_of_us) - F.col("group_push_us")) / 1e6
    return (state.where(F.lit(enabled) & (F.col("group_push_us").isNull() |
                                          (wait >= limits.repeat_push_s)))
            .select("fingerprint", F.col("repeat_count") + 1, wait.alias("since_push_s"))
            .toDF("fingerprint", "next_repeat", "since_push_s"))


GROUP_CHANNELS = {"P0": "group_p0", "P1": "group_p1", "P2": "group_p2", "P3": "group_p3"}


def route(events: DataFrame, p3_group: bool = False) -> DataFrame:
    """One row per alert and channel.  ``state`` is new, recurrence, resolved or repeat."""
    sev = F.upper(F.coalesce("severity", F.lit("P2")))
    default = F.lit("group_p2")
    group = (F.when(sev == "P0", "group_p0").when(sev == "P1", "group_p1")
             .when(sev == "P3", F.lit("group_p3") if p3_group else default).otherwise(default))
    fresh = F.col("state").isin("new", "recurrence")
    channels = F.array_compact(F.array(
        group, F.when(F.col("state") != "repeat", F.lit("table")),
        F.when(fresh & (sev == "P0"), F.lit("phone"))))
    return (events.where(F.col("state").isin("new", "recurrence", "resolved", "repeat"))
            .withColumn("channel", F.explode(channels)))


def receiver(severity: Column) -> Column:
    return (F.when(severity == "P1", "critical-alerts").when(severity == "P2", "warning-alerts")
            .otherwise("web.hook"))


def notification_groups(alerts: DataFrame, wait: str = "10 seconds") -> DataFrame:
    """One notification per alert name and wait window."""
    return (alerts.groupBy(F.window("created_at", wait).alias("_w"), "alertname")
            .agg(F.count(F.lit(1)).alias("alerts"),
                 F.count_distinct("fingerprint").alias("fingerprints"),
                 F.min("severity").alias("top_severity"))
            .select(F.unix_micros("_w.start").alias("window_us"), "alertname", "alerts",
                    "fingerprints", "top_severity", receiver(F.col("top_severity")).alias("receiver")))


def group_repeats(store: DataFrame, as_of_us: int, limits: AlertLimits = AlertLimits(),
                  wait: str = "10 seconds") -> DataFrame:
    """Alert names whose group still has live alerts and was last notified a repeat interval ago.

    A group has one row per wait window until it is reduced to its last; live alerts are counted
    per name, so no group is gathered.
    """
    past = store.where(F.col("us") <= as_of_us)
    live = (latest_alerts(past).where(is_live(F.col("status"))).groupBy("alertname")
            .agg(F.count(F.lit(1)).alias("live_alerts")))
    sent = (past.select("alertname", F.unix_micros(F.window("created_at", wait)["start"]).alias("_us"))
            .groupBy("alertname").agg(F.max("_us").alias("last_us")))
    waited = F.lit(as_of_us) - F.col("last_us")
    return (sent.where(waited >= limits.group_repeat_s * 1_000_000).join(live, "alertname")
            .select("alertname", "last_us", "live_alerts", (waited / 1e6).alias("since_s")))


# ---- weekly reports -----------------------------------------------------------------------

def report_window(as_of: str) -> tuple[Column, Column]:
    end = F.lit(as_of).cast("timestamp")
    return end - F.expr("INTERVAL 7 DAYS"), end


def last_week(store: DataFrame, as_of: str, compat: bool = False) -> DataFrame:
    """Rows of the seven days up to ``as_of``; ``compat`` includes the whole first day."""
    start, end = report_window(as_of)
    if compat:
        start = F.date_trunc("day", start)
    return store.where((F.col("created_at") >= start) & (F.col("created_at") <= end))


def weekly_by_severity(store: DataFrame, as_of: str, compat: bool = False) -> DataFrame:
    """Counts per severity and the grand total (severity ``ALL``), one pass."""
    def tally(cond):
        return F.sum(cond.cast("bigint"))
    live, gone = is_live(F.col("status")), F.col("status") == "resolved"
    if compat:
        live = F.col("status") == "active"
    return (last_week(store, as_of, compat).rollup("severity").agg(
        F.grouping("severity").alias("_all"), F.count(F.lit(1)).alias("total_count"),
        tally(live).alias("active_count"), tally(gone).alias("resolved_count"),
        tally(F.col("is_recurrence")).alias("recurrence_count"),
        tally(F.col("repeat_push_count") > 0).alias("repeat_push_count"),
        F.sum("repeat_push_count").cast("bigint").alias("total_repeat_push"))
        .withColumn("severity", F.when(F.col("_all") == 1, "ALL").otherwise(F.col("severity")))
        .drop("_all"))


def weekly_top_names(store: DataFrame, as_of: str, k: int = 10, severity: str | None = None
                     ) -> DataFrame:
    """Most frequent alert names of the week."""
    rows = last_week(store, as_of)
    if severity:
        rows = rows.where(F.col("severity") == severity)
    return (rows.groupBy("alertname").agg(
        F.count(F.lit(1)).alias("alerts"),
        F.sum(is_live(F.col("status")).cast("bigint")).alias("active_count"),
        F.sum("recurrence_count").cast("bigint").alias("total_recurrence"))
        .orderBy(F.col("alerts").desc(), "alertname").limit(k))


def weekly_p3(store: DataFrame, as_of: str, severity: str = "P3") -> DataFrame:
    rows = last_week(store, as_of).where(F.col("severity") == severity)
    return rows.agg(
        F.count(F.lit(1)).alias("total_count"),
        F.sum(is_live(F.col("status")).cast("bigint")).alias("active_count"),
        F.sum((F.col("status") == "resolved").cast("bigint")).alias("resolved_count"),
        F.sum((F.col("recurrence_count") > 0).cast("bigint")).alias("recurring_alerts"),
        F.sum("recurrence_count").cast("bigint").alias("total_recurrence"))


def report_lines(store: DataFrame, as_of: str, top: int = 5) -> DataFrame:
    """The weekly report as ordered text lines (a handful of rows)."""
    by = weekly_by_severity(store, as_of)
    stats = by.select(
        F.when(F.col("severity") == "ALL", 0).otherwise(1).alias("part"),
        F.col("severity").alias("name"),
        F.format_string("total %d | active %d | resolved %d | recurring %d | repeated %d",
                        "total_count", "active_count", "resolved_count", "recurrence_count",
                        "repeat_push_count").alias("line"))
    names = weekly_top_names(store, as_of, top).select(
        F.lit(2).alias("part"), F.col("alertname").alias("name"),
        F.format_string("%d alerts (%d active)", "alerts", "active_count").alias("line"))
    return stats.unionByName(names)


# Texts of the P3 card
P3_PERIOD, P3_NONE, P3_NAME, P3_AGAIN = "统计周期", "• 本周无P3告警", "• %s: %d次", " (复发%d次)"
P3_NUMBERS = (("总告警数", "total_count"), ("活跃告警", "active_count"), ("已解决", "resolved_count"),
              ("复发告警", "recurring_alerts"), ("总复发次数", "total_recurrence"))


def p3_card_lines(store: DataFrame, as_of: str, top: int = 10, severity: str = "P3") -> DataFrame:
    """The weekly card of low alerts: period, five numbers, then a line per name, or one that says
    that there was none."""
    start, end = report_window(as_of)
    week = F.concat(F.date_format(start, "yyyy-MM-dd"), F.lit(" 至 "), F.date_format(end, "yyyy-MM-dd"))

    def line(part, name, text):
        return F.struct(F.lit(part).alias("part"), F.lit(name).alias("name"), text.alias("line"))
    numbers = [line(i, name, F.coalesce(F.col(c), F.lit(0)).cast("string"))
               for i, (name, c) in enumerate(P3_NUMBERS, 1)]
    nothing = F.when(F.col("total_count") == 0, line(6, "", F.lit(P3_NONE)))
    head = (weekly_p3(store, as_of, severity)
            .select(F.inline(F.array_compact(F.array(line(0, P3_PERIOD, week), *numbers, nothing)))))
    again = F.when(F.col("total_recurrence") > 0, F.format_string(P3_AGAIN, "total_recurrence"))
    names = weekly_top_names(store, as_of, top, severity).select(
        F.lit(6).alias("part"), F.col("alertname").alias("name"),
        F.concat(F.format_string(P3_NAME, "alertname", "alerts"), F.coalesce(again, F.lit(""))).alias("line"))
    return head.unionByName(names)
