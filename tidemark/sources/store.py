"""State as plain Parquet tables of increments, laid out by time, and the notification channel.

Structured Streaming's checkpoint decides which micro-batch is next and that one query writes. A micro-batch adds its rows
to the tables under its number, and computes them from the rows of the batches before it; a mark, written last, says that
they are there. If it is delivered again its rows are replaced, so the same batch always gives the same rows, and no lock,
rename or version is needed on any file system.

What a batch reads is a matter of time, never of history: identities lie by the day of their first ingest, open events by
the hour of their event time, open sessions by the hour in which they end, archived objects by their date. A batch knows
which of these its records can meet and reads those folders alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import is_closed
from ..functions.contract import ALLOWED_LATENESS_MS, IDENTITY_TTL_MS, INACTIVITY_GAP_MS, LIVE, MAX_AGE_MS, MAX_FUTURE_MS, STATE
from ..operators.timeline import component_rows, sessions
from ..plans.engine import KEYS, SESSION, SUMS
from .scratch import empty, path_of, remove, staged

#: The boundaries at which a probe is told how far a step has come.
BOUNDARIES = ("before_archive", "archived", "staged", "committed", "partial_failure", "quarantined", "published", "failure_recorded")

DAY, HOUR = 86_400_000, 3_600_000
#: Columns of tables that aren't the contract's own: the ledger's and open events' first ingest time, sessions that begin or end.
OPEN_EVENT = f"{STATE['open_event']}, first_ingest_ms bigint"
OPEN_SESSION = "shard_id string, generation_id string, user_id string, start_ms bigint, end_ms bigint, gone boolean"
STORED = {n: d for n, d in STATE.items() if n not in ("session_component", "failure_destination")} | {"open_event": OPEN_EVENT, "open_session": OPEN_SESSION, "long_session": OPEN_SESSION}
#: Open sessions that go on for longer than this are listed by themselves: their first events are old while their shard isn't.
LONG_MS = 6 * 86_400_000
#: A shard's open sessions end so long before its greatest event time at most.
OPEN_MS = ALLOWED_LATENESS_MS + INACTIVITY_GAP_MS
#: Where an archived object lies: by its date; rejected ones, which have none, by the first digits of their text's hash.
ARCHIVE_PART = r"coalesce(nullif(regexp_extract(key, '/date=([^/]+)/', 1), ''), concat('rejected-', regexp_extract(key, '/transport=(..)', 1)))"
#: Tables in folders of their own, before those of batches: (folder, its value, its type).
LAYOUT = {
    "identity_ledger": ("day", f"first_ingest_ms div {DAY}", "bigint"), "open_event": ("hour", f"event_time_ms div {HOUR}", "bigint"),
    "open_session": ("hour", f"end_ms div {HOUR}", "bigint"), "long_session": ("hour", f"end_ms div {HOUR}", "bigint"), "archive": ("part", ARCHIVE_PART, "string"),
}
#: Small whatever the history: a row for each shard, which each batch writes whole. Of all other tables it writes its own rows.
WHOLE = ("shard_state",)
#: Tables that other steps than a batch append to.
APPENDED = {"failure_destination": STATE["failure_destination"], "delivery": "outbox_id string", "channel": "outbox_id string, attempt int, body_json string"}
#: So many folders are named to a reader, and so many ids to a scan, which skips files by their Bloom filters; beyond that it
#: reads them all and joins.
MOST_FOLDERS, MOST_IDS = 1000, 1000


def no_probe(boundary: str) -> None:
    if boundary not in BOUNDARIES:
        raise ValueError(f"no boundary {boundary}")


def _values(rows: DataFrame, value: Column) -> list:
    """The distinct values of a column that has few: dates of a batch, hours of its shards' open sessions."""
    return sorted(rows.agg(F.collect_set(value)).first()[0])


def _hours(rows: DataFrame, first: str, last: str) -> list[int]:
    """The distinct hours of intervals: a few for each shard, or those over which the longest session goes on."""
    return _values(rows.select(F.explode(F.sequence(F.expr(f"({first}) div {HOUR}"), F.expr(f"({last}) div {HOUR}"))).alias("h")), F.col("h"))


class StateTables:
    """The tables of one generation below a folder. Generations share nothing; a replay reads the archive of the one it replays."""

    def __init__(self, spark: SparkSession, root: str, generation: str = LIVE, probe: Callable[[str], None] = no_probe):
        self.spark, self.root, self.generation, self.probe = spark, root.rstrip("/"), generation, probe

    def of(self, generation: str) -> StateTables:
        return StateTables(self.spark, self.root, generation, self.probe)

    def _path(self, table: str) -> str:
        return f"{self.root}/generation={self.generation}/{table}"

    def _empty(self, ddl: str) -> DataFrame:
        return empty(self.spark, ddl)

    def _read(self, table: str, ddl: str, folders: str = "") -> DataFrame:
        """A table's files, or those below `folders`, a pattern of the folders in it."""
        try:
            return self.spark.read.schema(ddl).option("basePath", self._path(table)).parquet(self._path(table) + folders)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self._empty(ddl)

    def rows(self, table: str, before: int, parts: Iterable[int | str] | None = None) -> DataFrame:
        """A table's rows from batches before one, with `batch`; of a laid out table those in the folders `parts`, or all."""
        ddl, folders = f"{STORED[table]}, batch bigint", ""
        if table in LAYOUT:
            folder, _, kind = LAYOUT[table]
            ddl += f", {folder} {kind}"
            if parts is not None:
                listed = sorted(set(parts))
                if not listed:
                    return self._empty(ddl)
                if len(listed) <= MOST_FOLDERS:
                    folders = f"/{folder}={{{','.join(map(str, listed))}}}"
        return self._read(table, ddl, folders).where(F.col("batch") < before)

    def marks(self) -> dict[int, bool]:
        """The batches that are written, and whether each is complete or failed in part: one entry of a listing for each."""
        system, at = path_of(self.spark, self._path("done"))
        if not system.exists(at):
            return {}
        names = sorted(f.getPath().getName().split(".") for f in system.listStatus(at))
        return {int(batch): state == "complete" for batch, state in sorted(names, key=lambda x: x[1] == "complete") if batch}

    def last(self) -> tuple[int, bool]:
        """The last batch, -1 before the first, and whether it is complete."""
        marks = self.marks()
        last = max(marks, default=-1)
        return last, marks.get(last, True)

    def applied(self, batch: int) -> bool:
        last, complete = self.last()
        return batch < last or (batch == last and complete)

    def _whole(self, table: str, before: int) -> DataFrame:
        latest = max((b for b in self.marks() if b < before), default=None)
        if latest is None:
            return self._empty(STORED[table])
        return self._read(table, f"{STORED[table]}, batch bigint", f"/batch={latest}").drop("batch")

    def table(self, name: str, before: int | None = None) -> DataFrame:
        """A table as it is before a batch, by default after the last one.

        Of rows with one key the first batch's counts, but of identities the last one: it follows one that has expired.
        """
        before = self.last()[0] + 1 if before is None else before
        if name in ("open_event", "session_component"):
            events = self.members(self.open_sessions(before), before).select(*[c.split()[0] for c in STATE["open_event"].split(", ")])
            return events if name == "open_event" else component_rows(sessions(events, self._whole("shard_state", before)))
        if name in ("open_session", "long_session"):
            return self.open_sessions(before, table=name).withColumn("gone", F.lit(False))
        if name in WHOLE:
            return self._whole(name, before)
        rows = self.rows(name, before)
        if name in SUMS:
            keys, sums = SUMS[name]
            return rows.groupBy(*keys).agg(*[F.sum(c).cast("bigint").alias(c) for c in sums])
        columns = [c.split()[0] for c in STORED[name].split(", ")]
        return self._of_key(rows, name, columns)

    def _of_key(self, rows: DataFrame, name: str, columns: list[str]) -> DataFrame:
        first, rest = F.max_by if name == "identity_ledger" else F.min_by, [c for c in columns if c not in KEYS[name]]
        return rows.groupBy(*KEYS[name]).agg(first(F.struct(*rest), "batch").alias("row")).select(*KEYS[name], "row.*").select(*columns)

    def open_sessions(self, before: int, hours: Iterable[int] | None = None, table: str = "open_session") -> DataFrame:
        """SESSION of the sessions that are open before a batch: those that began and didn't end, by the hour of their end."""
        rows = self.rows(table, before, hours)
        return rows.where("NOT gone").select(*SESSION).join(rows.where("gone").select(*SESSION), SESSION, "left_anti")

    def members(self, found: DataFrame, before: int, hours: Iterable[int] | None = None) -> DataFrame:
        """Events of open sessions: those of their shard and user within their bounds, as no other session lies there."""
        bounds = found.select(*SESSION)
        inside = F.col("event_time_ms").between(F.col("start_ms"), F.col("end_ms"))
        return self.rows("open_event", before, hours).join(bounds, SESSION[:3]).where(inside).drop("start_ms", "end_ms", "batch", "hour")

    def load(self) -> dict[str, DataFrame]:
        """All tables as they are after the last batch; outbox rows say whether they are delivered."""
        before = self.last()[0] + 1
        tables = {n: self.table(n, before) for n in STATE if n != "failure_destination"}
        delivered = self._read("delivery", f"{APPENDED['delivery']}, batch bigint").select("outbox_id").distinct().withColumn("done", F.lit(1))
        outbox = tables["outbox"].join(delivered, "outbox_id", "left").withColumn("delivered", F.coalesce("done", "delivered"))
        return tables | {"outbox": outbox.select(*tables["outbox"].columns), "failure_destination": self.failures()}

    def write(self, batch: int, added: dict[str, DataFrame], complete: bool = True, check: Callable[[dict[str, DataFrame]], None] | None = None) -> None:
        """Writes a batch's new rows, the archive first and the mark that it is written last; `check` sees the rows before it."""
        columns = {n: [c.split()[0] for c in d.split(", ")] for n, d in STORED.items()}

        def put(name: str) -> None:
            rows, folders = added[name].select(*columns[name]).withColumn("batch", F.lit(batch)), ["batch"]
            if name in LAYOUT:
                folder, value, _ = LAYOUT[name]
                # A folder's rows come to few tasks, and so to few files; adaptive execution splits a large folder.
                rows, folders = rows.withColumn(folder, F.expr(value)).hint("rebalance", F.col(folder)), [folder, "batch"]
            out = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*folders)
            if name == "open_event":
                # As large as a file's ids need, from 64 KB on, else a megabyte for each file, which is for each hour.
                out = out.option("parquet.bloom.filter.enabled#event_id", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
            out.parquet(self._path(name))

        def all_of(*names: str) -> None:
            # Jobs of their own that don't wait for each other's last tasks.
            with ThreadPoolExecutor(8) as pool:
                list(pool.map(put, [n for n in names if n in added]))

        if "open_session" in added:
            added = added | {"long_session": added["open_session"].where(F.col("end_ms") - F.col("start_ms") > LONG_MS)}
        self.probe("before_archive")
        self._begin(batch, added)
        all_of("archive")
        self.probe("archived")
        all_of("quarantine", "outbox", "processing_commit")
        self.probe("quarantined")
        all_of("identity_ledger", "session_output", "closure_work", "open_event", "open_session", "long_session", *SUMS, *WHOLE)
        self.probe("staged")
        if check:
            check({n: self.rows_of(n, batch).select(*columns[n]) for n in added if n in STORED})
        system, at = path_of(self.spark, f"{self._path('done')}/{batch}.{'complete' if complete else 'partial'}")
        system.create(at, True).close()
        self.probe("committed" if complete else "partial_failure")

    def rows_of(self, table: str, batch: int) -> DataFrame:
        """The rows that one batch has written."""
        folder = f"/{LAYOUT[table][0]}=*" if table in LAYOUT else ""
        return self._read(table, f"{STORED[table]}, batch bigint" + (f", {LAYOUT[table][0]} {LAYOUT[table][2]}" if folder else ""), f"{folder}/batch={batch}")

    def _begin(self, batch: int, added: dict[str, DataFrame]) -> None:
        """Clears what an attempt at the batch that didn't end has left, whose rows may lie in other folders than the next one's."""
        system, begun = path_of(self.spark, f"{self._path('begun')}/{batch}")
        if system.exists(begun):
            for name in added:
                for found in system.globStatus(path_of(self.spark, f"{self._path(name)}/{'*/' if name in LAYOUT else ''}batch={batch}")[1]) or []:
                    remove(self.spark, found.getPath().toString())
        system.create(begun, True).close()

    def append(self, table: str, rows: DataFrame, batch: int | None = None) -> None:
        path = self._path(table) + ("" if batch is None else f"/batch={batch}")
        rows.select(*[c.split()[0] for c in APPENDED[table].split(", ")]).write.mode("append").parquet(path)

    def archive(self) -> DataFrame:
        return self.table("archive")

    def archived(self, keys: DataFrame, before: int | None = None) -> DataFrame:
        """The archived objects of keys (key): only their dates' folders are read, and only their rows are grouped."""
        before = self.last()[0] + 1 if before is None else before
        parts = _values(keys, F.expr(ARCHIVE_PART))
        asked = self.rows("archive", before, parts).join(keys.select("key").distinct(), "key", "left_semi")
        return self._of_key(asked, "archive", [c.split()[0] for c in STATE["archive"].split(", ")])

    def known_objects(self, told: DataFrame, before: int) -> DataFrame:
        """(key, sha256, known_sha256) of a batch's objects (key, sha256) that are archived: of their dates, hashes alone are read."""
        parts = _values(told, F.expr(ARCHIVE_PART))
        known = self.rows("archive", before, parts).select("key", F.col("sha256").alias("known_sha256")).distinct()
        return told.select("key", "sha256").join(known, "key")

    def read(self, key: str) -> bytes:
        """One archived body; its key filters the archive and is never a path."""
        row = self.archived(self.spark.createDataFrame([(key,)], "key string")).select("body").first()
        if row is None:
            raise KeyError(key)
        return bytes(row["body"])

    def failures(self) -> DataFrame:
        return self._read("failure_destination", APPENDED["failure_destination"]).dropDuplicates(["invocation_id"])

    def published(self, batch: int | None = None) -> DataFrame:
        """Notifications sent so far, or those of one batch's outbox."""
        return self._read("channel", f"{APPENDED['channel']}, batch bigint", "" if batch is None else f"/batch={batch}").drop("batch")

    def undrained(self) -> list[int]:
        """Complete batches whose outbox isn't known to be delivered, in order: where delivery goes on."""
        system, at = path_of(self.spark, self._path("drained"))
        drained = {int(f.getPath().getName()) for f in system.listStatus(at)} if system.exists(at) else set()
        return sorted(b for b, complete in self.marks().items() if complete and b not in drained)

    def drained(self, batch: int) -> None:
        system, at = path_of(self.spark, f"{self._path('drained')}/{batch}")
        system.create(at, True).close()

    def undelivered(self, batch: int) -> DataFrame:
        """A batch's outbox rows that are not marked; only that batch's files are read."""
        delivered = self._read("delivery", f"{APPENDED['delivery']}, batch bigint", f"/batch={batch}").select("outbox_id")
        return self.rows_of("outbox", batch).drop("batch").join(delivered, "outbox_id", "left_anti")

    def publish(self, page: list[tuple[str, str]], batch: int) -> None:
        """Appends one attempt for each row (outbox_id, body_json) of a page; a consumer keeps one of each outbox_id."""
        rows = self.spark.createDataFrame(page, "outbox_id string, body_json string")
        before = self.published(batch).join(rows.select("outbox_id"), "outbox_id", "left_semi").groupBy("outbox_id").agg(F.max("attempt").alias("attempts"))
        attempt = (F.coalesce("attempts", F.lit(0)) + 1).cast("int").alias("attempt")
        self.append("channel", rows.join(before, "outbox_id", "left").select("outbox_id", attempt, "body_json"), batch)
        self.probe("published")

    def carried(self, before: int) -> Carried:
        return Carried(self, before)

    def rebase(self, root: str, now_ms: int | None = None) -> StateTables:
        """The same state as one batch below a new folder: fewer files, and only the open events.

        Where `now_ms` says what time it is, identities that have expired by then are left out, but for those of open events.
        """
        to, tables, last = StateTables(self.spark, root, self.generation, self.probe), self.load(), self.last()[0]
        if last >= 0:
            opened = self.members(self.open_sessions(last + 1), last + 1)
            if now_ms is not None:
                keys, ledger, expired = ["generation_id", "event_id"], tables["identity_ledger"], F.col("expiry_ms") <= now_ms
                tables["identity_ledger"] = ledger.where(~expired).unionByName(ledger.where(expired).join(opened.select(*keys), keys, "left_semi"))
            to.write(last, tables | {"open_event": opened, "open_session": self.table("open_session")})
            to.append("delivery", tables["outbox"].where("delivered = 1"), last)
            to.append("failure_destination", tables["failure_destination"])
        return to


class Carried:
    """What a batch can touch of the state before it; the interface of engine.WholeState over StateTables."""

    def __init__(self, store: StateTables, before: int):
        self.store, self.before = store, before
        self.shards = store._whole("shard_state", before)

    def held(self, rows: DataFrame, name: str) -> DataFrame:
        return staged(rows, name)

    def identities(self, events: DataFrame) -> DataFrame:
        """Ledger rows that are in force for events of their id.

        An identity is in force for eight days before and after its first ingest time, which is more than two copies of
        an event can lie apart, and for as long as its event is open. Each record has its own time, so no shard's clock,
        nor a wrong one, ends another shard's identities. Read are the ledger's days around the events' own days; and, of
        shards whose open sessions lie elsewhere, open events by their ids, with Bloom filters where ids are few.
        """
        columns = [c.split()[0] for c in STATE["identity_ledger"].split(", ")]
        ids = events.groupBy("generation_id", "event_id").agg(F.min("ingest_time_ms").alias("least"), F.max("ingest_time_ms").alias("most"))
        own = _values(events, F.expr(f"ingest_time_ms div {DAY}"))
        if not own:
            return self.store._empty(STATE["identity_ledger"])
        reach = -(-IDENTITY_TTL_MS // DAY)
        days = {d for day in own for d in range(day - reach, day + reach + 1)}
        near = F.col("first_ingest_ms").between(F.col("least") - IDENTITY_TTL_MS, F.col("most") + IDENTITY_TTL_MS)
        keys = ["generation_id", "event_id"]
        timely = self.store.rows("identity_ledger", self.before, days).join(ids, keys).where(near).select(*columns, "batch")
        pinned = self._pinned(events.select(*keys).distinct(), own)
        return self.store._of_key(timely.unionByName(pinned) if pinned is not None else timely, "identity_ledger", columns)

    def _pinned(self, ids: DataFrame, days: list[int]) -> DataFrame | None:
        """Identities of open events that can lie outside the batch's days: those of shards whose clock is elsewhere, and of long sessions.

        An event's first ingest time is a minute before to a week after its event time, by admission.
        """
        columns = [*[c.split()[0] for c in STATE["identity_ledger"].split(", ")], "batch"]
        behind = (days[-1] + 1) * DAY - IDENTITY_TTL_MS + LONG_MS + OPEN_MS + MAX_FUTURE_MS
        ahead = days[0] * DAY + IDENTITY_TTL_MS - MAX_AGE_MS
        elsewhere = self.shards.where((F.col("max_event_time_ms") < behind) | (F.col("max_event_time_ms") > ahead))
        hours, long = _hours(elsewhere, f"max_event_time_ms - {OPEN_MS}", "max_event_time_ms"), self.store.rows("long_session", self.before)
        if not hours and not long.inputFiles():
            return None
        found = self.store.open_sessions(self.before, hours).join(elsewhere.select("generation_id", "shard_id"), ["generation_id", "shard_id"], "left_semi")
        found = staged(found.unionByName(self.store.open_sessions(self.before, table="long_session")).distinct(), "pinned")
        hours = _hours(found, "start_ms", "end_ms")
        if not hours:
            return None
        events = self.store.rows("open_event", self.before, hours)
        few = [r["event_id"] for r in ids.select("event_id").limit(MOST_IDS + 1).collect()]
        if len(few) <= MOST_IDS:
            events = events.where(F.col("event_id").isin(few))
        inside = F.col("event_time_ms").between(F.col("start_ms"), F.col("end_ms"))
        mine = events.join(ids.select("generation_id", "event_id"), ["generation_id", "event_id"], "left_semi").join(found, SESSION[:3]).where(inside)
        expiry, told = (F.col("first_ingest_ms") + IDENTITY_TTL_MS).alias("expiry_ms"), F.lit(None).cast("string").alias("disposition")
        return mine.select("event_id", "digest", "first_ingest_ms", expiry, "generation_id", told, "batch").select(*columns)

    def opened(self, accepted: DataFrame, shards: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(open events, sessions) that the batch extends or closes.

        A shard's open sessions end in the hour before its greatest event time, so the batch's shards say which hours of
        sessions to read, and the sessions found which hours of events.
        """
        keys = ["generation_id", "shard_id"]
        mine = self.shards.join(accepted.select(*keys).distinct(), keys, "left_semi")
        watermark = shards.join(mine.select(*keys), keys, "left_semi").select(*keys, (F.col("max_event_time_ms") - ALLOWED_LATENESS_MS).alias("watermark_ms"))
        found = self.store.open_sessions(self.before, _hours(mine, f"max_event_time_ms - {OPEN_MS}", "max_event_time_ms")).join(watermark, keys)
        new = accepted.select(*[F.col(c).alias(f"new_{c}") for c in SESSION[:3]], F.col("event_time_ms").alias("at"))
        own = [F.col(c) == F.col(f"new_{c}") for c in SESSION[:3]]
        met = found.join(new, [*own, F.col("at").between(F.col("start_ms") - INACTIVITY_GAP_MS, F.col("end_ms") + INACTIVITY_GAP_MS)], "left_semi")
        due = found.where(is_closed(F.col("watermark_ms"), F.col("end_ms")))
        changed = staged(met.unionByName(due).select(*SESSION).distinct(), "changed")
        return self.store.members(changed, self.before, _hours(changed, "start_ms", "end_ms")), changed
