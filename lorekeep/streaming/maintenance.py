"""The index maintained by a stream: arriving entries are upserted, supersession is keyed state.

Two stateful operators follow each other. The first is keyed by the entry's id and knows the version that counts, the
one with the greatest (created_at, digest of the rest), with the targets it names: an older or an equal one that arrives
later changes nothing, a newer one takes back what the old one named. The second is keyed by the pair of ids
of a link, in both directions at once, so that two entries that supersede each other meet there, whichever comes first,
and an entry that very many name is as many keys. It says of each side whether the other names it and whether it wins;
what an id is in the end is an aggregation of these rows. Nothing depends on the order of arrival.

Each batch becomes one segment and one version of the index, entries and links together. The version notes the
batch's number under the query's id, which lies in the checkpoint: a batch that runs again after a loss is not added twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lorekeep.schema import ENTRIES
from lorekeep.session import in_copy, ship
from lorekeep.sources import entries as source
from lorekeep.sources.segments import Segments, Snapshot
from lorekeep.streaming.incremental import entry_stream

_ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Keys under which rows that need no state go through an operator.
LANES = 64
_FIELDS = [c.split()[0] for c in ENTRIES.split(", ")]
_VERSIONS = ENTRIES + ", file string, error string, was array<string>"
_CHANGES = ENTRIES + ", file string, error string, other string, named boolean, wins boolean"


class Versions(StatefulProcessor):
    """Per id the version that counts; rows without an id (files that could not be read) go through."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._known = handle.getValueState("known", "created_at string, digest string, targets array<string>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[0] is None:
            for row in rows:
                yield Row(**{f: row[f] for f in [*_FIELDS, "file", "error"]}, was=[])
            return
        best = max(rows, key=lambda row: (row["created_at"], row["digest"]))
        old = self._known.get() if self._known.exists() else None
        if old is not None and (old[0], old[1]) >= (best["created_at"], best["digest"]):
            return
        self._known.update((best["created_at"], best["digest"], best["supersedes"]))
        yield Row(**{f: best[f] for f in [*_FIELDS, "file", "error"]}, was=list(old[2] or []) if old else [])

    def close(self) -> None:
        pass


class Pairs(StatefulProcessor):
    """Per pair of ids, the smaller first, when each names the other; rows that are no links go through."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._said = handle.getValueState("said", "down string, up string")

    @staticmethod
    def _sides(one: str, other: str, down: str | None, up: str | None) -> dict[tuple[str, str], tuple[bool, bool]]:
        """(id, other) -> whether the other names it, whether it wins: both name each other and it is not the earlier."""
        if one == other:
            return {(one, one): (down is not None, down is not None)}
        both = down is not None and up is not None
        return {(one, other): (up is not None, both and down >= up), (other, one): (down is not None, both and up >= down)}

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        linked, one, other = key
        if not linked:
            for row in rows:
                yield Row(**{f: row[f] for f in [*_FIELDS, "file", "error"]}, other=None, named=None, wins=None)
            return
        was = tuple(self._said.get()) if self._said.exists() else (None, None)
        down, up = was
        for row in rows:
            # a batch has one version of an entry at most, so one row for each direction
            said = row["created_at"] if row["present"] else None
            down, up = (said, up) if row["id"] == one else (down, said)
        if (down, up) == was:
            return
        if down is None and up is None:
            self._said.clear()
        else:
            self._said.update((down, up))
        before = self._sides(one, other, *was)
        for (name, by), (named, wins) in self._sides(one, other, down, up).items():
            if before[name, by] != (named, wins):
                yield Row(**dict.fromkeys([*_FIELDS, "file", "error"]) | {"id": name}, other=by, named=named, wins=wins)

    def close(self) -> None:
        pass


def changes(entries: DataFrame) -> DataFrame:
    """A stream of ENTRIES, file and error -> a stream of what changes: the columns of ``_CHANGES``.

    Rows with ``other`` say of the link between ``id`` and it: whether other names id, whether id wins (both name each other and it
    is not the earlier). Rows without are entries as they are now, or files with an error. A null created_at is the earliest, null
    lists are empty, null targets none; a row without an id names nothing and is handed on only if it has an error. Repeated
    and older rows change nothing; of versions with the same created_at the greater digest counts.
    """
    none = F.array().cast("array<string>")
    e = entries.where("id IS NOT NULL OR error IS NOT NULL").withColumns({
        "id": F.when(F.col("error").isNull(), F.col("id")), "created_at": F.coalesce("created_at", F.lit("")), "tags": F.coalesce("tags", none),
        "supersedes": F.coalesce(F.array_distinct(F.filter("supersedes", lambda t: t.isNotNull())), none),
    }).withColumns({
        "digest": F.sha2(F.to_json(F.struct("kind", "supersedes", "tags", "body")), 256),
        "lane": F.when(F.col("id").isNull(), F.pmod(F.xxhash64("file"), F.lit(LANES)).cast("int")).otherwise(0),
    })
    versions = e.groupBy("id", "lane").transformWithState(Versions(), _VERSIONS, "Append", "None")
    target = lambda t, present: F.struct(F.lit(True).alias("linked"), t.alias("target"), F.lit(present).alias("present"))
    itself = F.array(F.struct(F.lit(False).alias("linked"), F.lit(None).cast("string").alias("target"), F.lit(True).alias("present")))
    links = F.concat(F.transform("supersedes", lambda t: target(t, True)), F.transform(F.array_except("was", "supersedes"), lambda t: target(t, False)))
    links = F.when(F.col("id").isNotNull(), links).otherwise(F.slice(links, 1, 0))
    rows = versions.withColumn("event", F.explode(F.concat(itself, links))).select("*", "event.*").drop("event", "was")
    # a link's row carries no text
    rows = rows.withColumns({c: F.when(~F.col("linked"), F.col(c)) for c in ("kind", "supersedes", "tags", "body", "file", "error")})
    lane = F.pmod(F.xxhash64("id", "file"), F.lit(LANES)).cast("string")
    rows = rows.withColumns({"one": F.when(F.col("linked"), F.least("id", "target")).otherwise(lane), "another": F.when(F.col("linked"), F.greatest("id", "target")).otherwise("")})
    return rows.drop("target").groupBy("linked", "one", "another").transformWithState(Pairs(), _CHANGES, "Append", "None")


def superseded(links: DataFrame) -> DataFrame:
    """links(entry_id, other, named, wins, version), of which the last of each pair counts -> id of what is superseded."""
    last = links.groupBy("entry_id", "other").agg(F.max_by(F.struct("named", "wins"), "version").alias("now"))
    ids = last.groupBy("entry_id").agg(F.bool_or("now.named").alias("named"), F.bool_or("now.wins").alias("wins"))
    return ids.where("named AND NOT wins").select(F.col("entry_id").alias("id"))


def last_links(at: Snapshot) -> DataFrame:
    """The links of a version as they are now, one row for each pair and side that holds something."""
    last = at.table("links").groupBy("entry_id", "other").agg(F.max_by(F.struct("named", "wins"), "version").alias("now"))
    return last.where("now.named").select("entry_id", "other", "now.*")  # who wins is named too


def stream_of(at: Snapshot) -> str | None:
    """The query that all segments of a version come from; None: not one alone, so the links are not all there."""
    names = {s["figures"].get("stream") for s in at.segments}
    return names.pop() if len(names) == 1 else None


def commits(log: Segments, write: Callable[[DataFrame, DataFrame], tuple[str, dict[str, DataFrame], dict]], checkpoint: str, meta: Callable[[], dict] = dict) -> Callable[[DataFrame, int], None]:
    """For foreachBatch on ``changes``: one version for each batch, once however often it runs.

    write: from the entries that have changed and the files that could not be read to a segment, to which the links are added.
    """

    def commit(batch: DataFrame, number: int) -> None:
        stream = log._read(f"{checkpoint.rstrip('/')}/metadata")["id"]
        if number <= log.snapshot().meta.get("streams", {}).get(stream, -1):
            # the index has it, but the state's new version is only there once the batch has run
            batch.write.format("noop").mode("append").save()
            return
        staging = f"{log.folder}/staging/{uuid.uuid4().hex}"
        try:
            # the stateful operators run once; what follows reads what they said
            batch.write.parquet(staging)
            said = log.spark.read.schema(_CHANGES).parquet(staging)
            if not said.limit(1).count():
                return
            new = said.where("other IS NULL")
            entries, skipped = new.where("error IS NULL").select(*_FIELDS), new.where("error IS NOT NULL").select("file", F.col("error").alias("reason"))
            name, tables, figures = write(entries, skipped)
            tables |= log.write(name, {"links": said.where("other IS NOT NULL").select(F.col("id").alias("entry_id"), "other", "named", "wins")})
            log.add(name, tables, figures | {"stream": stream}, lambda was: meta() | {"streams": was.get("streams", {}) | {stream: number}})
        finally:
            fs, path = log._file(staging)
            fs.delete(path, True)

    return commit


def start(entries: DataFrame, commit: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts the query on a stream of ENTRIES, file and error of a session that ``rocks`` has made."""
    writer = changes(entries).writeStream.outputMode("append").foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def rocks(spark: SparkSession) -> SparkSession:
    """A copy of the session with the state store that the operators need; the session itself is left as it is."""
    ship(spark)
    return in_copy(spark, _ROCKS)


def maintain(kb, checkpoint: str, files_per_batch: int = 1000, available_now: bool = True) -> StreamingQuery:
    """Keeps a knowledge base's index up with its folder: files that arrive are upserted, in any order, a version for each batch.

    After all files have been seen the index holds what ``ingest`` of them makes, but that of several files with an id the one with the
    greatest (created_at, digest) counts, and that a file counts once: one that is changed in place is not read again, a new
    version needs a name of its own. Files that cannot be read are rows of the table ``skipped``. checkpoint: a folder that
    executors share, with the state; without it all files are seen anew, by a query of another id. Whether files and index have
    drifted apart is judged by the files there were at the last version. As many partitions of state as the session has for
    shuffles at the first start.
    """
    kb.init()
    log = kb.index

    def write(entries: DataFrame, skipped: DataFrame) -> tuple[str, dict[str, DataFrame], dict]:
        name, tables, figures = kb._written(entries)
        return name, tables | log.write(name, {"skipped": skipped}), figures

    meta = lambda: {"last_ingest": source.now(), "entry_count": kb._files()}
    return start(entry_stream(rocks(kb.spark), kb.entries_dir, files_per_batch), commits(log, write, checkpoint, meta), checkpoint, available_now)
