"""Structured Streaming forms of the incremental computations.

Each takes a streaming DataFrame and gives one; ``finish`` runs a stream over what is there and returns the
result as a table, which is how the batch forms are compared with them.
"""

from __future__ import annotations

import statistics
import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quaver.functions.numeric import source_key
from quaver.session import shared_folder

QUORUM = 3


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a data folder as a stream of its files."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(schema)
    if files.getFileStatus(hadoop).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def finish(df: DataFrame, mode: str = "append") -> DataFrame:
    """The result of a stream over all that is there now: all rows appended, the last complete result, or all updates by ``batch``.

    Batches are written to the shared checkpoint folder by their number, so that a batch that is done again
    replaces itself.
    """
    spark = df.sparkSession
    base = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={0 if mode == 'complete' else number}")

    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    if mode == "update":
        return spark.read.schema(df.schema.add("batch", "long")).parquet(f"{base}/out")
    return spark.read.schema(df.schema).parquet(f"{base}/out").select(*df.columns)


class Consensus(StatefulProcessor):
    """The approved video of one chart as votes arrive; its state is the sources of each video, not the votes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sources = handle.getMapState("sources", "video string, source string", "seen boolean")
        self.counts = handle.getMapState("counts", "video string", "n int")
        self.winner = handle.getValueState("winner", "video string, seq long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = pd.concat(list(rows)).drop_duplicates("seq").sort_values("seq")
        best = self.winner.get() if self.winner.exists() else None
        for r in held.itertuples(index=False):
            n = self.counts.getValue((r.video_id,))[0] if self.counts.containsKey((r.video_id,)) else 0
            if not self.sources.containsKey((r.video_id, r.source)):
                self.sources.updateValue((r.video_id, r.source), (True,))
                n += 1
                self.counts.updateValue((r.video_id,), (n,))
            if n >= QUORUM and (best is None or r.seq > best[1]):
                best = (r.video_id, int(r.seq))
        if best is not None:
            self.winner.update(tuple(best))
            yield pd.DataFrame({"chart_hash": [key[0]], "video_id": [best[0]], "last_seq": [best[1]]})

    def close(self) -> None:
        pass


class Curated(StatefulProcessor):
    """All videos of one chart as votes and curators' decisions arrive: sources, median start, status and lock of each.

    The state holds the vote that stands of each client for each video, the last vote's number of each video, and the last
    decision on it. Rows may come in any order and more than once: what has the greater number stands.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.votes = handle.getMapState("votes", "video string, client string", "seq long, source string, start_ms long")
        self.last = handle.getMapState("last", "video string", "seq long")
        self.decided = handle.getMapState("decided", "video string", "seq long, status string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for chunk in rows:
            chunk = chunk.sort_values("seq")
            told = chunk[chunk["decision"].notna()]
            for r in told.itertuples(index=False):
                held = self.decided.getValue((r.video_id,)) if self.decided.containsKey((r.video_id,)) else None
                if held is None or r.seq > held[0]:
                    self.decided.updateValue((r.video_id,), (int(r.seq), r.decision))
            cast = chunk[chunk["decision"].isna()].drop_duplicates(["video_id", "client_id"], keep="last")
            for r in cast.itertuples(index=False):
                at = (r.video_id, r.client_id or "")
                if not self.votes.containsKey(at) or r.seq > self.votes.getValue(at)[0]:
                    self.votes.updateValue(at, (int(r.seq), r.source, None if pd.isna(r.start_ms) else int(r.start_ms)))
                if not self.last.containsKey((r.video_id,)) or r.seq > self.last.getValue((r.video_id,))[0]:
                    self.last.updateValue((r.video_id,), (int(r.seq),))
        yield self._told(key[0])

    def _told(self, chart: str) -> pd.DataFrame:
        sources: dict[str, set] = {}
        starts: dict[str, list] = {}
        for (video, _), (_, source, start) in self.votes.iterator():
            sources.setdefault(video, set()).add(source)
            starts.setdefault(video, []).extend([] if start is None else [start])
        last = {video: seq for (video,), (seq,) in self.last.iterator()}
        decided = {video: (seq, status) for (video,), (seq, status) in self.decided.iterator()}
        # a later approval by hand takes the lock of an earlier one
        by_hand = max((v for v, (_, s) in decided.items() if s == "approved"), key=lambda v: (decided[v][0], v), default=None)
        locked = {v: s for v, (_, s) in decided.items() if s != "approved" or v == by_hand}
        open_ = [v for v, s in sources.items() if v not in locked and len(s) >= QUORUM] if by_hand is None else []
        winner = max(open_, key=lambda v: (last[v], v), default=None)
        out = []
        for video in sorted({*sources, *decided}):
            status = locked.get(video) or ("approved" if video == winner else "pending")
            middle = int(statistics.median(starts[video])) if starts.get(video) else None
            out.append((chart, video, len(sources.get(video, ())), middle, status, int(video in locked), max(last.get(video, -1), -1)))
        return pd.DataFrame(out, columns=["chart_hash", "video_id", "sources", "start_ms", "status", "locked", "last_seq"]).astype({"start_ms": "Int64"})

    def close(self) -> None:
        pass


CURATED = "chart_hash string, video_id string, sources int, start_ms long, status string, locked int, last_seq long"


def curated(votes: DataFrame, decisions: DataFrame) -> DataFrame:
    """Every video of a chart each time that votes or decisions for it arrived: ``CURATED`` columns.

    ``decisions`` has ``chart_hash``, ``video_id``, ``seq`` and ``decision`` (approved, rejected or pending, which lock a video).
    A decision stands before all votes: a locked video keeps its status, an approved one keeps all others pending.
    """
    cast = votes.filter("seq is not null").select("chart_hash", "video_id", "client_id", F.col("seq").cast("long").alias("seq"), source_key(F.col("ip"), F.col("client_id")).alias("source"), F.col("start_ms").cast("long").alias("start_ms"), F.lit(None).cast("string").alias("decision"))
    none = F.lit(None).cast("string")
    told = decisions.select("chart_hash", "video_id", none.alias("client_id"), F.col("seq").cast("long").alias("seq"), none.alias("source"), F.lit(None).cast("long").alias("start_ms"), "decision")
    return cast.unionByName(told).groupBy("chart_hash").transformWithStateInPandas(Curated(), CURATED, "Update", "None")


def consensus(votes: DataFrame) -> DataFrame:
    """``chart_hash``, ``video_id``, ``last_seq``: the winner of a chart each time that votes for it arrived."""
    rows = votes.filter("seq is not null").select("chart_hash", "video_id", "seq", source_key(F.col("ip"), F.col("client_id")).alias("source"))
    return rows.groupBy("chart_hash").transformWithStateInPandas(Consensus(), "chart_hash string, video_id string, last_seq long", "Update", "None")


def latest_pings(pings: DataFrame) -> DataFrame:
    """The latest ping of each client; a later ping replaces an earlier one."""
    last = F.max_by(F.struct("last_seen", "sharing"), F.struct("last_seen", "sharing"))
    return pings.groupBy("client_id").agg(last.alias("_p")).select("client_id", "_p.last_seen", "_p.sharing")


def daily_writes(votes: DataFrame, late: str = "3650 days") -> DataFrame:
    """Votes of each address in tumbling UTC days. Votes later than ``late`` behind the newest are dropped with their day."""
    rows = votes.filter("ts is not null and trim(ip) <> ''").withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    return rows.groupBy("ip", F.window("at", "1 day")).agg(F.count("*").alias("writes")).select("ip", F.col("window.start").alias("day"), "writes")


def last_updates(told: DataFrame, keys: list[str]) -> DataFrame:
    """The last update of each key of what :func:`finish` gives of a stream in update mode."""
    rest = [c for c in told.columns if c not in (*keys, "batch")]
    return told.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row")).select(*keys, "_row.*")


def event_windows(events: DataFrame, late: str = "60 days") -> DataFrame:
    """Events by type in sliding windows of an hour, every half hour."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return rows.groupBy("event_type", F.window("at", "1 hour", "30 minutes")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select("event_type", F.col("window.start").alias("start"), "n", "total")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "60 days") -> DataFrame:
    """Sessions of each user: runs of events with gaps below ``gap``."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return rows.groupBy("user_id", F.session_window("at", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def first_contents(texts: DataFrame) -> DataFrame:
    """Digest of each different text once: what an incremental run still has to do."""
    return texts.filter("text is not null").select(F.sha2("text", 256).alias("digest")).dropDuplicates(["digest"])
