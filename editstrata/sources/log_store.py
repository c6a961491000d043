"""A versioned store of the log: batches that are appended whole or not at all, and atomic replacement.

A store is a folder with `batches` and `versions`, which hold `records`, `progress` and `identities`, and `manifest`, one file
for each commit, numbered without gaps. Readers go by the manifest, so a batch that was written but not committed does not exist. A commit creates the file of the
next number and never overwrites one: of two writers that both saw the same state one fails to create it, and appends again after what came between, or, replacing, gives up.
A batch is known by its stream and its number in it, whatever was replaced since, so retries of `foreachBatch` change nothing; a
replacement has neither. A replacement by `compact_onto` names, in the same commit, the batches that came while it was made, so they go on in the new version. A stream belongs to the query that committed to it first: another one under the same name is an error. All records are read and written by Spark, wherever the store lies.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "number long, version long, stream string, query string, batch long, epoch long, head long, n long, base string, at timestamp"


@dataclass(frozen=True)
class Token:
    """What a reader resumes from: version, replay epoch, greatest seq and number of the version's commits."""

    version: int
    epoch: int
    head: int
    commits: int = 0


class StaleToken(RuntimeError):
    """The log was replaced since the token was read."""


class OtherQuery(RuntimeError):
    """The stream's name belongs to another query."""


class LogStore:
    """The store at a path, for any number of writers and readers."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self):
        """The manifest's folder and its file system."""
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        return folder, folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> DataFrame:
        """Committed batches; empty for a new store."""
        folder, files = self._files()
        if not files.exists(folder):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest")

    def _seen(self) -> tuple[Token, int]:
        """The newest version's token and the number of all commits, from one reading."""
        rows = self.manifest().groupBy("version").agg(F.max("epoch").alias("epoch"), F.max("head").alias("head"), F.count("*").alias("commits"), F.max("number").alias("number")).orderBy("version").collect()
        if not rows:
            return Token(0, 0, 0), 0
        last = rows[-1]
        return Token(last["version"], last["epoch"], last["head"], last["commits"]), max(r["number"] or 0 for r in rows) or sum(r["commits"] for r in rows)  # stores written before commits had numbers

    def token(self) -> Token:
        """Of the newest version; zeros for a new store."""
        return self._seen()[0]

    def _commit(self, number: int, token: Token, stream: str | None, query: str | None, batch: int | None, epoch: int, base: str, late: list[dict] | None = None) -> bool:
        """Adds the commit of that number for what is written at `base`, and for `late` batches that go on beside it; False if another writer has made it."""
        at = self.spark.read.parquet(f"{base}/records").agg(F.max("seq").alias("head"), F.count("*").alias("n")).first()
        row = {"version": token.version, "stream": stream, "query": query, "batch": batch, "epoch": epoch, "head": max(token.head, at["head"] or 0), "n": at["n"], "base": base}
        side = {"number": number, "at": datetime.now(UTC).isoformat()}
        lines = [json.dumps(r | side) for r in (row, *(late or []))]
        folder, files = self._files()
        jvm = self.spark.sparkContext._jvm
        try:
            out = files.create(jvm.org.apache.hadoop.fs.Path(folder, f"{number:012d}.json"), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                return False
            raise
        out.write(("\n".join(lines) + "\n").encode())
        out.close()
        return True

    def committed(self, batch: int, stream: str = "") -> bool:
        """Whether the stream's batch was committed, in this version or one that was replaced since."""
        return not self.manifest().filter((F.col("stream") == stream) & (F.col("batch") == batch)).isEmpty()

    def append(self, batch: int, records: DataFrame, *, stream: str = "", query: str | None = None, progress: DataFrame | None = None, identities: DataFrame | None = None) -> bool:
        """Commits records (with scene_id and seq), producers' progress and layer identities as one batch of a stream; False if it was committed before.

        query: who commits; a stream that another query has committed to raises OtherQuery. Where the log was replaced or appended to meanwhile, the batch goes after that.
        """
        base = ""
        while True:
            token, commits = self._seen()
            others = self.manifest().filter((F.col("stream") == stream) & F.col("query").isNotNull() & (F.col("query") != F.lit(query)))
            if query is not None and not others.isEmpty():
                raise OtherQuery(f"stream {stream!r} belongs to another query")
            if self.committed(batch, stream):
                return False
            if not base:
                base = f"{self.path}/batches/{stream or 'main'}-{batch}-{uuid.uuid4().hex}"
                records.write.parquet(f"{base}/records")
                if progress is not None:
                    progress.write.parquet(f"{base}/progress")
                if identities is not None:
                    identities.write.parquet(f"{base}/identities")
                continue  # the state may have changed while the records were written
            if self._commit(commits + 1, token, stream, query, batch, max(token.epoch, 1), base):
                return True

    def _tables(self, kind: str, token: Token) -> list[str]:
        rows = self.manifest().filter(f"version = {token.version}").select("base").collect()  # one row a batch of one version
        return [f for r in rows if self._exists(f := f"{r['base']}/{kind}")]

    def _exists(self, path: str) -> bool:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)

    def read(self, first: int = 1, last: int | None = None, *, kind: str = "records") -> DataFrame | None:
        """Committed rows of the newest version, records by seq from first to last; None if there are none."""
        files = self._tables(kind, self.token())
        if not files:
            return None
        rows = self.spark.read.parquet(*files)
        if kind != "records":
            return rows
        return rows.filter(F.col("seq") >= first) if last is None else rows.filter(F.col("seq").between(first, last))

    def progress(self) -> DataFrame | None:
        """Committed id of each session; it never falls."""
        rows = self.read(kind="progress")
        return None if rows is None else rows.groupBy("client_id", "session_id").agg(F.max("committed_through").alias("committed_through"))

    def identities(self) -> DataFrame | None:
        """Committed layer identities: identifier and layer_key."""
        rows = self.read(kind="identities")
        return None if rows is None else rows.dropDuplicates(["identifier"])

    def replace(self, records: DataFrame, *, expected: Token, progress: DataFrame | None = None) -> Token:
        """A new version that holds `records` alone, in a new replay epoch; fails if the log is not as expected, appended batches included.

        Progress and identities stay. The check is made before the records are written and again with the commit.
        """
        if self.token() != expected:
            raise StaleToken(f"expected {expected}, found {self.token()}")
        side = {"progress": progress if progress is not None else self.progress(), "identities": self.identities()}
        base = f"{self.path}/versions/{expected.version + 1}/{uuid.uuid4().hex}"
        records.write.parquet(f"{base}/records")
        for name, rows in side.items():
            if rows is not None:
                rows.write.parquet(f"{base}/{name}")
        now, commits = self._seen()
        if now != expected or not self._commit(commits + 1, Token(expected.version + 1, expected.epoch + 1, 0), None, None, None, expected.epoch + 1, base):
            raise StaleToken(f"expected {expected}, found {self.token()}")
        return self.token()

    def compact(self, reduce: Callable[[DataFrame], DataFrame], *, tries: int = 3, least_new: int = 1) -> Token:
        """Replaces the log by its reduction; nothing happens to one that has fewer than `least_new` rows since its last replacement.

        What is appended while the reduction runs is found by the changed token, and the reduction is made again, over all.
        """
        for _ in range(tries):
            start = self.token()
            fresh = self.manifest().filter(f"version = {start.version} and stream is not null").agg(F.sum("n")).first()[0] or 0
            log = self.read()
            if log is None or fresh < least_new:
                return start
            try:
                return self.replace(reduce(log), expected=start)
            except StaleToken:
                continue
        raise StaleToken(f"the log changed during {tries} compactions")

    def compact_onto(self, reduce: Callable[[DataFrame, tuple[DataFrame, DataFrame] | None], tuple[DataFrame, DataFrame]], *, least_new: int = 1) -> Token:
        """Replaces the log by a reduction that goes on from the one before, at the first try, whatever is appended meanwhile.

        `reduce` gets the records since the last such compaction and its reduced records with what they carry (None if there was none), and gives both anew, as operators.reduce.reduced does.
        Batches appended while it runs are not in it: the commit names them as part of the new version, and the next compaction reduces them on top. A log that was replaced meanwhile raises StaleToken.
        A scene's later batches have greater seqs. Nothing happens with fewer than `least_new` records since the last replacement.
        """
        start = self.token()
        rows = self.manifest().filter(f"version = {start.version}").collect()  # one row a batch of one version
        fresh, held = [r for r in rows if r["stream"] is not None], [r for r in rows if r["stream"] is None]
        if not rows or sum(r["n"] for r in fresh) < least_new:
            return start
        before = None
        if held and self._exists(f"{held[0]['base']}/carry"):
            before = tuple(self.spark.read.parquet(f"{held[0]['base']}/{kind}") for kind in ("records", "carry"))
        new = self.spark.read.parquet(*(f"{r['base']}/records" for r in (fresh if before else rows)))
        records, carry = reduce(new, before)
        base = f"{self.path}/versions/{start.version + 1}/{uuid.uuid4().hex}"
        records.write.parquet(f"{base}/records")
        carry.write.parquet(f"{base}/carry")
        known = {r["base"] for r in rows}
        for kind, key in (("progress", ["client_id", "session_id"]), ("identities", ["identifier"])):
            files = [f"{b}/{kind}" for b in sorted(known) if self._exists(f"{b}/{kind}")]
            if files:
                side = self.spark.read.parquet(*files)
                side = side.groupBy(*key).agg(F.max("committed_through").alias("committed_through")) if kind == "progress" else side.dropDuplicates(key)
                side.write.parquet(f"{base}/{kind}")
        epoch = start.epoch + 1
        while True:
            now, commits = self._seen()
            if now.version != start.version:
                raise StaleToken(f"expected version {start.version}, found {now}")
            late = [r.asDict() for r in self.manifest().filter(f"version = {start.version}").collect() if r["base"] not in known]
            late = [{k: r[k] for k in ("stream", "query", "batch", "head", "n", "base")} | {"version": start.version + 1, "epoch": epoch} for r in late]
            if self._commit(commits + 1, Token(start.version + 1, epoch, 0), None, None, None, epoch, base, late):
                return self.token()

    def replace_if(self, accepted: Callable[[DataFrame | None], bool], records: DataFrame) -> tuple[bool, Token]:
        """Replaces the log by an upload that `accepted` judges good against it, at one and the same token."""
        start = self.token()
        if not accepted(self.read()):
            return False, start
        return True, self.replace(records, expected=start)

    def purge(self) -> Token:
        """Empties the log; producers' progress and identities stay."""
        log = self.read()
        if log is None:
            return self.token()
        return self.replace(log.limit(0), expected=self.token())
