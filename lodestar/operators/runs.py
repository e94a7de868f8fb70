"""States of clustering runs: a log of transitions for each channel, of which every entry is written once or not at all.

An entry is a small file whose name is its number. Who finds the number taken has lost the race, reads the log again and
is told by whom the channel is held. Nothing is changed in place, so a table of all runs is a scan of the log.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import density, spanning

#: What a run may become.
NEXT = {None: ("pending",), "pending": ("running", "failed"), "running": ("completed", "insufficient_data", "failed")}
ACTIVE = ("pending", "running")
ENTRY = (
    "workspace_id string, embedding_type string, run_id string, status string, at double, asset_count long, cluster_count long, "
    "noise_count long, noise_ratio double, error string"
)


class RunConflict(RuntimeError):
    """Another run holds the channel, or the run is not in the state that the transition is from."""


@dataclass
class RunLog:
    """The runs of all channels under root, a folder that every driver reaches."""

    spark: SparkSession
    root: str

    def _folder(self, workspace: str, channel: str) -> str:
        safe = [re.sub(r"[^A-Za-z0-9-]", lambda m: f"_{ord(m[0]):x}_", part) for part in (workspace, channel)]
        return f"{self.root.rstrip('/')}/{safe[0]}/{safe[1]}"

    def _jvm(self, folder: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        return jvm, path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def entries(self, workspace: str, channel: str) -> list[dict]:
        """A channel's entries, the earliest first."""
        jvm, path, fs = self._jvm(self._folder(workspace, channel))
        if not fs.exists(path):
            return []
        files = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().endswith(".json"))
        out = []
        for name in files:
            stream = fs.open(jvm.org.apache.hadoop.fs.Path(f"{self._folder(workspace, channel)}/{name}"))
            try:
                out.append(json.loads(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()))
            finally:
                stream.close()
        return out

    def _append(self, number: int, entry: dict) -> bool:
        """Writes entry `number` of its channel; false if there is one."""
        folder = self._folder(entry["workspace_id"], entry["embedding_type"])
        jvm, path, fs = self._jvm(folder)
        fs.mkdirs(path)
        own = jvm.org.apache.hadoop.fs.Path(f"{folder}/.{uuid.uuid4().hex}.tmp")
        final = jvm.org.apache.hadoop.fs.Path(f"{folder}/{number:08d}.json")
        out = fs.create(own, True)
        try:
            out.write(bytearray(json.dumps(entry).encode()))
        finally:
            out.close()
        try:
            if fs.getUri().getScheme() == "file":
                # A local rename replaces a file that is there; a link to a name that is taken fails.
                files, get = jvm.java.nio.file.Files, jvm.java.nio.file.FileSystems.getDefault().getPath
                none = self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)
                files.createLink(get(final.toUri().getPath(), none), get(own.toUri().getPath(), none))
                return True
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
            modes = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            context.rename(own, final, modes)
            return True
        except Exception as error:
            if fs.exists(final):
                return False
            raise error
        finally:
            fs.delete(own, False)

    def move(self, workspace: str, channel: str, run_id: str, status: str, since: str | None, **facts) -> None:
        """The transition of a run from `since` to `status`; RunConflict if the channel's log does not allow it.

        Compare and set: what was read is the last entry when the new one is written, or the log is read again.
        """
        if status not in NEXT.get(since, ()):
            raise RunConflict(f"a run does not go from {since} to {status}")
        while True:
            log = self.entries(workspace, channel)
            states = {e["run_id"]: e["status"] for e in log}
            if states.get(run_id) != since:
                raise RunConflict(f"run {run_id} is {states.get(run_id)}, not {since}")
            if since is None and (held := [r for r, s in states.items() if s in ACTIVE]):
                raise RunConflict(f"run {held[0]} holds {workspace}/{channel}")
            entry = {"workspace_id": workspace, "embedding_type": channel, "run_id": run_id, "status": status, "at": time.time()} | facts
            if self._append(len(log), entry):
                return

    def table(self) -> DataFrame:
        """A row for each run: its last state and when it began and ended."""
        rows = self.spark.read.schema(ENTRY).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(self.root)
        last = F.max_by(F.struct("status", "asset_count", "cluster_count", "noise_count", "noise_ratio", "error"), F.struct("at", F.col("status").isin(*ACTIVE) == False))  # noqa: E712
        ended = F.max(F.when(~F.col("status").isin(*ACTIVE), F.col("at"))).alias("ended_at")
        out = rows.groupBy("workspace_id", "embedding_type", "run_id").agg(last.alias("last"), F.min("at").alias("started_at"), ended)
        return out.select("workspace_id", "embedding_type", "run_id", "last.*", "started_at", "ended_at")


def run(
    log: RunLog,
    workspace: str,
    channel: str,
    vectors: DataFrame,
    publish: Callable[[DataFrame | None], None],
    dimension: int | None = 8,
    parameters: density.Parameters | None = None,
    run_id: str | None = None,
) -> dict:
    """One run over a channel's vectors(asset_id, embedding), and its last entry; RunConflict if another holds the channel.

    Without a vector the run ends as insufficient_data, and what was published is replaced by nothing. One vector is
    noise, and the run completed. `publish` gets (asset_id, label, probability), or None; what fails, it or the clustering,
    ends the run as failed, with the error in its entry. Of assets of one id the first vector counts.
    """
    run_id = run_id or uuid.uuid4().hex
    log.move(workspace, channel, run_id, "pending", None)
    log.move(workspace, channel, run_id, "running", "pending")
    try:
        known = vectors.where("asset_id is not null and embedding is not null").groupBy("asset_id").agg(F.min("embedding").alias("x"))
        n = known.count()
        if n == 0:
            publish(None)
            status, facts = "insufficient_data", {"asset_count": 0, "cluster_count": 0, "noise_count": 0, "noise_ratio": 0.0}
        else:
            # The hash of an id is its number; two assets of one hash are told by the count below.
            numbered = known.select(F.xxhash64("asset_id").alias("id"), "asset_id", F.col("x").cast("array<double>").alias("x"))
            if numbered.select("id").distinct().count() != n:
                raise ValueError("two assets have one hash")
            found = spanning.cluster_table(numbered.select("id", "x"), dimension, parameters)
            labels = numbered.select("id", "asset_id").join(found, "id").select("asset_id", "label", "probability")
            told = found.agg(F.count_if(F.col("label") < 0), F.count_distinct(F.when(F.col("label") >= 0, F.col("label")))).first()
            publish(labels)
            status, facts = "completed", {"asset_count": n, "cluster_count": told[1], "noise_count": told[0], "noise_ratio": told[0] / n}
    except Exception as error:
        log.move(workspace, channel, run_id, "failed", "running", error=(str(error) or type(error).__name__)[:2000])
        raise
    log.move(workspace, channel, run_id, status, "running", **facts)
    return log.entries(workspace, channel)[-1]
