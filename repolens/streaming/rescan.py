"""Incremental rescans on Structured Streaming: changed files in, fresh findings out.

A stream of changes (repo_id, path, content, seq; a null content deletes, the greatest seq of a path is its newest)
updates a table of contents and a cache of facts by content hash. Each micro-batch writes what it changed under its own
number, contents and newly extracted facts alike; the newest of a path counts. A batch that fails is run again and
writes the same folders anew; after a restart the state is what complete folders of earlier batches hold. Every
COMPACT batches the state is written whole, so that as many small tables are read at most. Graph rules are global
and run again over all facts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from repolens.plans.scan import Scan, scan
from repolens.sources.config import Config
from repolens.sources.frontends.common import LANGUAGES
from repolens.sources.repositories import MANIFESTS, SKIPPED
from repolens.sources.schema import FACT_SCHEMA

CHANGES = "repo_id string, path string, content binary, seq long"
_STATE = {"contents": CHANGES, "facts": FACT_SCHEMA}
#: Batches between two whole copies of the state.
COMPACT = 16


def relevant(changes: DataFrame) -> DataFrame:
    """Changes of source files, manifests and configuration outside skipped directories."""
    names = "|".join([*(rf"\.{x}$" for x in LANGUAGES), *(rf"(^|/){x.replace('.', chr(92) + '.')}$" for x in [*MANIFESTS, "tsconfig.json", ".gitignore"])])
    return changes.filter(F.col("path").rlike(names) & ~F.col("path").rlike("(^|/)(" + "|".join(SKIPPED).replace(".", r"\.") + ")/"))


class Rescanner:
    """Keeps contents and facts under ``folder``; call it with a batch of changes. Another one goes on with the same folder."""

    def __init__(self, spark: SparkSession, folder: str, config: Config | None = None, emit: Callable[[Scan, int], None] | None = None):
        self.spark, self.folder, self.config, self.emit = spark, folder.rstrip("/"), config or Config(), emit
        self.extracted = 0

    def _numbers(self, kind: str) -> list[int]:
        """Batches whose folder of this kind is complete."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(root):
            return []
        names = [x.getPath().getName() for x in files.listStatus(root)]
        done = [n for n in names if n.isdigit() and files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}/{n}/_SUCCESS"))]
        return sorted(map(int, done))

    def state(self, name: str, before: int) -> DataFrame:
        """The rows of ``contents`` or ``facts`` as the batches before this one left them; contents with their deletions."""
        schema, key = _STATE[name], ["repo_id", "path"]
        bases = [n for n in self._numbers(f"{name}-whole") if n < before]
        tables = [(n, f"{name}-whole/{n}") for n in bases[-1:]] + [(n, f"{name}/{n}") for n in self._numbers(name) if (bases[-1] if bases else -1) < n < before]
        rows = None
        for n, path in tables:
            one = self.spark.read.schema(schema).parquet(f"{self.folder}/{path}").withColumn("batch", F.lit(n))
            rows = one if rows is None else rows.unionByName(one)
        if rows is None:
            return self.spark.createDataFrame([], schema)
        if name == "facts":
            return rows.drop("batch")
        newest = rows.groupBy(*key).agg(F.max("batch").alias("batch"))
        return rows.join(newest, [*key, "batch"], "left_semi").drop("batch")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        # of several changes of a path in a batch the one with the greatest number counts (equal ones: the greatest content)
        order = F.struct(F.coalesce("seq", F.lit(-(1 << 62))), F.col("content").isNotNull(), "content")
        changes = relevant(batch).groupBy("repo_id", "path").agg(F.max_by(F.struct("content", "seq"), order).alias("s")).select("repo_id", "path", "s.content", "s.seq")
        changes.write.mode("overwrite").parquet(f"{self.folder}/contents/{batch_id}")
        contents, facts = self.state("contents", batch_id + 1), self.state("facts", batch_id)
        tree = contents.filter("content is not null").select("repo_id", "path", "content")
        found = scan(tree, self.config, cache=facts)
        key = ["repo_id", "path", "content_hash"]
        found.workspace.facts.join(facts.select(*key), key, "left_anti").write.mode("overwrite").parquet(f"{self.folder}/facts/{batch_id}")
        self.extracted = self.spark.read.schema(FACT_SCHEMA).parquet(f"{self.folder}/facts/{batch_id}").count()
        if batch_id % COMPACT == COMPACT - 1:
            contents.filter("content is not null").write.mode("overwrite").parquet(f"{self.folder}/contents-whole/{batch_id}")
            found.workspace.facts.write.mode("overwrite").parquet(f"{self.folder}/facts-whole/{batch_id}")
        if self.emit:
            self.emit(found, batch_id)


def bursts(changes: DataFrame, key: list[str], time: str = "ts", gap: str = "300 milliseconds") -> DataFrame:
    """(key, began, n): runs of changes that one rescan answers; a run ends after a quiet gap."""
    return changes.groupBy(*key, F.session_window(time, gap)).agg(F.min(time).alias("began"), F.count(F.lit(1)).alias("n")).drop("session_window")


def watch(changes: DataFrame, rescanner: Rescanner, checkpoint: str, every: str = "2 seconds", available_now: bool = False) -> StreamingQuery:
    """Start the stream; bursts within one trigger are answered by one rescan."""
    writer = changes.writeStream.foreachBatch(rescanner).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()
