"""Panes over a stream: late rows change one pane, and only the windows that cover it are emitted again."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.operators import panes
from rivulet.session import children, exists, remove
from rivulet.streaming import sinks


@dataclass
class PaneStream:
    """For foreachBatch: keeps panes by micro-batch in a folder and emits the windows that changed.

    Each micro-batch adds its own partial panes; a pane is the sum of its parts, so nothing is rewritten and a repeated
    micro-batch replaces only its own part. The windows that cover a changed pane are recomposed from all parts of their
    panes, which are found by the day they lie in. Rows past the cut-off of their pane are counted apart (n_past), or with
    by_window those past the cut-off of the window. After every compact_every micro-batches the parts are summed into one
    base, so that a micro-batch never reads more than that many folders beside it; the last two bases are kept, and what a
    repeated micro-batch needs is there. A read that fails makes the micro-batch fail, and so come again.
    """

    spark: SparkSession
    folder: str
    size: int
    slide: int
    cutoff_s: int
    keys: Sequence[str] = ()
    event_s: str = "created_utc"
    arrival: str = "ingest_ts"
    values: dict[str, Column] = field(default_factory=dict)
    by_window: bool = False
    compact_every: int = 50

    @property
    def sums(self) -> list[str]:
        return ["n", "n_late", "n_past", *self.values]

    def __call__(self, df: DataFrame, batch_id: int) -> None:
        event = F.when(F.col(self.event_s) > 0, F.col(self.event_s))
        if self.by_window:
            part = panes.window_panes(df, self.keys, event, F.col(self.arrival), self.values, self.size, self.slide, self.cutoff_s)
        else:
            judged = panes.judge(df, event, F.col(self.arrival), panes.pane_size(self.size, self.slide), self.cutoff_s)
            part = panes.panes(judged, self.keys, self.values)
        part = part.withColumn("day", F.floor(F.col("pane_start") / 86400).cast("int"))
        part.write.mode("overwrite").partitionBy("day").parquet(f"{self.folder}/panes/batch={batch_id}")
        fresh = self.spark.read.schema(part.schema).parquet(f"{self.folder}/panes/batch={batch_id}")
        days = [r["day"] for r in fresh.select(F.explode(F.sequence(F.col("day") - self.size // 86400 - 1, F.col("day") + self.size // 86400 + 1)).alias("day")).distinct().collect()]
        if not days:
            return
        start = F.explode(panes.covering_windows(F.col("pane_start"), F.col("pane_end"), self.size, self.slide))
        changed = fresh.select(*self.keys, start.alias("window_start")).distinct()
        stored = self._stored(batch_id, part.schema)
        near = stored.where(F.col("day").isin(*days))
        if self.by_window:
            whole = panes.recompose_windows(near, self.keys, list(self.values), self.size, self.slide)
        else:
            whole = panes.recompose(near, self.keys, self.sums, self.size, self.slide)
        a, b = whole.alias("a"), changed.alias("b")
        same = F.col("a.window_start") == F.col("b.window_start")
        for k in self.keys:
            same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        sinks.put_batch(a.join(b, same, "left_semi"), f"{self.folder}/windows", batch_id)
        if batch_id % self.compact_every == self.compact_every - 1:
            self._compact(stored, batch_id)

    def _numbers(self, kind: str) -> list[int]:
        """The finished micro-batches or bases in their folder."""
        at = f"{self.folder}/{kind}"
        found = sorted(int(n.partition("=")[2]) for n in children(self.spark, at) if "=" in n)
        name = {"panes": "batch", "bases": "upto"}[kind]
        return [n for n in found if exists(self.spark, f"{at}/{name}={n}/_SUCCESS")]

    def _stored(self, batch_id: int, schema: T.StructType) -> DataFrame:
        """All partial panes up to a micro-batch: the last base before it and the parts after that."""
        bases = [n for n in self._numbers("bases") if n < batch_id]
        base = max(bases, default=-1)
        parts = [f"{self.folder}/panes/batch={n}" for n in self._numbers("panes") if base < n <= batch_id]
        if bases:
            parts.append(f"{self.folder}/bases/upto={base}")
        out = None  # each folder has its own days
        for p in parts:
            one = self.spark.read.schema(schema).parquet(p)
            out = one if out is None else out.unionByName(one)
        return out

    def _compact(self, stored: DataFrame, batch_id: int) -> None:
        sums = ["n_rows", *self.values] if self.by_window else self.sums
        keys = [*self.keys, "pane_start", "pane_end", *(["due_from", "kept_from"] if self.by_window else []), "day"]
        base = stored.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]).select(*stored.columns)
        base.write.mode("overwrite").partitionBy("day").parquet(f"{self.folder}/bases/upto={batch_id}")
        before = [n for n in self._numbers("bases") if n < batch_id]
        for n in before[:-1]:
            remove(self.spark, f"{self.folder}/bases/upto={n}")
        for n in self._numbers("panes") if before else []:
            if n <= before[-1]:
                remove(self.spark, f"{self.folder}/panes/batch={n}")

    def current(self) -> DataFrame:
        """The last emission of each window."""
        emitted = self.spark.read.parquet(f"{self.folder}/windows")
        cols = [*self.sums, "window_end"]
        return emitted.groupBy(*self.keys, "window_start").agg(F.max_by(F.struct(*cols), "batch").alias("r")).select(*self.keys, "window_start", "r.*")
