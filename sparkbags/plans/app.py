"""Applications: phases of tasks over bags, run one phase after the other.

A task (blueprint) reads bags and writes bags; the tasks of a phase run at the same
time, as Spark jobs.  A task that ``needs_merge`` may run as several clones, which its
strategy admits by the size of the input.  The first input is dealt out once, into a
table by clone; the clones run at the same time, each over its own share with an output
of its own, and the application's ``merge`` makes one bag of them.  Finished phases are tables, so a run can start again
from any phase.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bag import Bag
from ..operators.skew import salt


@dataclass(frozen=True)
class AppConf:
    file: str = ""
    size: int = 1 << 30
    text_mode: bool = False
    genprops: dict = field(default_factory=dict)
    hashprops: dict = field(default_factory=dict)
    simulation: int = 0


@dataclass(frozen=True)
class Blueprint:
    """``task`` takes the input frames and returns a frame for each output (one frame
    if there is one output)."""

    name: str
    task: Callable[..., DataFrame | list[DataFrame]]
    inputs: tuple[str, ...] = ()
    outputs: tuple[str, ...] = ()
    needs_merge: bool = False
    mode: str = "overwrite"


class CloningStrategy:
    """How many clones of a task run.  Subclass to admit them by other signs of load."""

    def clones(self, phase: int, blueprint: Blueprint, size: int) -> int:
        """``size``: bytes of the task's first input on disk."""
        raise NotImplementedError


@dataclass(frozen=True)
class Fixed(CloningStrategy):
    n: int = 4

    def clones(self, phase: int, blueprint: Blueprint, size: int) -> int:
        return self.n


@dataclass(frozen=True)
class BySize(CloningStrategy):
    """A clone for each so many bytes of input, up to a number."""

    each: int = 1 << 30
    most: int = 16

    def clones(self, phase: int, blueprint: Blueprint, size: int) -> int:
        return max(1, min(self.most, -(-size // self.each)))


class Application:
    """Subclass with ``blueprints`` (and ``merge``, if tasks need it)."""

    strategy: CloningStrategy = Fixed(4)

    def __init__(self, spark: SparkSession, root: str, conf: AppConf | None = None):
        self.spark, self.root, self.conf = spark, root.rstrip("/"), conf or AppConf()
        self.timings: list[tuple[int, float]] = []

    def blueprints(self) -> list[list[Blueprint]]:
        raise NotImplementedError

    def merge(self, phase: int, blueprint: Blueprint, parts: list[DataFrame]) -> DataFrame:
        """One frame from the outputs of a task's clones."""
        raise NotImplementedError(f"{blueprint.name} needs a merge")

    def bag(self, name: str) -> Bag:
        return Bag(self.spark, self.root, name)

    def describe(self) -> str:
        """The plan as text, without running it."""
        return "\n".join(f"phase {i}: {b.name}({', '.join(b.inputs)}) -> {', '.join(b.outputs)}{' [merge]' if b.needs_merge else ''}" for i, phase in enumerate(self.blueprints()) for b in phase)

    def _run(self, phase: int, b: Blueprint) -> None:
        ins = [self.bag(x).df for x in b.inputs]
        n = self.strategy.clones(phase, b, self.bag(b.inputs[0]).size()) if b.needs_merge and ins else 1
        if n > 1:
            self._run_clones(phase, b, ins, n)
            return
        outs = b.task(*ins)
        for name, out in zip(b.outputs, [outs] if isinstance(outs, DataFrame) else outs, strict=True):
            self.bag(name).write(out, b.mode)

    def _run_clones(self, phase: int, b: Blueprint, ins: list[DataFrame], n: int) -> None:
        dealt = self.bag(f"{b.outputs[0]}.shares")
        salt(ins[0], n, name="_clone").write.mode("overwrite").partitionBy("_clone").parquet(dealt.path)
        share = self.spark.read.schema(ins[0].withColumn("_clone", F.lit(0)).schema).parquet(dealt.path)
        parts = [self.bag(f"{b.outputs[0]}.clone{k}") for k in range(n)]
        with ThreadPoolExecutor(n) as pool:
            runs = [pool.submit(part.write, b.task(share.where(F.col("_clone") == k).drop("_clone"), *ins[1:]), "overwrite") for k, part in enumerate(parts)]
            for done in runs:
                done.result()
        self.bag(b.outputs[0]).write(self.merge(phase, b, [p.df for p in parts]), b.mode)
        for bag in (dealt, *parts):
            fs, path = bag._fs()
            fs.delete(path, True)

    def run(self, from_phase: int = 0) -> Application:
        """Run all phases from one on; the first failure of a task ends the run."""
        self.timings = []
        for i, phase in enumerate(self.blueprints()):
            if i < from_phase:
                continue
            began = time.monotonic()
            with ThreadPoolExecutor(max(1, len(phase))) as pool:
                for done in [pool.submit(self._run, i, b) for b in phase]:
                    done.result()
            self.timings.append((i, time.monotonic() - began))
        return self
