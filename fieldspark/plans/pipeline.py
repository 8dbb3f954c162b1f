"""Pipelines of named tasks: parsing, topological order, concurrent Spark jobs, failure cascade."""

from __future__ import annotations

import logging
import re
import threading
import time
from collections import deque
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timex
from ..operators import blend as bl
from .config import Config, ConfigError

PROFILES = ("linear", "step")
POLICIES = {"clamp": "clamp_to_edge", "cycle": "cycle_last_year"}
log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Stream:
    name: str
    temporal_profile: str
    out_of_bounds_policy: str
    dataset_path: str
    interval_ns: int


@dataclass
class PipelineConfig:
    tasks: list[str]
    edges: list[tuple[str, str]] = field(default_factory=list)
    streams: list[Stream] = field(default_factory=list)
    max_concurrency: int = 4
    deadlock_timeout: float = 60.0
    shutdown_timeout: float = 30.0


def parse_interval(text: str) -> int:
    """Integer seconds with an optional s; anything else is 0, which the parser rejects."""
    m = re.fullmatch(r"(\d+)[sS]?", text)
    return int(m[1]) * timex.NS["s"] if m else 0


def parse_pipeline(text: str) -> PipelineConfig:
    """Validates required fields, unique names, known references and freedom from cycles."""
    c = Config.from_string(text)
    out = PipelineConfig([])
    out.max_concurrency = c.get_or("settings.max_concurrency", 4)
    out.deadlock_timeout = float(c.get("settings.deadlock_timeout", float)) if c.has("settings.deadlock_timeout") else 60.0
    out.shutdown_timeout = float(c.get("settings.shutdown_timeout", float)) if c.has("settings.shutdown_timeout") else 30.0
    if out.max_concurrency < 1:
        raise ConfigError("out_of_range", "settings.max_concurrency")
    for k in range(len(c.find("streams"))):
        f = {n: c.get(f"streams.{k}.{n}") for n in ("name", "temporal_profile", "out_of_bounds_policy", "dataset_path", "snapshot_interval")}
        if f["temporal_profile"] not in PROFILES or f["out_of_bounds_policy"] not in POLICIES:
            raise ConfigError("invalid_arg", f"stream {f['name']}: profile or policy")
        interval = parse_interval(f["snapshot_interval"])
        if interval <= 0:
            raise ConfigError("invalid_arg", f"stream {f['name']}: snapshot_interval")
        out.streams.append(Stream(f["name"], f["temporal_profile"], f["out_of_bounds_policy"], f["dataset_path"], interval))
    out.tasks = [c.get(f"tasks.{k}.name") for k in range(len(c.find("tasks")))]
    out.edges = [(c.get(f"dependencies.{k}.from"), c.get(f"dependencies.{k}.to")) for k in range(len(c.find("dependencies")))]
    for names in (out.tasks, [s.name for s in out.streams]):
        if len(set(names)) < len(names):
            raise ConfigError("invalid_arg", "names must be unique")
    if unknown := {n for e in out.edges for n in e} - set(out.tasks):
        raise ConfigError("invalid_arg", f"unknown tasks {sorted(unknown)}")
    topological_order(out.tasks, out.edges)
    return out


def topological_order(tasks: list[str], edges: list[tuple[str, str]]) -> list[str]:
    """First-in first-out by position; a cycle raises."""
    waits = {t: 0 for t in tasks}
    after: dict[str, list[str]] = {t: [] for t in tasks}
    for a, b in edges:
        waits[b] += 1
        after[a].append(b)
    ready, out = deque(t for t in tasks if not waits[t]), []
    while ready:
        t = ready.popleft()
        out.append(t)
        for b in sorted(after[t], key=tasks.index):
            waits[b] -= 1
            if not waits[b]:
                ready.append(b)
    if len(out) < len(tasks):
        raise ConfigError("invalid_arg", f"cycle through {sorted(set(tasks) - set(out))}")
    return out


class SlotPool:
    """Slots that tasks hold while they run; all or nothing."""

    def __init__(self, slots: int):
        self.total = self.available = slots
        self._lock = threading.Condition()

    def allocate(self, n: int) -> bool:
        with self._lock:
            if n > self.available:
                return False
            self.available -= n
            return True

    def release(self, n: int) -> None:
        with self._lock:
            if self.available + n > self.total:
                raise ValueError("more released than allocated")
            self.available += n
            self._lock.notify_all()

    def add(self, n: int) -> None:
        with self._lock:
            self.total += n
            self.available += n

    def remove(self, n: int) -> int:
        """Takes idle slots away, as many as there are; returns how many."""
        with self._lock:
            n = min(n, self.available)
            self.total -= n
            self.available -= n
            return n


@dataclass
class Report:
    status: dict[str, str]
    errors: dict[str, BaseException]
    results: dict[str, object]


class Orchestrator:
    """Runs a task's function when the tasks it depends on have completed, several Spark jobs at a time.

    A failed task cancels everything that depends on it, directly or not;
    other branches go on.  Tasks run in pool ``fieldspark`` of a FAIR
    scheduler, if the session has one.
    """

    def __init__(self, spark: SparkSession, config: PipelineConfig, functions: dict[str, Callable[[SparkSession, dict], object]]):
        self.spark, self.config, self.functions = spark, config, functions
        self.order = topological_order(config.tasks, config.edges)
        self.stopping = threading.Event()
        self.slots = SlotPool(config.max_concurrency)

    def shutdown(self) -> None:
        """Lets running tasks end and cancels the rest."""
        self.stopping.set()

    def run(self) -> Report:
        c = self.config
        status = {t: "pending" for t in c.tasks}
        errors: dict[str, BaseException] = {}
        results: dict[str, object] = {}
        before = {t: {a for a, b in c.edges if b == t} for t in c.tasks}
        running: dict = {}
        last, warned = time.monotonic(), False

        def call(task: str) -> object:
            self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", "fieldspark")
            return self.functions[task](self.spark, {a: results[a] for a in before[task]})

        with ThreadPoolExecutor(max(1, self.slots.total)) as pool:
            while True:
                if self.stopping.is_set():
                    for t in status:
                        if status[t] in ("pending", "ready"):
                            status[t] = "cancelled"
                for t in self.order:
                    if status[t] == "pending" and all(status[a] == "completed" for a in before[t]):
                        status[t] = "ready"
                    if status[t] == "ready" and self.slots.allocate(1):
                        status[t] = "running"
                        running[pool.submit(call, t)] = t
                if not running:
                    return Report(status, errors, results)
                done, _ = wait(running, timeout=1.0, return_when=FIRST_COMPLETED)
                for f in done:
                    t = running.pop(f)
                    self.slots.release(1)
                    if e := f.exception():
                        status[t], errors[t] = "failed", e
                        self._cascade(t, status)
                    else:
                        status[t], results[t] = "completed", f.result()
                if done:
                    last, warned = time.monotonic(), False
                elif not warned and time.monotonic() - last > c.deadlock_timeout:
                    warned = True
                    log.warning("no task has ended for %.0f s; running: %s", c.deadlock_timeout, sorted(running.values()))

    def _cascade(self, failed: str, status: dict[str, str]) -> None:
        queue = deque([failed])
        while queue:
            a = queue.popleft()
            for x, b in self.config.edges:
                if x == a and status[b] in ("pending", "ready"):
                    status[b] = "cancelled"
                    queue.append(b)


def stream_field(spark: SparkSession, stream: Stream, var: str, times: DataFrame, start: int, end: int) -> DataFrame:
    """A stream's field (sim_ns, cell_id, value) at simulation times (t_ns), from its dataset of equally spaced snapshots (var, t_idx, i0, value)."""
    data = spark.read.parquet(f"{stream.dataset_path}/data").where(F.col("var") == var)
    snap = data.select((F.col("t_idx") * stream.interval_ns + start).alias("t_ns"), F.col("i0").alias("cell_id"), "value")
    cov = timex.Coverage(start, end, stream.interval_ns, POLICIES[stream.out_of_bounds_policy])
    return bl.bookend(snap, times, cov, stream.temporal_profile)
