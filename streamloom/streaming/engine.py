"""Submitting, sharing, listing, deleting and restoring queries.

Queries of one application that read the same source share one StreamingQuery: its micro-batches
are persisted once. Those that are a condition and a message (`submit_route`) are evaluated for all
of them in one pass over the batch; equal plans of others are evaluated once, and different ones
side by side. A query whose sink fails is tried again, then set aside with its error, and the
others go on. A source starts with its first query and stops with its last. Queries with state of
their own share a run if they read the same source by the same plan.

What was submitted is noted below the engine's folder, on any file system Spark can write, with the
functions themselves, so that `restore` submits it again after a restart.
"""

from __future__ import annotations

import base64
import hashlib
import inspect
import json
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


@dataclass
class _Member:
    sink: Callable
    plan: Callable[[DataFrame], DataFrame] | None = None
    route: Callable[[], tuple[Column, Column]] | None = None
    like: str = ""
    error: Exception | None = None


@dataclass
class _Shared:
    source: DataFrame
    trigger: dict
    members: dict[str, _Member] = field(default_factory=dict)
    running: StreamingQuery | None = None
    rate: Ewma | None = None


def _mark(function: Callable) -> str:
    """A digest that equal functions share; functions that can't be pickled have one of their own."""
    try:
        return hashlib.sha256(cloudpickle.dumps(function)).hexdigest()
    except Exception:  # noqa: BLE001
        return uuid.uuid4().hex


def _made(spark: SparkSession, source: Callable) -> DataFrame:
    return source(spark) if inspect.signature(source).parameters else source()


class _Notes:
    """Texts below a folder of any file system."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.folder = spark._jvm, folder
        self.fs = self.jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/notes/{name}.json")

    def write(self, name: str, text: str) -> None:
        out = self.fs.create(self._path(name), True)
        out.write(bytearray(text.encode()))
        out.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), False)

    def read(self) -> list[str]:
        folder = self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/notes")
        if not self.fs.exists(folder):
            return []
        out = []
        for status in self.fs.listStatus(folder):
            if status.getPath().getName().endswith(".json"):
                stream = self.fs.open(status.getPath())
                out.append(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
                stream.close()
        return out


class Engine:
    """Queries by application; checkpoints and notes below one folder."""

    def __init__(self, spark: SparkSession, folder: str, tries: int = 3, threads: int = 8):
        self.spark, self.folder, self.tries, self.threads = spark, folder.rstrip("/"), tries, threads
        self._lock = threading.RLock()
        self._shared: dict[tuple, _Shared] = {}
        self._queries: dict[str, tuple] = {}
        self._notes = _Notes(spark, self.folder)

    # --- submitting

    def submit(self, application: str, source_id: str, source: Callable, plan: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], query_id: str | None = None, **trigger) -> str:
        """Start a stateless query; the source is shared with all of the application that name it.

        source() or source(spark) gives the live stream, plan(batch) the result, and sink(result,
        number) writes it. A query of a running source can't ask for another trigger.
        """
        return self._join("plan", application, source_id, source, _Member(sink, plan=plan, like=_mark(plan)), query_id, trigger, plan)

    def submit_route(self, application: str, source_id: str, source: Callable, route: Callable[[], tuple[Column, Column]], sink: Callable, query_id: str | None = None, **trigger) -> str:
        """Start a query that sends a message for each row that a condition holds for.

        route() gives (condition, message). All routes of a source are evaluated in one pass. A sink
        that has `send(texts)` is called on the executors, once for each partition that has texts;
        any other is called as sink(rows with `value`, number).
        """
        return self._join("route", application, source_id, source, _Member(sink, route=route), query_id, trigger, route)

    def _join(self, kind: str, application: str, source_id: str, source: Callable, member: _Member, query_id: str | None, trigger: dict, plan: Callable) -> str:
        query_id, key = query_id or uuid.uuid4().hex, (application, source_id)
        with self._lock:
            shared = self._shared.get(key)
            if shared is not None and shared.running is not None and shared.running.isActive and trigger and trigger != shared.trigger:
                raise ValueError(f"source {source_id} runs with the trigger {shared.trigger}")
            if shared is None:
                shared = self._shared[key] = _Shared(_made(self.spark, source), trigger)
            shared.members[query_id] = member
            self._queries[query_id] = key
            self._note(query_id, kind, application, source_id, source, plan, member.sink, shared.trigger)
            self._start(key, shared, f"{application}-{source_id}", lambda batch, number: self._fan_out(shared, batch, number))
        return query_id

    def submit_stateful(
        self, application: str, df: DataFrame | Callable, sink: Callable[[DataFrame, int], None], mode: str = "append", name: str | None = None, source_id: str | None = None, plan: Callable | None = None, **trigger
    ) -> str:
        """Start a query with state; its name keeps its checkpoint across restarts.

        Either df is the live result itself, or it is source() / source(spark) and plan(stream) makes
        the result; then queries of one application with one source_id and equal plans share a run,
        and a later one sees results from its submission on.
        """
        query_id = name or uuid.uuid4().hex
        if plan is None:
            key, place, make = (application, query_id, "own"), query_id, (lambda: df)
        else:
            like = _mark(plan)
            key, place, make = (application, source_id, like), f"{source_id}-{like[:16]}", (lambda: plan(_made(self.spark, df)))
        with self._lock:
            shared = self._shared.get(key)
            if shared is None:
                shared = self._shared[key] = _Shared(make(), trigger)
            shared.members[query_id] = _Member(sink, plan=lambda batch: batch, like="same")
            self._queries[query_id] = key
            if plan is not None:
                self._note(query_id, "stateful", application, source_id, df, plan, sink, {**shared.trigger, "mode": mode})
            self._start(key, shared, f"{application}-{place}", lambda batch, number: self._fan_out(shared, batch, number), mode)
        return query_id

    def _start(self, key: tuple, shared: _Shared, place: str, each: Callable, mode: str = "append") -> None:
        if shared.running is None or not shared.running.isActive:
            writer = shared.source.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{self.folder}/{place}")
            # Where the scheduler is fair, each application has a pool of its own.
            self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", str(key[0]))
            try:
                shared.running = (writer.trigger(**shared.trigger) if shared.trigger else writer).start()
            finally:
                self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    # --- running

    def _fan_out(self, shared: _Shared, batch: DataFrame, number: int) -> None:
        with self._lock:
            members = {i: m for i, m in shared.members.items() if m.error is None}
        if not members:
            return
        groups: dict[str, list[str]] = {}
        for i, m in members.items():
            groups.setdefault("route" if m.route else f"plan {m.like}", []).append(i)
        alone = len(groups) == 1 and len(members) == 1
        batch = batch if alone else batch.persist()
        try:
            jobs = [(lambda ids=ids: self._route(members, ids, batch, number)) if kind == "route" else (lambda ids=ids: self._plan(members, ids, batch, number)) for kind, ids in groups.items()]
            if len(jobs) == 1:
                jobs[0]()
            else:
                with ThreadPoolExecutor(self.threads) as pool:
                    list(pool.map(lambda job: job(), jobs))
        finally:
            if not alone:
                batch.unpersist()

    def _tried(self, member: _Member, work: Callable[[], None]) -> None:
        """Run a member's work up to `tries` times; an error that stays sets the member aside."""
        for left in range(self.tries, 0, -1):
            try:
                return work()
            except Exception as error:  # noqa: BLE001
                if left == 1:
                    member.error = error

    def _plan(self, members: dict, ids: list[str], batch: DataFrame, number: int) -> None:
        """Members of one plan: evaluated once where several want it."""
        found: list[DataFrame] = []

        def planned() -> DataFrame:
            if not found:
                result = members[ids[0]].plan(batch)
                found.append(result.persist() if len(ids) > 1 and result is not batch else result)
            return found[0]

        try:
            for i in ids:
                self._tried(members[i], lambda i=i: members[i].sink(planned(), number))
        finally:
            if found and len(ids) > 1 and found[0] is not batch:
                found[0].unpersist()

    def _route(self, members: dict, ids: list[str], batch: DataFrame, number: int) -> None:
        """All routes in one pass; then texts go to the sinks, on the executors where these can send."""
        told = []
        for i in ids:
            self._tried(members[i], lambda i=i: told.append((i, *members[i].route())))
        hits = [F.when(condition, F.struct(F.lit(i).alias("query"), message.cast("string").alias("value"))) for i, condition, message in told]
        tagged = batch.select(F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("h")).select("h.query", "h.value").where("value is not null")
        sends = {i: members[i].sink for i, *_ in told if hasattr(members[i].sink, "send")}
        others = [i for i, *_ in told if i not in sends]
        tagged = tagged.persist() if others and len(told) > 1 else tagged
        try:
            if sends:
                self._send(members, sends, tagged, bool(others))
            for i in others:
                self._tried(members[i], lambda i=i: members[i].sink(tagged.where(F.col("query") == i).select("value"), number))
        finally:
            tagged.unpersist()

    def _send(self, members: dict, sends: dict, tagged: DataFrame, filtered: bool) -> None:
        """Texts of each partition by query; failures come back as rows, so that one sink's don't stop the others."""
        tries = self.tries

        def send(batches):
            import pyarrow as pa

            for batch in batches:
                texts: dict[str, list[str]] = {}
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    texts.setdefault(i, []).append(text)
                failed = []
                for i, mine in texts.items():
                    for left in range(tries, 0, -1):
                        try:
                            sends[i].send(iter(mine))
                            break
                        except Exception as error:  # noqa: BLE001
                            if left == 1:
                                failed.append((i, repr(error)))
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in failed], pa.string()) for k in (0, 1)], names=["query", "error"])

        rows = tagged.where(F.col("query").isin(*sends)) if filtered else tagged
        for r in rows.mapInArrow(send, "query string, error string").groupBy("query").agg(F.first("error").alias("error")).collect():  # one row a query
            members[r.query].error = RuntimeError(r.error)

    # --- looking after

    def delete(self, query_id: str) -> None:
        """Stop a query; its source stops when no other query reads it."""
        with self._lock:
            key = self._queries.pop(query_id)
            shared = self._shared[key]
            del shared.members[query_id]
            empty = not shared.members
            if empty:
                del self._shared[key]
            self._notes.delete(query_id)
        if empty:
            shared.running.stop()

    def stop(self) -> None:
        """Stop all runs; notes and checkpoints stay for `restore`."""
        with self._lock:
            shared, self._shared, self._queries = list(self._shared.values()), {}, {}
        for s in shared:
            s.running.stop()

    def queries(self) -> list[str]:
        with self._lock:
            return sorted(self._queries)

    def sources(self) -> int:
        """Running sources that queries share."""
        with self._lock:
            return len(self._shared)

    def failures(self) -> dict[str, Exception]:
        """Queries that were set aside, with their errors."""
        with self._lock:
            return {i: m.error for s in self._shared.values() for i, m in s.members.items() if m.error is not None}

    def _run(self, query_id: str) -> _Shared:
        with self._lock:
            return self._shared[self._queries[query_id]]

    def wait(self, query_id: str) -> None:
        """Until a query of bounded input has ended."""
        self._run(query_id).running.awaitTermination()

    def rates(self, query_id: str) -> tuple[float, float]:
        """(rows in, rows processed) a second of the latest micro-batch."""
        last = self._run(query_id).running.lastProgress
        return (last["inputRowsPerSecond"], last["processedRowsPerSecond"]) if last else (0.0, 0.0)

    def load(self, query_id: str, alpha: float = 0.3) -> float:
        """Rows processed a second by the query's source, averaged over its progress so far."""
        shared = self._run(query_id)
        shared.rate = shared.rate or Ewma(alpha)
        for progress in shared.running.recentProgress:
            if progress["numInputRows"]:
                shared.rate.update(progress["processedRowsPerSecond"])
        return shared.rate.value or 0.0

    def upload(self, path: str) -> None:
        """Let the executors import a Python file or archive that functions of later queries need."""
        self.spark.sparkContext.addPyFile(path)

    # --- notes

    def _note(self, query_id: str, kind: str, application: str, source_id: str | None, source, plan, sink, trigger: dict) -> None:
        try:
            code = base64.b64encode(cloudpickle.dumps((source, plan, sink))).decode()
        except Exception:  # noqa: BLE001 -- functions that hold a session or a socket can't be restored
            code = None
        self._notes.write(query_id, json.dumps({"query": query_id, "kind": kind, "application": application, "source": source_id, "trigger": trigger, "code": code}))

    def notes(self) -> list[dict]:
        """What was submitted and not deleted, here or before a restart."""
        return [json.loads(t) for t in self._notes.read()]

    def restore(self) -> list[str]:
        """Submit again all noted queries that don't run; those whose functions couldn't be noted are left out."""
        out = []
        for note in self.notes():
            if note["code"] is None or note["query"] in self.queries():
                continue
            source, plan, sink = cloudpickle.loads(base64.b64decode(note["code"]))
            trigger = dict(note["trigger"])
            if note["kind"] == "stateful":
                mode = trigger.pop("mode")
                self.submit_stateful(note["application"], source, sink, mode, note["query"], note["source"], plan, **trigger)
            else:
                submit = self.submit if note["kind"] == "plan" else self.submit_route
                submit(note["application"], note["source"], source, plan, sink, note["query"], **trigger)
            out.append(note["query"])
        return out


class Ewma:
    """Exponentially weighted moving average of a metric."""

    def __init__(self, alpha: float):
        if not 0 < alpha <= 1:
            raise ValueError("alpha must be in (0, 1]")
        self.alpha, self.value = alpha, None

    def update(self, x: float) -> float:
        self.value = x if self.value is None else self.alpha * x + (1 - self.alpha) * self.value
        return self.value
