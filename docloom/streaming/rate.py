"""Sliding-window rate control of requests by agent: offered load as a window, admission as state.

A request is admitted if the window of admitted ones before it is empty, or if its tokens and one more request fit in.
A record leaves the window when its age in whole seconds exceeds the gap, so it counts for just under gap + 1 seconds.
Rejected requests leave no record. Both limits 0: no control.
"""

from __future__ import annotations

import heapq
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RPM, TPM, GAP = 1000, 40_000, 60
WAIT, RETRIES = 20, 20
SECOND = 1_000_000


def offered_load(requests: DataFrame, gap: int = GAP) -> DataFrame:
    """requests (agent, us, tokens, ...) with n_window and tokens_window over the gap up to each request, itself and all
    of its time included. us: microseconds since the epoch."""
    wide = (gap + 1) * SECOND
    # stretches of time are windows of their own, each with the rows of the one before it beside its own
    stretch = F.floor(F.col("us") / wide)
    rows = requests.withColumn("__of", stretch).withColumn("__in", F.explode(F.array(stretch, stretch + 1)))
    frame = W.partitionBy("agent", "__in").orderBy("us").rangeBetween(-(wide - 1), 0)
    rows = rows.withColumn("n_window", F.count("*").over(frame)).withColumn("tokens_window", F.sum("tokens").over(frame))
    return rows.filter("__of = __in").drop("__of", "__in")


class Window:
    """Admitted requests of one agent."""

    def __init__(self, rpm: int = RPM, tpm: int = TPM, gap: int = GAP, records: list[tuple[int, int]] = ()):
        self.rpm, self.tpm, self.gap = rpm, tpm, gap
        self.records = deque(records)
        self.tokens = sum(n for _, n in self.records)

    def admit(self, us: int, tokens: int) -> bool:
        if not self.rpm and not self.tpm:
            return True
        if self.records:
            while self.records and (us - self.records[0][0]) // SECOND > self.gap:
                self.tokens -= self.records.popleft()[1]
            if self.tokens + tokens > self.tpm or len(self.records) + 1 > self.rpm:
                return False
        self.records.append((us, tokens))
        self.tokens += tokens
        return True

    def admit_with_retry(self, us: int, tokens: int, wait: int = WAIT, retries: int = RETRIES) -> tuple[bool, int, int]:
        """(admitted, attempts, time of the last one): tried again every wait seconds, nothing else coming between."""
        for attempt in range(retries + 1):
            at = us + attempt * wait * SECOND
            if self.admit(at, tokens):
                return True, attempt + 1, at
        return False, retries + 1, at

    def fill(self, us: int) -> None:
        """As if all tokens had just been used: what a provider's refusal is answered with."""
        self.records, self.tokens = deque([(us, self.tpm)]), self.tpm


class Refused(Exception):
    """A provider's answer to too many requests."""


class Limited:
    """A client that asks another one within the limits of a window.

    Prompts of the memo are answered from it and cost nothing. Others wait until they are admitted, tried again every
    wait seconds, at most retries times; then there is no answer. With penalty on, a refusal by the provider fills the
    window, and the prompt waits once more. Clock and sleep are parameters for tests; a lock keeps threads apart."""

    def __init__(self, client, tokens_of: Callable[[str], int] = lambda prompt: len(prompt.split()), rpm: int = RPM, tpm: int = TPM, gap: int = GAP, wait: float = WAIT, retries: int = RETRIES, penalty: bool = False, memo: dict[str, str] | None = None, clock=time.time, sleep=time.sleep):
        self.client, self.tokens_of, self.wait, self.retries, self.penalty = client, tokens_of, wait, retries, penalty
        self.window, self.memo, self.clock, self.sleep, self.lock = Window(rpm, tpm, gap), memo or {}, clock, sleep, threading.Lock()

    def _now(self) -> int:
        return int(self.clock() * SECOND)

    def admitted(self, tokens: int) -> bool:
        for attempt in range(self.retries + 1):
            with self.lock:
                if self.window.admit(self._now(), tokens):
                    return True
            if attempt < self.retries:
                self.sleep(self.wait)
        return False

    def ask(self, prompt: str) -> str | None:
        if prompt in self.memo:
            return self.memo[prompt]
        tokens = self.tokens_of(prompt)
        if not self.admitted(tokens):
            return None
        try:
            return self.client.ask(prompt)
        except Refused:
            if not self.penalty:
                raise
        with self.lock:
            self.window.fill(self._now())
        return self.client.ask(prompt) if self.admitted(tokens) else None


class Turns:
    """Requests of one agent that come in order of time, tried again among the later ones until they are settled."""

    def __init__(self, window: Window, wait: int, retries: int):
        self.window, self.wait, self.retries = window, wait, retries
        self.pending: list[tuple[int, int, int, int, int]] = []  # at, request, attempt, us, tokens

    def until(self, us: float) -> Iterator[tuple[int, int, int, bool, int, int]]:
        """(request, us, tokens, admitted, attempts, at) of what is settled by then."""
        while self.pending and self.pending[0][0] <= us:
            at, request, attempt, since, tokens = heapq.heappop(self.pending)
            admitted = self.window.admit(at, tokens)
            if admitted or attempt > self.retries:
                yield request, since, tokens, admitted, attempt, at
            else:
                heapq.heappush(self.pending, (at + self.wait * SECOND, request, attempt + 1, since, tokens))

    def add(self, request: int, us: int, tokens: int) -> None:
        heapq.heappush(self.pending, (us, request, 1, us, tokens))


def _by_agent(requests: DataFrame) -> DataFrame:
    """Agents dealt to tasks, each one's rows in order of time and id."""
    flat = requests.select(*[F.col(c).cast("long").alias(c) for c in ("agent", "request_id", "us", "tokens")])
    return flat.repartition("agent").sortWithinPartitions("agent", "us", "request_id")


def retried(requests: DataFrame, rpm: int = RPM, tpm: int = TPM, gap: int = GAP, wait: int = WAIT, retries: int = RETRIES) -> DataFrame:
    """agent, request_id, us, tokens, admitted, attempts, at: as admissions(), but a request that isn't admitted tries
    again every wait seconds, at most retries times, among the later ones; at: the time of its last attempt. Of an agent
    only the window and what still waits are held."""
    names = ["request_id", "us", "tokens", "admitted", "attempts", "at"]

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        agent, turns = None, None
        for frame in frames:
            rows: list[tuple] = []
            for a, r, u, n in frame[["agent", "request_id", "us", "tokens"]].itertuples(index=False):
                if turns is None or a != agent:
                    if turns is not None:
                        rows += [(agent, *x) for x in turns.until(float("inf"))]
                    agent, turns = a, Turns(Window(rpm, tpm, gap), wait, retries)
                rows += [(agent, *x) for x in turns.until(u - 1)]
                turns.add(r, u, n)
            yield pd.DataFrame(rows, columns=["agent", *names])
        if turns is not None:
            yield pd.DataFrame([(agent, *x) for x in turns.until(float("inf"))], columns=["agent", *names])

    return _by_agent(requests).mapInPandas(fold, "agent long, request_id long, us long, tokens long, admitted boolean, attempts int, at long")


def admissions(requests: DataFrame, rpm: int = RPM, tpm: int = TPM, gap: int = GAP) -> DataFrame:
    """agent, request_id, us, tokens, admitted: each agent's requests in order of time and id.

    Agents are dealt to tasks, whose rows are sorted and read in batches; at most rpm records are held of an agent, so
    its whole history never is."""
    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        agent, window = None, None
        for frame in frames:
            admitted = []
            for a, u, n in zip(frame["agent"].tolist(), frame["us"].tolist(), frame["tokens"].tolist()):
                if window is None or a != agent:
                    agent, window = a, Window(rpm, tpm, gap)
                admitted.append(window.admit(u, n))
            yield frame.assign(admitted=admitted)

    return _by_agent(requests).mapInPandas(fold, "agent long, request_id long, us long, tokens long, admitted boolean")


def admissions_stream(requests: DataFrame, rpm: int = RPM, tpm: int = TPM, gap: int = GAP) -> DataFrame:
    """The same over a stream: the window's records, at most rpm of them, are the agent's state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, sizes = state.get if state.exists else ([], [])
        window = Window(rpm, tpm, gap, list(zip(times, sizes)))
        rows = pd.concat(frames).sort_values(["us", "request_id"])
        yield rows.assign(admitted=[window.admit(u, n) for u, n in zip(rows["us"].tolist(), rows["tokens"].tolist())])
        state.update(([u for u, _ in window.records], [n for _, n in window.records]))

    flat = requests.select(*[F.col(c).cast("long").alias(c) for c in ("agent", "request_id", "us", "tokens")])
    return flat.groupBy("agent").applyInPandasWithState(
        fold, "agent long, request_id long, us long, tokens long, admitted boolean", "times array<long>, sizes array<long>", "append", GroupStateTimeout.NoTimeout
    )


def answered_stream(calls: DataFrame, memo_path: str, checkpoint: str, ask) -> object:
    """Runs a stream of calls (agent, prompt, seq): each batch is looked up in the memo at memo_path, asked(missing)
    answers the rest, and the new answers are appended. Returns the query."""
    from docloom.operators import calls as C

    columns = "agent string, prompt string, response string, seq long"

    def batch(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(memo_path)
        there = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)
        memo = spark.read.schema(columns).parquet(memo_path) if there else spark.createDataFrame([], columns)
        new = ask(C.misses(rows, memo).dropDuplicates(["agent", "prompt"]))
        C.append(new.filter("status = 'ok'"), memo_path)

    return calls.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
