"""Calls of a language model as table operations: answered from a memo where it has them, else by a plugged-in client.

A client is a picklable object with ask(prompt: str) -> str, made on each executor by a factory, so connections and
models stay there. The default one is deterministic and needs no network.
"""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.functions import text as T
from docloom.operators.chunks import chunk
from docloom.operators.code import repair_image_links
from docloom.sources.markdown import rebuilt

TRANSLATE = "Translate this part of a Markdown file. Keep its marks, links and tables, fence its code, and answer with the translation alone:\n{content}"
HAS_CODE = "Does this text hold program code, formulas aside? Answer 1 for yes, 2 for no, and nothing else:\n{content}"


class Upper:
    """Answers with the prompt's last part in capitals."""

    def ask(self, prompt: str) -> str:
        return prompt.split(":\n", 1)[-1].upper()


def prompt_key(prompt: Column) -> Column:
    return F.sha2(prompt, 256)


def last_answers(memo: DataFrame) -> DataFrame:
    """agent, prompt_sha, response: the last answer to each prompt. memo: agent, prompt, response, seq."""
    best = F.max(F.struct("seq", "response")).alias("best")
    return memo.groupBy("agent", prompt_key(F.col("prompt")).alias("prompt_sha")).agg(best).select("agent", "prompt_sha", F.col("best.response").alias("response"))


def with_memo(calls: DataFrame, memo: DataFrame) -> DataFrame:
    """calls (agent, prompt, ...) with response and hit."""
    known = last_answers(memo).withColumn("hit", F.lit(True))
    out = calls.withColumn("prompt_sha", prompt_key(F.col("prompt"))).join(known, ["agent", "prompt_sha"], "left")
    return out.withColumn("hit", F.coalesce("hit", F.lit(False))).drop("prompt_sha")


def misses(calls: DataFrame, memo: DataFrame) -> DataFrame:
    """Left anti join: calls without an answer."""
    known = last_answers(memo).select("agent", "prompt_sha")
    return calls.withColumn("prompt_sha", prompt_key(F.col("prompt"))).join(known, ["agent", "prompt_sha"], "left_anti").drop("prompt_sha")


def append(memo_rows: DataFrame, path: str) -> None:
    """Adds answers to a memo kept as Parquet; later ones win."""
    memo_rows.select("agent", "prompt", "response", "seq").write.mode("append").parquet(path)


def compacted(memo: DataFrame) -> DataFrame:
    """One row a prompt, the last one."""
    best = F.max(F.struct("seq", "response")).alias("best")
    return memo.groupBy("agent", "prompt").agg(best).select("agent", "prompt", F.col("best.response").alias("response"), F.col("best.seq").alias("seq"))


def dealt(calls: DataFrame, agents: tuple[str, ...], order: str = "chunk_no", group: str = "doc_id") -> DataFrame:
    """calls with agent, in turn within each group."""
    n = F.row_number().over(W.partitionBy(group).orderBy(order)) - 1
    return calls.withColumn("agent", F.get(F.array(*[F.lit(a) for a in agents]), (n % len(agents)).cast("int")))


class _Call(threading.Thread):
    """One call on a thread of its own, which nobody waits for beyond its time."""

    def __init__(self, ask: Callable[[str], str | None], prompt: str):
        super().__init__(daemon=True)
        self.ask, self.prompt, self.began = ask, prompt, time.monotonic()
        self.result: tuple[str | None, str] = (None, "timeout")
        self.start()

    def run(self) -> None:
        try:
            said = self.ask(self.prompt)
            self.result = (said, "failed" if said is None else "ok")
        except Exception:
            self.result = (None, "failed")

    def finished(self, timeout: float | None) -> tuple[str | None, str]:
        self.join(None if timeout is None else max(0.0, self.began + timeout - time.monotonic()))
        return self.result


def in_order(ask: Callable[[str], str | None], prompts: list[str], workers: int, timeout: float | None) -> list[tuple[str | None, str]]:
    """(answer, status) of each prompt; up to workers calls at once, and each at most timeout seconds."""
    running: deque[_Call] = deque()
    done = []
    for prompt in prompts:
        if len(running) >= max(1, workers):
            done.append(running.popleft().finished(timeout))
        running.append(_Call(ask, prompt))
    return done + [call.finished(timeout) for call in running]


def asked(calls: DataFrame, factory: Callable[[], object] = Upper, workers: int = 4, timeout: float | None = 120.0) -> DataFrame:
    """calls (prompt, ...) with response and status (ok, failed, timeout); a call that doesn't succeed has no response.
    A call that hangs costs its time, not its task; clients should end it by a time limit of their own."""
    schema = StructType(list(calls.schema.fields)).add("response", "string").add("status", "string")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for frame in frames:
            rows = in_order(client.ask, frame["prompt"].tolist(), workers, timeout)
            yield frame.assign(response=[r for r, _ in rows], status=[s for _, s in rows])

    return calls.mapInPandas(run, schema)


class Agents:
    """Makes one client of each name, when it is first asked for; picklable, so executors make their own."""

    def __init__(self, factories: dict[str, Callable[[], object]]):
        self.factories = factories
        self.made: dict[str, object] = {}

    def __getstate__(self) -> dict:
        return {"factories": self.factories, "made": {}}

    def __getitem__(self, name: str) -> object:
        if name not in self.made:
            self.made[name] = self.factories[name]()
        return self.made[name]


def asked_by_agent(calls: DataFrame, agents: Agents, workers: int = 4, timeout: float | None = 120.0) -> DataFrame:
    """As asked(), each call by the client that its column agent names; an agent that doesn't exist fails."""
    schema = StructType(list(calls.schema.fields)).add("response", "string").add("status", "string")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: dict = {}
            for name, own in frame.groupby("agent", sort=True, dropna=False):
                known = name in agents.factories
                answers = in_order(agents[name].ask, own["prompt"].tolist(), workers, timeout) if known else [(None, "failed")] * len(own)
                rows |= dict(zip(own.index, answers))
            yield frame.assign(response=[rows[k][0] for k in frame.index], status=[rows[k][1] for k in frame.index])

    return calls.mapInPandas(run, schema)


def answer_or_source(source: Column, response: Column) -> Column:
    """A chunk's translation: the answer between the source's outer blanks, with its image links where their number
    agrees; the source itself where there is no answer. An empty answer is an empty chunk."""
    fixed = repair_image_links(source, response)
    return F.when(response.isNull(), source).when(response == "", F.lit("")).otherwise(T.keep_edges(source, fixed))


def translated(documents: DataFrame, factory: Callable[[], object] = Upper, agents: tuple[str, ...] = ("a",), memo: DataFrame | None = None, size: int = 2048, title: int = 200) -> DataFrame:
    """doc_id, text: chunks translated apart and joined by line feeds in order."""
    calls = dealt(chunk(documents, size, title), agents).withColumn("prompt", T.filled(TRANSLATE, content=F.col("text")))
    if memo is None:
        done = asked(calls, factory)
    else:
        both = with_memo(calls, memo)
        hits = both.filter("hit").drop("hit").withColumn("status", F.lit("ok"))
        done = hits.unionByName(asked(both.filter(~F.col("hit")).drop("hit", "response"), factory))
    done = done.withColumn("text", answer_or_source(F.col("text"), F.col("response")))
    return rebuilt(done.select("doc_id", "chunk_no", "text"), "\n", "chunk_no", "text")


def has_code(texts: DataFrame, factory: Callable[[], object] = Upper) -> DataFrame:
    """texts (text, ...) with has_code; failures count as no."""
    out = asked(texts.withColumn("prompt", T.filled(HAS_CODE, content=F.col("text"))), factory)
    return out.withColumn("has_code", T.is_yes(F.col("response"))).drop("prompt", "response", "status")


def unfinished(inputs: DataFrame, outputs: DataFrame, key: str = "doc_id") -> DataFrame:
    """What a repeated run still has to do: inputs without an output."""
    return inputs.join(outputs.select(key).distinct(), key, "left_anti")
