"""Answers by a model that is called in tasks: prompts, one call for each distinct prompt, a round of repair, a record of replies.

The client is injected: a function from a prompt (a JSON list of messages) to the text of a reply, sent to the
tasks. Whatever it raised as ValueError is the reply's error. What was called is written before anything reads
it, so no reply is asked for twice by later steps; counts come from that table, not from counters that a
task run again would raise twice.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.answer import aggregate_grades, grade, reply_answers
from lodestar.operators.answer_eval import appended, replayed
from lodestar.operators.index import reply_key
from lodestar.operators.tables import stored

SHAPE = '{"answer": text, "abstained": true or false, "citations": [{"chunk_index": number of a context, "quote": text}]}'
RULES = (
    f"Answer from the numbered contexts only. Reply with one JSON object of the shape {SHAPE}, without anything around it. "
    "Quotes are copied from the context letter by letter. If the contexts hold no answer, abstain with an empty answer and no citations."
)
REPAIR = f"That was not usable. Reply once more, with one JSON object of the shape {SHAPE} and nothing else."
#: Prompts that a task holds at once.
BATCH = 64
Client = Callable[[str], str]
CHOICES = ("extractive", "model", "auto")


def chosen(choice: str, client: Client | None) -> str:
    """`extractive` or `model`: with `auto`, a model if there is a client. ValueError for a model without one."""
    if choice not in CHOICES:
        raise ValueError(f"a generator is one of {CHOICES}")
    if choice == "model" and client is None:
        raise ValueError("a model needs a client")
    return "model" if choice != "extractive" and client is not None else "extractive"


def chat_client(base_url: str, model: str, api_key: str | None = None, timeout: float = 60.0, temperature: float = 0.0, max_tokens: int = 1024) -> Client:
    """A client of a chat-completions service; ValueError for whatever goes wrong on the way."""

    def call(prompt: str) -> str:
        body = {"model": model, "messages": json.loads(prompt), "temperature": temperature, "max_tokens": max_tokens}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {api_key}"} if api_key else {})
        request = urllib.request.Request(f"{base_url.rstrip('/')}/chat/completions", json.dumps(body).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=timeout) as reply:
                content = json.loads(reply.read())["choices"][0]["message"]["content"]
        except (urllib.error.URLError, TimeoutError, json.JSONDecodeError, KeyError, IndexError, TypeError) as e:
            raise ValueError(f"the service gave no reply: {e}") from e
        if not isinstance(content, str):
            raise ValueError("the service's reply has no text")
        return content

    return call


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def prompts(items: DataFrame) -> DataFrame:
    """`items` (query_id, question, context, text: a row for each context) as (query_id, messages), contexts numbered as they are."""
    block = F.concat(F.lit("["), F.col("context").cast("string"), F.lit("] "), F.coalesce("text", F.lit("")))
    each = items.groupBy("query_id").agg(F.min("question").alias("question"), F.array_sort(F.collect_list(F.struct("context", block.alias("block")))).alias("blocks"))  # a query's k contexts
    asked = F.concat(F.lit("Contexts:\n\n"), F.array_join("blocks.block", "\n\n"), F.lit("\n\nQuestion: "), F.col("question"))
    return each.select("query_id", F.array(_message("system", F.lit(RULES)), _message("user", asked)).alias("messages"))


def called(requests: DataFrame, client: Client) -> DataFrame:
    """(key, content, error) of the distinct `requests` (key, prompt), each sent once; written before it is read."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for at in range(0, len(pdf), BATCH):
                rows = []
                for key, prompt in zip(pdf["key"][at : at + BATCH], pdf["prompt"][at : at + BATCH], strict=True):
                    try:
                        rows.append((key, client(prompt), None))
                    except ValueError as e:
                        rows.append((key, None, str(e)))
                yield pd.DataFrame(rows, columns=["key", "content", "error"], dtype=object)

    return stored(requests.select("key", "prompt").dropDuplicates(["key"]).mapInPandas(run, "key string, content string, error string"), "replies")


@dataclass
class Generated:
    """`replies` (query_id, contents, content, valid, error, n_hits, n_calls): all replies of a query, the last, and whether it can be used; `recorded` (key, model, content): what the cache lacked."""

    replies: DataFrame
    recorded: DataFrame


def generate(items: DataFrame, client: Client | None, cache: DataFrame, model: str, repairs: int = 1, replay_only: bool = False) -> Generated:
    """Replies to `items` (see `prompts`), first from `cache` (key, model, content), else from the client; unusable ones are sent back at most `repairs` times.

    With `replay_only` nothing is called, and the job fails where the cache has no reply. A query
    whose call failed has an error and is not repaired.
    """
    if repairs < 0:
        raise ValueError("repairs must not be negative")
    if client is None and not replay_only:
        raise ValueError("without a client replies can only be replayed")
    left = prompts(items)
    done, new = None, []
    for turn in range(repairs + 1):
        asked = left.withColumn("prompt", F.to_json("messages")).withColumn("key", reply_key(F.lit(model), F.col("prompt")))
        met = stored(replayed(asked, cache, replay_only), f"asked-{turn}")
        if replay_only:
            full = met.withColumn("error", F.lit(None).cast("string"))
        else:
            fresh = called(met.where("not cached"), client)
            new.append(fresh.where("content is not null").select("key", F.lit(model).alias("model"), "content"))
            own = fresh.select("key", F.col("content").alias("said"), "error")
            full = met.join(own, "key", "left").withColumn("content", F.coalesce("content", "said")).drop("said")
        judged = full.join(reply_answers(full.where("content is not null").select("query_id", "content")).select("query_id", "valid"), "query_id", "left")
        judged = stored(judged.withColumn("valid", F.coalesce("valid", F.lit(False))).withColumn("turn", F.lit(turn)), f"turn-{turn}")
        done = judged if done is None else done.unionByName(judged)
        left = judged.where("not valid and content is not null").select("query_id", F.concat("messages", F.array(_message("assistant", F.col("content")), _message("user", F.lit(REPAIR)))).alias("messages"))
        if turn < repairs and left.isEmpty():
            break
    last = F.max_by(F.struct("content", "valid", "error"), "turn").alias("last")
    replies = done.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("content").isNotNull(), F.struct("turn", "content")))), lambda x: x["content"]).alias("contents"), last,
        F.count_if("cached").alias("n_hits"), F.count_if(~F.col("cached") & F.col("content").isNotNull()).alias("n_calls"),
    )
    recorded = cache.limit(0).select("key", "model", "content")
    for part in new:
        recorded = recorded.unionByName(part)
    return Generated(replies.select("query_id", "contents", "last.content", "last.valid", "last.error", "n_hits", "n_calls"), appended(cache, recorded))


def answer_run(items: DataFrame, generated: Generated, gold: DataFrame) -> tuple[DataFrame, dict]:
    """(records, report) of a run over `items` (query_id, kind, question, context, doc_id, text), graded by code alone.

    A record has a query's replies, error and grade. The report has the grades' aggregates, how many
    replies were cached and how many called for, and how many queries failed. ValueError without items.
    """
    kinds = items.groupBy("query_id").agg(F.min("kind").alias("kind"), F.min("question").alias("question"), F.transform(F.array_sort(F.collect_list(F.struct("context", "doc_id"))), lambda x: x["doc_id"]).alias("contexts"))
    replies = kinds.join(generated.replies, "query_id", "left")
    grades = grade(replies.select("query_id", "kind", F.coalesce("content", F.lit("")).alias("content")), items.select("query_id", "context", "doc_id", "text"), gold)
    records = stored(replies.join(grades.drop("kind"), "query_id"), "records")
    totals = records.agg(F.count("*").alias("n"), F.sum("n_hits").alias("hits"), F.sum("n_calls").alias("calls"), F.count_if(F.col("error").isNotNull()).alias("failed")).first()
    if not totals["n"]:
        raise ValueError("no items")
    metrics = aggregate_grades(records.select("kind", *grades.drop("query_id", "kind").columns)).first().asDict()
    return records, {"kind": "answers", "grading": "code only: exact quotes in the contexts, relevant documents, abstention", "n_cache_hits": totals["hits"], "n_api_calls": totals["calls"], "n_failed": totals["failed"], "metrics": metrics}
