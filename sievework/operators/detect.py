"""The detector: a map over chunks with a pluggable client, retries and token accounts."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Signals of a latent rule in source text, with the kind they point to.
SIGNALS = (
    ("temporal_ordering", r"(?i)\b(?:must|should) be called (?:before|after)|until \w+ has run"),
    ("resource_lifecycle", r"\bimpl(?:<[^>]*>)? Drop for|mem::forget|ManuallyDrop"),
    ("state_machine", r"self\.state = |State::"),
    ("precondition", r"(?i)debug_assert!|assert!\(|# Safety|\bmust hold\b"),
    ("protocol", r"\bunsafe (?:fn|impl|\{)|PhantomData"),
)


class Client(Protocol):
    """Answers one prompt; raises with a message that tells whether to retry."""

    def complete(self, prompt: str) -> tuple[str, int]: ...


def signals(chunks: DataFrame) -> DataFrame:
    """(crate_name, chunk_id, kind, hits): the offline detector, within Spark's regular expressions."""
    raw = F.coalesce("raw_source", F.lit(""))
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.size(F.regexp_extract_all(raw, F.lit(rx), F.lit(0))).alias("hits")) for k, rx in SIGNALS])
    return chunks.select("crate_name", "chunk_id", F.explode(found).alias("s")).select("crate_name", "chunk_id", "s.kind", F.col("s.hits").cast("bigint").alias("hits")).where("hits > 0")


def answered(prompts: DataFrame, make_client: Callable[[], Client], at_once: int, tries: int = 3, pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """(prompt_id, reply, tokens, error): each prompt's answer, ``at_once`` tasks at a time.

    A failed call is tried again while its message calls for it; the pause grows with the calls
    that failed in a row within the task. What fails for good is a row with an error.
    """
    from ..functions.classify import RETRYABLE
    import re

    again = re.compile(RETRYABLE)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, in_a_row = make_client(), 0
        for b in batches:
            out = []
            for pid, prompt in zip(b["prompt_id"], b["prompt"]):
                reply, tokens, error = None, 0, None
                for attempt in range(tries):
                    try:
                        reply, tokens = client.complete(prompt)
                        error, in_a_row = None, 0
                        break
                    except Exception as e:  # noqa: BLE001
                        error, in_a_row = str(e), in_a_row + 1
                        if not again.search(error.lower()) or attempt + 1 == tries:
                            break
                        pause(min(300.0, 2**attempt * (1 + min(in_a_row, 5))))
                out.append((pid, reply, tokens, error))
            yield pd.DataFrame(out, columns=["prompt_id", "reply", "tokens", "error"])

    return prompts.select("prompt_id", "prompt").repartition(at_once).mapInPandas(run, "prompt_id string, reply string, tokens long, error string")


def replayed(prompts: DataFrame, replies: DataFrame) -> DataFrame:
    """Answers looked up by the prompt's hash in a table (prompt_hash, reply, tokens), for runs that are repeated without a network."""
    return prompts.withColumn("prompt_hash", F.sha2("prompt", 256)).join(replies, "prompt_hash", "left").select("prompt_id", "reply", "tokens", F.when(F.col("reply").isNull(), "no such reply").alias("error"))
