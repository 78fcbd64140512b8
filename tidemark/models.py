"""Optional models as protocols, with offline defaults that say what they are.

A model that is not installed is never imitated by constants: the defaults either compute something simpler or
return a record that is marked as a fallback.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Encoder(Protocol):
    def encode(self, texts: DataFrame, text: str) -> DataFrame:
        """Adds embedding, array<float>."""


class Reranker(Protocol):
    def __call__(self, candidates: DataFrame) -> Column:
        """A score a row, higher is better."""


class Client(Protocol):
    def __call__(self, prompt: str) -> str:
        """A model's reply. Runs on executors; it is called for each row that was routed to it, with retries."""


class HashingEncoder:
    """Hashed words with inverse document frequencies, as unit vectors: a stand-in for a sentence encoder."""

    def __init__(self, dimensions: int = 256):
        self.dimensions = dimensions

    def encode(self, texts: DataFrame, text: str) -> DataFrame:
        from pyspark.ml.feature import HashingTF, Normalizer
        from pyspark.ml.functions import vector_to_array

        words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
        rows = texts.withColumn("__w", words)
        rows = HashingTF(numFeatures=self.dimensions, inputCol="__w", outputCol="__h").transform(rows)
        rows = Normalizer(inputCol="__h", outputCol="__n").transform(rows)
        return rows.withColumn("embedding", vector_to_array("__n", "float32")).drop("__w", "__h", "__n")


REPLY = T.StructType(
    [
        T.StructField("risk_level", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("substances_detected", T.ArrayType(T.StringType())),
        T.StructField("signal_types", T.ArrayType(T.StringType())), T.StructField("evidence_spans", T.ArrayType(T.StringType())), T.StructField("reasoning", T.StringType()),
        T.StructField("analyst_summary", T.StringType()), T.StructField("requires_human_review", T.BooleanType()),
    ]
)


def _replies(prompt: Column, clients: list, *, retries: int, pause: float, good) -> Column:
    """struct(text, model) of the first client whose reply is good, each tried in its order up to retries times with
    growing pauses; nulls where none has one. Runs on executors, a batch at a time."""
    import pandas as pd

    def call(texts):
        import time

        def one(t):
            for client in clients if t is not None else ():
                for k in range(retries):
                    try:
                        reply = client(t)
                        if good(reply):
                            return reply, getattr(client, "name", getattr(client, "__name__", type(client).__name__))
                    except Exception:
                        pass  # a client that fails is tried again, and then the next one is
                    time.sleep(pause * 2**k if k + 1 < retries else 0)
            return None, None

        return pd.DataFrame([one(t) for t in texts], columns=["text", "model"], dtype=object)

    call.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(call, "text string, model string")(prompt)


def _listed(client) -> list:
    return [] if client is None else list(client) if isinstance(client, (list, tuple)) else [client]


def _is_json(reply: str | None) -> bool:
    import json
    import re

    try:
        found = json.loads(re.sub(r"^```(?:json)?\s*|\s*```$", "", (reply or "").strip()))
    except ValueError:
        return False
    return isinstance(found, dict) and found.get("risk_level") in ("low", "medium", "high")


def ask_model(posts: DataFrame, client: Client | list[Client] | None, *, text: str, retries: int = 3, pause: float = 1.5) -> DataFrame:
    """Adds reply (REPLY), method ("llm" or "fallback") and model, the name of the client that replied. Filter the rows
    first: every row costs a call.

    Of several clients the next one is asked where all tries of the one before fail or its reply is no JSON with a
    known risk level. Without a client, or where all fail, the reply asks for a human's review.
    """
    from tidemark.functions.text import json_body

    fallback = F.struct(F.lit("medium").alias("risk_level"), F.lit(0.0).alias("confidence"), *[F.array().cast("array<string>").alias(c) for c in ("substances_detected", "signal_types", "evidence_spans")], F.lit("no model").alias("reasoning"), F.lit("").alias("analyst_summary"), F.lit(True).alias("requires_human_review"))
    clients = _listed(client)
    if not clients:
        return posts.withColumns({"reply": fallback, "method": F.lit("fallback"), "model": F.lit(None).cast("string")})
    parsed = posts.withColumn("__a", _replies(F.col(text), clients, retries=retries, pause=pause, good=_is_json)).withColumn("__r", F.from_json(json_body(F.col("__a.text")), REPLY))
    ok = F.col("__r.risk_level").isin("low", "medium", "high")
    return parsed.withColumns({"reply": F.when(ok, F.col("__r")).otherwise(fallback), "method": F.when(ok, "llm").otherwise("fallback"), "model": F.when(ok, F.col("__a.model"))}).drop("__r", "__a")


def summarise(prompts: DataFrame, client: Client | list[Client] | None, *, prompt: str = "prompt", retries: int = 3, pause: float = 1.5, fallback: str = "No summary: no model replied.") -> DataFrame:
    """Adds summary, method ("llm" or "fallback") and model: what the first client with a reply that is not blank says
    of each prompt. Clients and tries go as in ask_model(); a null prompt gets the fallback."""
    clients = _listed(client)
    if not clients:
        return prompts.withColumns({"summary": F.lit(fallback), "method": F.lit("fallback"), "model": F.lit(None).cast("string")})
    asked = prompts.withColumn("__a", _replies(F.col(prompt), clients, retries=retries, pause=pause, good=lambda r: bool(r and r.strip())))
    found = F.col("__a.text").isNotNull()
    return asked.withColumns({"summary": F.when(found, F.trim("__a.text")).otherwise(fallback), "method": F.when(found, "llm").otherwise("fallback"), "model": F.col("__a.model")}).drop("__a")
