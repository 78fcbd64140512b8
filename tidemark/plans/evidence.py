"""Evidence for spikes: retrieve, re-rank, describe, and summarise with a model if there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark import models
from tidemark.operators import decide, knn


def spike_evidence(posts: DataFrame, windows: DataFrame, queries: DataFrame, *, time: str, id_col: str, vector: str, text: str, substance: str, risk: str, retrieve: int = 30, keep: int = 10, least: int = 3, scorer=None, client=None) -> dict[str, DataFrame]:
    """For windows (start, end) and their query vectors (start, query_vector): the tables candidates, evidence,
    summaries, prompts (with the models' structured reply) and notes (with their summary in words). client is a model
    or a list of them, asked in turn. All spikes go through one plan; none is looped over on the driver."""
    inside = decide.posts_in_windows(posts, windows, time=time)
    found = knn.neighbours_in_groups(inside, queries, keys=["start"], id_col=id_col, vector=vector, k=retrieve)
    ranked = knn.rerank(found, scorer, keys=["start"], id_col=id_col, k=keep)
    evidence = decide.evidence_records(ranked, keys=["start"], id_col=id_col, text=text, risk=risk, least=least)
    summaries = decide.retrieval_query(decide.spike_summaries(inside, keys=["start"], substance=substance, risk=risk), substance=substance, risk="inferred_risk")
    prompts = decide.spike_prompts(ranked, keys=["start"], text=text)
    return {"candidates": ranked, "evidence": evidence, "summaries": summaries, "prompts": models.ask_model(prompts, client, text="prompt"), "notes": models.summarise(prompts, client)}
