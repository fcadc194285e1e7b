"""The place of a language model: a protocol, a deterministic stand-in, and batched calls in tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Backend(Protocol):
    """Answers for a batch of prompts; must be picklable, as it runs in tasks."""

    name: str

    def complete(self, prompts: list[str]) -> list[dict | None]: ...


class KeywordBackend:
    """Stand-in for tests: the first keyword in the prompt decides."""

    name = "keyword"

    def __init__(self, answers: dict[str, dict]):
        self.answers = answers

    def complete(self, prompts: list[str]) -> list[dict | None]:
        return [next((a for k, a in self.answers.items() if k in p.lower()), None) for p in prompts]


def complete_with_fallback(backends: list[Backend], prompts: list[str]) -> list[tuple[dict | None, str]]:
    """Each prompt's answer and who gave it; a backend that fails or has none leaves the prompt to the next, the last is quarantine."""
    out: list[tuple[dict | None, str]] = [(None, "quarantine")] * len(prompts)
    todo = list(range(len(prompts)))
    for b in backends:
        if not todo:
            break
        try:
            got = b.complete([prompts[i] for i in todo])
        except Exception:  # a backend is an outside service: any failure of it moves on to the next
            continue
        for i, a in zip(todo, got):
            if a is not None:
                out[i] = (a, b.name)
        todo = [i for i in todo if out[i][0] is None]
    return out


def ask(rows: DataFrame, prompt: Column, backends: list[Backend], fields: list[str], batch: int = 20) -> DataFrame:
    """rows' distinct prompts with the answers' fields and ``backend``, in batches. Prompts are made distinct before any call."""
    distinct = rows.select(prompt.alias("prompt")).where("prompt is not null").distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), batch):
                ps = f["prompt"].iloc[i : i + batch].tolist()
                got = complete_with_fallback(backends, ps)
                yield pd.DataFrame([(p, *[(a or {}).get(k) for k in fields], who) for p, (a, who) in zip(ps, got)], columns=["prompt", *fields, "backend"])

    return distinct.mapInPandas(run, ", ".join(f"{c} string" for c in ["prompt", *fields, "backend"]))


def checked(answers: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Answers repaired against the taxonomy: a known pair stays, a known subcategory gives its category, all else is null and low."""
    pairs = taxonomy.select("category", "subcategory").distinct().withColumn("ok", F.lit(True))
    parent = taxonomy.groupBy("subcategory").agg(F.min("category").alias("parent"))
    out = answers.join(pairs, ["category", "subcategory"], "left").join(parent, "subcategory", "left")
    known = F.col("ok").isNotNull() | F.col("parent").isNotNull()
    return out.select(
        "prompt", F.when(F.col("ok"), F.col("category")).otherwise(F.col("parent")).alias("category"), F.when(known, F.col("subcategory")).alias("subcategory"),
        F.when(F.col("ok"), "medium").otherwise("low").alias("category_confidence"), "backend",
    )


def usable_description(cleaned: Column, original: Column) -> Column:
    """A cleaned description that says something: not null-like, two letters or more, not unchanged."""
    t = F.trim(cleaned)
    return F.when((F.length(t) >= 2) & ~F.lower(t).isin("null", "none", "nan", "n/a") & (t != original), t)


Prompt = Callable[[DataFrame], Column]
