"""Extractors: anything that finds fields in a case's free text.

An extractor takes rows (id, class, text) and a vocabulary and returns the id with one column per field,
null where the text tells nothing.  ``Clauses`` looks for the vocabulary's own phrases; ``Hosted`` asks
a service, trusts nothing that it answers, and limits how many ask at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fslink.operators.normalise import DERIVED, NONE_OBSERVED, Vocabulary, extracted, validated


class Extractor(Protocol):
    def __call__(self, rows: DataFrame, vocabulary: Vocabulary, id: str, cls: str, text: str) -> DataFrame: ...


def fields_of(vocabulary: Vocabulary) -> list[str]:
    return [f for f in vocabulary.every if f != DERIVED]


@dataclass
class Clauses:
    """The vocabulary's phrases, found in the lower-cased text."""

    def __call__(self, rows: DataFrame, vocabulary: Vocabulary, id: str = "case_id", cls: str = "crime_type", text: str = "narrative_text") -> DataFrame:
        return rows.select(id, *(extracted(F.col(text), f, vocabulary).alias(f) for f in fields_of(vocabulary)))


def question(text: str, cls: str, vocabulary: Vocabulary) -> str:
    """What a service is asked about one text: the fields of its class with their allowed values."""
    family = vocabulary.family_of.get(cls, cls)
    mine = [f for f in fields_of(vocabulary) if (families := vocabulary.families_with(f)) is None or family in families]
    allowed = {f: sorted(v for v in vocabulary.fields.get(f, {}) if v != NONE_OBSERVED) for f in mine}
    return "\n".join((
        "Answer with one JSON object only: each field below with one of its allowed values, or null where the text gives no evidence.",
        f"These fields take a list of values: {sorted(vocabulary.tags & set(mine))}.",
        f"Allowed values: {json.dumps(allowed)}",
        f"Text:\n{text}",
    ))


@dataclass
class Hosted:
    """A service that answers a question with JSON.  A reply that isn't an object is asked for once
    more, then taken as empty; values outside the vocabulary are dropped, a list with one of them
    whole.  At most ``at_once`` tasks ask at a time."""

    ask: Callable[[str], str]
    at_once: int = 5

    def __call__(self, rows: DataFrame, vocabulary: Vocabulary, id: str = "case_id", cls: str = "crime_type", text: str = "narrative_text") -> DataFrame:
        ask = self.ask

        def answer(told: str) -> str:
            for _ in range(2):
                reply = ask(told)
                try:
                    if isinstance(json.loads(reply), dict):
                        return reply
                except (TypeError, ValueError):
                    continue
            return "{}"

        def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                replies = [answer(question(t or "", c or "", vocabulary)) for t, c in zip(frame[text], frame[cls])]
                yield pd.DataFrame({id: frame[id].to_numpy(), "reply": replies})

        asked = rows.select(id, cls, text)
        found = asked.repartition(self.at_once).mapInPandas(run, f"{id} {dict(asked.dtypes)[id]}, reply string")
        return found.select(id, *(validated(F.col("reply"), f, vocabulary).alias(f) for f in fields_of(vocabulary)))


def enriched(cases: DataFrame, found: DataFrame, vocabulary: Vocabulary, id: str = "case_id") -> DataFrame:
    """The cases with what an extractor found in the fields that have no value; their status is
    cleared and their provenance says so.  Recorded values stay."""
    names = [f for f in fields_of(vocabulary) if f in found.columns]
    fresh = found.select(id, *(F.col(f).alias(f"new_{f}") for f in names))
    joined = cases.join(fresh, id, "left")
    taken = lambda f: F.col(f).isNull() & F.col(f"new_{f}").isNotNull()
    fresh_here = F.array_compact(F.array(*(F.when(taken(f), F.lit(f)) for f in names)).cast("array<string>"))
    joined = joined.withColumn("_taken", fresh_here)
    said = F.transform_values("field_provenance", lambda k, v: F.when(F.array_contains("_taken", k), "llm_extracted").otherwise(v))
    columns = []
    for c in cases.columns:
        base = c.removesuffix("__status")
        if c in names:
            columns.append(F.coalesce(c, f"new_{c}").alias(c))
        elif c.endswith("__status") and base in names:
            columns.append(F.when(taken(base), None).otherwise(F.col(c)).alias(c))
        elif c == "field_provenance" and names:
            columns.append(said.alias(c))
        else:
            columns.append(F.col(c))
    return joined.select(*columns)
