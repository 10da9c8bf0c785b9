"""Pluggable translation: a protocol, the built-in mock, retries, spacing of calls, and reuse before any call."""

from __future__ import annotations

import time
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aligna import constants as K
from aligna.operators import memory as tm


class Translator(Protocol):
    """translate() gets a unit's text, its terms and its neighbours' texts; name() goes into logs."""

    def translate(self, text: str, terms: list[tuple[str, str]], before: str | None, after: str | None) -> str: ...

    def name(self) -> str: ...


class Mock:
    def translate(self, text, terms=(), before=None, after=None):
        return "[EN] " + text

    def name(self):
        return "mock"


class Chat:
    """A chat-completion service behind send(messages) -> text; an empty answer is an error."""

    def __init__(self, send, model: str = "default", temperature: float = 0.3, top_p: float = 0.9, timeout: float = 120.0):
        self.send, self.model, self.temperature, self.top_p, self.timeout = send, model, temperature, top_p, timeout

    def messages(self, text, terms=(), before=None, after=None) -> list[dict]:
        parts = ["Translate the text between the lines into technical English. Answer with the translation alone; keep numbers and units as they are."]
        if terms:
            parts.append("Use these terms: " + "; ".join(f"{a} = {b}" for a, b in terms))
        around = [f"{label}: {t}" for label, t in (("Before", before), ("After", after)) if t]
        return [{"role": "system", "content": "\n".join(parts)}, {"role": "user", "content": "\n".join([*around, "---", text, "---"])}]

    def translate(self, text, terms=(), before=None, after=None):
        answer = (self.send(self.messages(text, terms, before, after), model=self.model, temperature=self.temperature, top_p=self.top_p, timeout=self.timeout) or "").strip()
        if not answer:
            raise ValueError("empty translation")
        return answer

    def name(self):
        return f"chat:{self.model}"


REGISTRY = {"mock": Mock}


def make(name: str, **options) -> Translator:
    if name not in REGISTRY:
        raise ValueError(f"unknown translator: {name}")
    return REGISTRY[name](**options)


def mock_column(source: Column) -> Column:
    """The mock as a column, without Python."""
    return F.concat(F.lit("[EN] "), source)


def prompt(source: Column, terms: Column, before: Column, after: Column) -> Column:
    """The user message as a column: neighbours and terms where there are any, then the text."""
    lines = F.array_join(F.transform(terms, lambda t: F.concat(t["source_term"], F.lit(" = "), t["target_term"])), "; ")
    return F.concat_ws("\n", F.when(F.size(terms) > 0, F.concat(F.lit("Use these terms: "), lines)), F.when(before.isNotNull(), F.concat(F.lit("Before: "), before)), F.when(after.isNotNull(), F.concat(F.lit("After: "), after)), F.lit("---"), source, F.lit("---"))


def call(units: DataFrame, translator: Translator, rounds: int = K.RETRY_ROUNDS, spacing: float = 0.0, sleep=time.sleep, terms: list[tuple[str, str]] = (), partitions: int | None = None) -> DataFrame:
    """units with translated_text and error. Failed units are tried again in `rounds` rounds after 2, 4, 8 .. s.

    One translator for each task; calls of a task are `spacing` seconds apart, so partitions bounds the call rate.
    The whole term list is passed where the unit's term_hits aren't empty.
    """
    frame = units.drop("translated_text", "error")
    frame = frame.repartition(partitions) if partitions else frame
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields) + ", translated_text string, error string"

    def run(batches):
        last = 0.0

        def once(row):
            nonlocal last
            wait = last + spacing - time.monotonic()
            if wait > 0:
                sleep(wait)
            hits = row.get("term_hits")
            try:
                out = translator.translate(row["source_text"], list(terms) if hits is not None and len(hits) else [], row.get("context_before"), row.get("context_after"))
                last = time.monotonic()
                return out, None
            except Exception as e:  # a unit's failure is data: it goes into its error column
                return None, str(e) or type(e).__name__

        for pdf in batches:
            rows = pdf.to_dict("records")
            done = [once(r) for r in rows]
            for k in range(1, rounds + 1):
                failed = [i for i, (_, e) in enumerate(done) if e is not None]
                if not failed:
                    break
                sleep(min(2**k, K.RETRY_MOST_SECONDS))
                for i in failed:
                    done[i] = once(rows[i])
            yield pdf.assign(translated_text=pd.Series([t for t, _ in done], dtype="object", index=pdf.index), error=pd.Series([e for _, e in done], dtype="object", index=pdf.index))

    return frame.mapInPandas(run, kinds)


def with_memory(units: DataFrame, memory: DataFrame, translated) -> DataFrame:
    """units with translated_text, tm_hit and tm_match_type: the memory's target, else translated(column of source)."""
    out = tm.exact(units, memory)
    return out.withColumn("translated_text", F.when(F.col("tm_hit"), F.col("tm_target")).otherwise(translated(F.col("source_text")))).withColumn("tm_match_type", F.when(F.col("tm_hit"), F.lit("exact"))).drop("tm_target", "tm_ord")


def distinct_call(units: DataFrame, translator: Translator, key: str = "source_text", **options) -> DataFrame:
    """Each distinct source text is translated once and joined back."""
    one = call(units.select(key).distinct(), translator, **options)
    return units.drop("translated_text", "error").join(one, key, "left")
