"""Translation memory: exact and similar lookup, growth, counters."""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aligna import constants as K
from aligna.functions import similar
from aligna.functions.text import strip

#: Characters of the entries, or of the units, of one task of the similar lookup, about.
CHARS = 16_000_000
#: Units of a task compared at once.
ASKED = 4000


def last_wins(memory: DataFrame) -> DataFrame:
    """One entry for each source text: the last by ord."""
    return memory.groupBy("source_text").agg(F.max_by("target_text", "ord").alias("target_text"), F.max("ord").alias("ord"))


def exact(units: DataFrame, memory: DataFrame) -> DataFrame:
    """units with tm_target, tm_ord and tm_hit, by equal source text, unstripped. An equi join; Spark picks its kind."""
    m = last_wins(memory).select("source_text", F.col("target_text").alias("tm_target"), F.col("ord").alias("tm_ord"))
    return units.join(m, "source_text", "left").withColumn("tm_hit", F.col("tm_ord").isNotNull())


def self_reuse(units: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, source_text, first): the first unit, in order of keys, with the same source text. Sums, no window, so a
    text that fills a third of the corpus meets in no task."""
    first = units.groupBy("source_text").agg(F.min(F.struct(*keys)).alias("first"), F.count("*").alias("uses"))
    return units.select(*keys, "source_text").join(first, "source_text")


def hit_counts(units: DataFrame, memory: DataFrame) -> DataFrame:
    """Entries of the memory with how many units they serve."""
    hits = exact(units, memory).where("tm_hit").groupBy(F.col("tm_ord").alias("ord")).agg(F.count("*").alias("hits"))
    return memory.join(hits, "ord", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))


def insert_new(memory: DataFrame, fresh: DataFrame) -> DataFrame:
    """Entries of fresh (source_text, target_text, ord) whose source the memory lacks; the least ord of each."""
    new = fresh.groupBy("source_text").agg(F.min_by("target_text", "ord").alias("target_text"), F.min("ord").alias("ord"))
    return new.join(memory.select("source_text"), "source_text", "left_anti")


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def best(queries: list[str], texts: list[str], ords: np.ndarray, threshold: float, other: bool = False) -> list[tuple[float, int]]:
    """(similarity, place) of the most similar text for each query, the least ord winning ties; place -1: none.

    Only pairs that the exact bounds of `functions.similar` let through are compared, those with the longest common
    subsequence (of which matched blocks are one) first, as far as it allows the threshold and the best so far.
    other: a text equal to the query is passed over.
    """
    top = [(0.0, -1)] * len(queries)
    if not queries or not texts:
        return top
    y = similar.Texts(texts)
    size = sorted(range(len(queries)), key=lambda i: len(queries[i]))
    for s in range(0, len(size), ASKED):
        part = size[s : s + ASKED]
        for i, found in zip(part, _best([queries[i] for i in part], y, ords, threshold, other), strict=True):
            top[i] = found
    return top


def _best(queries: list[str], y: similar.Texts, ords: np.ndarray, threshold: float, other: bool) -> list[tuple[float, int]]:
    """As best, for units that are compared at once."""
    top, texts = [(0.0, -1)] * len(queries), y.texts
    x = similar.Texts(queries, y.letters)
    who, which, common = similar.candidates(x, y, threshold)
    ends = np.searchsorted(who, np.arange(len(queries) + 1))
    for i, q in enumerate(queries):
        k = which[ends[i] : ends[i + 1]]
        bound = 2.0 * common[ends[i] : ends[i + 1]] / (y.n[k] + len(q))
        r, at = 0.0, -1
        for j in np.lexsort((ords[k], -bound)).tolist():
            n = int(k[j])
            if bound[j] < max(threshold, r):
                break
            if (bound[j] == r and ords[n] > ords[at]) or (other and q == texts[n]):
                continue
            new = ratio(q, texts[n])
            if new >= threshold and (new > r or (new == r and ords[n] < ords[at])):
                r, at = new, n
        top[i] = (r, at)
    return top


def fuzzy(units: DataFrame, memory: DataFrame, key: str, threshold: float = K.SIMILARITY, block: int = 40_000, part: int = 40_000, other: bool = False, target: bool = True) -> DataFrame:
    """(key, tm_ord, tm_target, similarity): the most similar entry at or above the threshold for each unit.

    Texts are stripped; case counts. A ratio of t needs lengths within t / (2 - t) of each
    other, so both sides are dealt into length classes; a unit meets its own class and the two beside it. Within a class
    entries are dealt by hash into blocks of about `block` texts or CHARS characters, units into parts of about `part`
    texts or as many characters, and a task compares one part with one block, so that none grows beyond those. Texts
    that occur more than once are compared once. No pair is given out; each task gives its best, and the best of these is
    taken by a sum. other: entries equal to the unit are passed over. target: without, tm_target is left out and not moved.
    """
    width = math.log((2 - threshold) / threshold) * 1.0001
    text = strip
    cls = lambda c: F.floor(F.log(F.length(c)) / F.lit(width)).cast("int")
    deal = lambda n, most: F.greatest(F.ceil(F.col(n) / F.lit(most)), F.ceil(F.col(f"{n}_chars") / F.lit(CHARS)), F.lit(1)).cast("int")
    q = units.select(key, text(F.col("source_text")).alias("q")).where("q != ''")
    distinct = q.select("q").distinct()
    moved = ["target_text"] if target else []
    entries = memory.select("ord", *moved, text(F.col("source_text")).alias("m")).where("m != ''")
    m = entries.groupBy("m").agg(F.min("ord").alias("ord"), *[F.min_by(c, "ord").alias(c) for c in moved])
    # how finely a class is dealt needs no exact number: texts that repeat are counted each time, and nothing is moved for it
    beside = F.explode(F.array(*[F.lit(d) for d in (-1, 0, 1)]))
    blocks = entries.groupBy(cls("m").alias("c")).agg(F.count("*").alias("m"), F.sum(F.length("m")).alias("m_chars")).select("c", deal("m", block).alias("k"))
    parts = q.groupBy(cls("q").alias("c")).agg(F.count("*").alias("n"), F.sum(F.length("q")).alias("n_chars")).select(beside.alias("d"), "c", "n", "n_chars")
    parts = parts.groupBy((F.col("c") + F.col("d")).alias("c")).agg(F.sum("n").alias("n"), F.sum("n_chars").alias("n_chars")).select("c", deal("n", part).alias("p"))
    sizes = F.broadcast(blocks.join(F.broadcast(parts), "c"))
    m = m.withColumn("c", cls("m")).join(sizes, "c").withColumn("b", F.pmod(F.xxhash64("m"), F.col("k")).cast("int"))
    m = m.select("c", "b", F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("a"), "m", "ord", *moved)
    near = distinct.select("q", F.explode(F.array(*[cls("q") + d for d in (-1, 0, 1)])).alias("c")).join(sizes, "c")
    near = near.select("c", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("b"), F.pmod(F.xxhash64("q"), F.col("p")).cast("int").alias("a"), "q")
    columns = ["q", "similarity", "ord", *moved]

    def compare(qs: pd.DataFrame, ms: pd.DataFrame) -> pd.DataFrame:
        found = best(list(qs["q"]), list(ms["m"]), ms["ord"].to_numpy(), threshold, other)
        rows = [(t, r, int(ms["ord"].iloc[k]), *[ms[c].iloc[k] for c in moved]) for t, (r, k) in zip(qs["q"], found, strict=True) if k >= 0]
        kinds = {"similarity": float, "ord": "int64"}
        return pd.DataFrame({c: pd.Series([r[j] for r in rows], dtype=kinds.get(c, object)) for j, c in enumerate(columns)})

    hits = near.groupBy("c", "b", "a").cogroup(m.groupBy("c", "b", "a")).applyInPandas(compare, "q string, similarity double, ord long" + ", target_text string" * target)
    top = hits.groupBy("q").agg(F.max(F.struct("similarity", (-F.col("ord")).alias("minus"), *moved)).alias("t"))
    top = top.select("q", (-F.col("t.minus")).alias("tm_ord"), *[F.col("t.target_text").alias("tm_target") for _ in moved], F.col("t.similarity").alias("similarity"))
    return q.join(top, "q").select(key, "tm_ord", *["tm_target" for _ in moved], "similarity")


def growing(units: DataFrame, memory: DataFrame, by: str, translate, threshold: float = K.SIMILARITY, most: int = 50_000) -> DataFrame:
    """Strict mode: units of one group, in order of seq, each seeing what those before it have added.

    Exact match, then the most similar one, then translate(text); only the last adds to the memory. Inherently
    sequential within `by`; groups run side by side. The starting memory is broadcast and must not exceed `most`
    entries.
    """
    start = memory.select("ord", "source_text", "target_text")
    if start.limit(most + 1).count() > most:
        raise ValueError(f"over {most} entries: use exact() and fuzzy() on a snapshot")
    rows = [tuple(r) for r in start.orderBy("ord").toLocalIterator()]
    sent = units.sparkSession.sparkContext.broadcast(rows)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = [s for _, s, _ in sent.value]
        targets = [t for _, _, t in sent.value]
        place = {s: k for k, s in enumerate(texts)}
        out = []
        for seq, s in pdf.sort_values("seq")[["seq", "source_text"]].itertuples(index=False):
            if s in place:
                out.append((seq, targets[place[s]], "exact", 1.0))
                continue
            low = s.strip()
            top = (0.0, -1)
            for k, t in enumerate(texts):
                t = t.strip()
                if t and low and 2 * min(len(t), len(low)) >= threshold * (len(t) + len(low)):
                    r = ratio(low, t)
                    top = (r, k) if r > top[0] else top
            if top[0] >= threshold:
                out.append((seq, targets[top[1]], "difflib_ratio", round(top[0], 3)))
            else:
                new = translate(s)
                out.append((seq, new, None, None))
                place[s] = len(texts)
                texts.append(s)
                targets.append(new)
        return pd.DataFrame([(pdf[by].iloc[0], *r) for r in out], columns=[by, "seq", "translated_text", "tm_match_type", "tm_similarity"])

    kind = units.schema[by].dataType.simpleString()
    return units.groupBy(by).applyInPandas(run, f"{by} {kind}, seq long, translated_text string, tm_match_type string, tm_similarity double")
