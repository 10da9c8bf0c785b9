"""Aligning source and target by path, scoring, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aligna import constants as K
from aligna.functions import text as X

COUNTS = ["total_units", "aligned_units", "nonempty_units", "number_checks", "number_pass", "cjk_units", "forbidden_hits", "repeat_total", "repeat_stable", "glossary_total", "glossary_hit"]


def align(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Every source unit with the target text of its path: '' and aligned false where there is none."""
    t = target.select(*keys, "path", F.col("target_text"), F.lit(True).alias("aligned"))
    out = source.join(t, [*keys, "path"], "left")
    return out.withColumn("target_text", F.coalesce("target_text", F.lit(""))).withColumn("aligned", F.coalesce("aligned", F.lit(False)))


def align_at(units: DataFrame, made: dict[str, Column], known: Column, more: dict[str, dict[str, Column]] | None = None) -> DataFrame:
    """align() where both sides of a path stand in one row: each unit with each target of its path, for every candidate.

    made: for each candidate an array of the path's targets, null where one is missing. Without `known` (a null
    document) nothing matches, as in a join. more: other columns, by candidate.
    """
    more = more or {}
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("candidate"), F.when(known, F.array_compact(t)).alias("texts"), *[v[c].alias(n) for n, v in more.items()]) for c, t in made.items()]))
    out = units.withColumn("made", each).select("*", F.col("made.candidate").alias("candidate"), *[F.col("made")[n].alias(n) for n in more], F.explode_outer("made.texts").alias("target_text")).drop("made")
    return out.withColumn("aligned", F.col("target_text").isNotNull()).withColumn("target_text", F.coalesce("target_text", F.lit("")))


def source_terms(source: Column, anchors: list[str]) -> Column:
    """The entries of glossary_array's `terms` that a text holds; case is ignored.

    What holds an entry also holds each word that has a space on both sides in it: only entries whose `anchor`, such a
    word, is among the words of the text are compared, and those that have none. anchors: all anchors.
    """
    def held(low: Column) -> Column:
        test = lambda g, words: (g["anchor"].isNull() | F.array_contains(words, g["anchor"])) & X.has(low, g["source_low"])
        words = F.filter(F.split(low, " ", -1), lambda w: w.isin(anchors)) if anchors else F.array().cast("array<string>")
        return X.let(words, lambda words: F.filter(F.when(F.size(words) > 0, F.col("terms")).otherwise(F.col("loose")), lambda g: test(g, words)))

    return F.coalesce(X.let(F.lower(source), held), F.filter("terms", lambda g: F.lit(False)))


def target_terms(target: Column, held: Column) -> Column:
    """How many of the entries held by a source the target has."""
    return F.when(F.size(held) > 0, X.let(F.lower(target), lambda t: F.size(F.filter(held, lambda g: X.has(t, g["target_low"]))))).otherwise(0)


def glossary_array(glossary: DataFrame, most: int = 10_000) -> DataFrame:
    """One row with all active entries as an array, to be broadcast; more than `most` entries are refused.

    terms: all; loose: those without an anchor (see source_terms); anchors: the distinct anchors.
    """
    active = glossary.where("active").select("ord", "source_term", "target_term")
    if active.limit(most + 1).count() > most:
        raise ValueError(f"over {most} terms: use operators.glossary.match, which scans with an automaton")
    low = F.lower("source_term")
    inner = X.let(F.split(low, " ", -1), lambda w: F.slice(w, F.lit(2), F.greatest(F.size(w) - 2, F.lit(0))))
    longest = F.array_max(F.transform(F.filter(inner, lambda w: F.length(w) > 0), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    one = active.agg(F.sort_array(F.collect_list(F.struct("ord", "source_term", "target_term", low.alias("source_low"), F.lower("target_term").alias("target_low"), longest.alias("anchor")))).alias("terms"))
    return one.select("terms", F.filter("terms", lambda g: g["anchor"].isNull()).alias("loose"), F.array_distinct(F.array_compact(F.transform("terms", lambda g: g["anchor"]))).alias("anchors"))


def with_terms(units: DataFrame, glossary: DataFrame) -> DataFrame:
    """units with source_terms, the glossary's entries that the source holds. Its anchors, at most as many, are looked up as a set."""
    one = glossary_array(glossary)
    anchors = one.first()["anchors"]
    return units.crossJoin(F.broadcast(one)).withColumn("source_terms", source_terms(F.col("source_text"), anchors)).drop("terms", "loose", "anchors")


def text_digest(c: Column) -> Column:
    return F.sha2(X.normalize(c), 256)


def source_measures(units: DataFrame, glossary: DataFrame | None = None) -> DataFrame:
    """What unit_measures needs of the source alone: with many candidates, worked out once for each unit."""
    out = units if glossary is None else with_terms(units, glossary)
    digest = F.col("source_digest")
    out = out.withColumn("source_nums", X.without(X.numbers_score(F.col("source_text")), ","))
    out = out if "source_digest" in out.columns else out.withColumn("source_digest", text_digest(F.col("source_text")))
    out = out.withColumn("source_forbidden", X.forbidden(F.col("source_text")))
    return out.withColumn("source_key", F.when(digest != F.sha2(F.lit(""), 256), F.unhex(F.substring(digest, 1, 32))))


def unit_measures(aligned: DataFrame, residue: str = K.CJK, glossary: DataFrame | None = None) -> DataFrame:
    """Per unit: what is counted later. Narrow; all in the JVM.

    What is known of the source holds for a target equal to it. The text of a unit that is `alone`, the one of its pair
    with this source, is compared with none and stands for any. Normalised texts are told apart by 128 bits made from their SHA-256 (source_key, null where empty; target_high and
    target_low), so that they can be counted by hash at a fixed width and need not be moved.
    """
    s, t = F.col("source_text"), F.col("target_text")
    out = aligned if "source_key" in aligned.columns else source_measures(aligned, glossary)
    checked = F.size("source_nums") > 0
    passed = checked & ((s == t) | X.all_within(F.col("source_nums"), X.without(X.numbers_score(t), ",")))
    total, hit = (F.size("source_terms"), target_terms(t, F.col("source_terms"))) if "source_terms" in out.columns else (F.lit(0), F.lit(0))
    known = (s == t) | F.col("alone") if "alone" in aligned.columns else s == t
    digest = F.when(known, F.col("source_digest")).otherwise(text_digest(t))
    forbidden = F.when(s == t, F.col("source_forbidden")).otherwise(X.forbidden(t))
    kept = [c for c in aligned.columns if c not in ("source_nums", "source_terms", "source_digest", "source_key", "source_forbidden", "alone")]
    return out.withColumn("digest", digest).select(
        *kept, X.nonblank(t).alias("nonempty"), checked.alias("number_check"), F.coalesce(passed, F.lit(False)).alias("number_ok"),
        (~F.startswith("path", F.lit("table[")) & X.residue(t, residue)).alias("residue"), forbidden.alias("forbidden"),
        X.scope_score(s, t).alias("scope"), "source_key", F.xxhash64("digest").alias("target_high"), F.xxhash64(F.lit(1), "digest").alias("target_low"),
        total.cast("long").alias("terms_total"), hit.cast("long").alias("terms_hit"),
    )


def pair_counts(measures: DataFrame, keys: list[str], flags: list[str] = ()) -> DataFrame:
    """COUNTS and mean scope of each pair, and whether each of flags holds for all its units.

    First by normalised source, where the least and the greatest digest of the targets say whether all are the same (so
    no count of distinct values is needed), then by pair; both sums are combined before their shuffles, if they have any.
    """
    one = measures.groupBy(*keys, "source_key").agg(
        F.count("*").alias("n"), F.count_if("aligned").alias("al"), F.count_if("nonempty").alias("ne"), F.count_if("number_check").alias("nc"), F.count_if("number_ok").alias("np"),
        F.count_if("residue").alias("cj"), F.count_if("forbidden").alias("fo"), F.sum("scope").alias("sc"),
        *[f(f"target_{part}").alias(f"{part}_{name}") for part in ("high", "low") for name, f in (("least", F.min), ("most", F.max))], F.sum("terms_total").alias("gt"), F.sum("terms_hit").alias("gh"), *[F.min(c).alias(c) for c in flags],
    )
    keyed = F.col("source_key").isNotNull()
    same = (F.col("high_least") == F.col("high_most")) & (F.col("low_least") == F.col("low_most"))
    sums = [F.sum(c).alias(a) for c, a in zip(("n", "al", "ne", "nc", "np", "cj", "fo"), COUNTS[:7], strict=True)]
    return one.groupBy(*keys).agg(*sums, F.count_if(keyed).alias("repeat_total"), F.count_if(keyed & same).alias("repeat_stable"), F.sum("gt").alias("glossary_total"), F.sum("gh").alias("glossary_hit"), (F.sum("sc") / F.sum("n")).alias("scope_mean"), *[F.min(c).alias(c) for c in flags])


def metrics(counts: DataFrame) -> DataFrame:
    """Scores, gates and findings from counts and from paragraph_match, table_match, cell_match."""
    d = lambda c: F.col(c).cast("double")
    n, a = F.greatest(d("total_units"), F.lit(1.0)), F.greatest(d("aligned_units"), F.lit(1.0))
    percent = lambda part, whole: F.when(F.col(whole) == 0, 100.0).otherwise(F.lit(100.0) * (d(part) / F.greatest(d(whole), F.lit(1.0))))
    ok = sum((F.col(c).cast("int") for c in ("table_match", "cell_match")), F.col("paragraph_match").cast("int")).cast("double")
    out = counts.select(
        "*",
        (F.lit(0.5) * F.lit(100.0) * (ok / F.lit(3.0)) + F.lit(50.0) * (d("aligned_units") / n)).alias("structure_fidelity"),
        (F.lit(100.0) * (F.lit(0.7) * (d("aligned_units") / n) + F.lit(0.3) * (d("nonempty_units") / n))).alias("completeness"),
        percent("number_pass", "number_checks").alias("number_integrity"),
        (d("cjk_units") / a).alias("cjk_ratio"),
        percent("repeat_stable", "repeat_total").alias("repetition_consistency"),
        F.when(F.col("glossary_total") > 0, F.lit(100.0) * (d("glossary_hit") / F.greatest(d("glossary_total"), F.lit(1.0)))).alias("glossary_hit_ratio"),
    )
    hits = d("forbidden_hits")
    out = out.withColumn("cjk_penalty", F.least(F.lit(70.0), F.col("cjk_ratio") * 100.0 * 0.90))
    out = out.select(
        "*",
        X.clamp(F.coalesce("scope_mean", F.lit(0.0)) - F.least(F.lit(30.0), F.lit(4.0) * hits)).alias("scope_adherence"),
        X.clamp(F.lit(100.0) - F.least(F.lit(45.0), F.lit(8.0) * hits) - F.col("cjk_penalty")).alias("professionalism"),
        F.coalesce(F.col("repetition_consistency") * K.TERMS["repetition"] + F.col("glossary_hit_ratio") * K.TERMS["glossary"], F.col("repetition_consistency")).alias("terminology_consistency"),
        (F.lit(100.0) - F.col("cjk_penalty")).alias("residue"),
    )
    weighted = lambda weights: X.clamp(sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0)))
    out = out.withColumn("accuracy", weighted(K.ACCURACY))
    overall = weighted(K.OVERALL)
    out = out.withColumn("overall", overall)
    cap = F.lit(100.0)
    for least, most in reversed(K.RESIDUE_GATES):
        cap = F.when(F.col("cjk_ratio") >= least, most).otherwise(cap)
    numbers = F.lit(100.0)
    for below, most in reversed(K.NUMBER_GATES):
        numbers = F.when(F.col("number_integrity") < below, most).otherwise(numbers)
    words = F.when(F.col("forbidden_hits") >= K.FORBIDDEN_GATE[0], K.FORBIDDEN_GATE[1]).otherwise(100.0)
    out = out.withColumn("overall", F.least("overall", cap, numbers, words))
    rules = [("paragraphs", ~F.col("paragraph_match")), ("tables", ~F.col("table_match")), ("cells", ~F.col("cell_match")), ("residue", F.col("cjk_ratio") > 0.05), ("forbidden", F.col("forbidden_hits") > 0), ("numbers", F.col("number_integrity") < 95), ("terms", F.col("glossary_hit_ratio") < 90)]
    findings = F.array_compact(F.array(*[F.when(rule, F.lit(K.FINDINGS[name])) for name, rule in rules]))
    return out.withColumn("findings", findings).withColumn("cjk_residue_ratio", F.col("cjk_ratio") * 100.0).drop("residue", "cjk_penalty", "cjk_ratio")


def with_structure(counts: DataFrame, source: DataFrame, target: DataFrame, source_keys: list[str], keys: list[str]) -> DataFrame:
    """paragraph_match, table_match, cell_match of raw structure counts; a side without rows counts as zero."""
    names = ["paragraphs", "tables", "cells"]
    s = source.select(*source_keys, *[F.col(c).alias(f"s_{c}") for c in names])
    t = target.select(*keys, *[F.col(c).alias(f"t_{c}") for c in names])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = counts.join(s, source_keys, "left").join(t, keys, "left")
    for name, flag in zip(names, ("paragraph_match", "table_match", "cell_match"), strict=True):
        out = out.withColumn(flag, zero(f"s_{name}") == zero(f"t_{name}"))
    return out.drop(*[f"{x}_{c}" for x in "st" for c in names])


def rank(metrics_: DataFrame, by: list[str], tie: str = "name", exclude: list[str] = ()) -> DataFrame:
    """rank 1..n by overall, highest first; ties get places by the tie column. Excluded names go first."""
    kept = metrics_.where(~F.col(tie).isin(*exclude)) if exclude else metrics_
    order = [F.col("overall").desc(), F.col(tie).asc()]
    w = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
    return kept.withColumn("rank", F.row_number().over(w))
