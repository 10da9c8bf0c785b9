"""Near duplicates: fast similarity sketches, banding, and links confirmed on whole shingle sets."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aligna.llm.common import begin, mix, numbered, raw, settle, side, slices, word_hashes

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
LOW = np.uint64(0xFFFFFFFF)
S32 = np.uint64(32)


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of all texts end to end, and their bounds.

    Words: runs without ASCII white space, A-Z lowered. Fewer words than size: all of them are the one shingle.
    """
    ids, bounds, words = numbered(texts, lower=True)
    h = word_hashes(words)[ids]
    if len(h) >= size:
        total = np.zeros(len(h) - size + 1, np.uint64)
        for k in range(size):
            total = total * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(total)]
        total = mix(total)
    parts = []
    for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
        if b - a >= size:
            parts.append(np.unique(total[a : b - size + 1]))
        elif b > a:
            x = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in h[a:b]:
                    x = x * np.uint64(0x9E3779B97F4A7C15) + w
            parts.append(mix(np.array([x ^ np.uint64(0xA5A5A5A5)])))
        else:
            parts.append(h[:0])
    out = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=out[1:])
    return (np.concatenate(parts) if parts else h[:0]), out


def sketch(flat: np.ndarray, bounds: np.ndarray, t: int) -> np.ndarray:
    """A row of t coordinates for each set (Dahlgaard, Knudsen, Thorup: Fast Similarity Sketching).

    Round i < t throws every element into one of t bins with value (i, hash) and each bin keeps its least; rounds
    t..2t-1 throw all elements into bin i - t. So every coordinate of a set that isn't empty fills, and the equal
    coordinates of two sets are concentrated around their Jaccard similarity. A set stops when it is full.
    """
    n = len(bounds) - 1
    s = np.full(n * t, EMPTY, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    x = flat
    for i in range(t):
        if not len(x):
            break
        g = mix(x + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        b = ((g >> S32) * np.uint64(t)) >> S32
        np.minimum.at(s, owner * t + b.astype(np.int64), np.uint64(i) << S32 | (g & LOW))
        if i % 2 or i < 4:
            open_ = (s.reshape(n, t) == EMPTY).any(1)[owner]
            x, owner = x[open_], owner[open_]
    grid = s.reshape(n, t)
    for i in range(t):
        if not len(x):
            break
        need = grid[owner, i] == EMPTY
        if need.any():
            g = mix(x[need] + np.uint64((t + i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            np.minimum.at(s, owner[need] * t + i, np.uint64(t + i) << S32 | (g & LOW))
    return grid


def band_keys(grid: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each run of `rows` coordinates."""
    bands = grid.shape[1] // rows
    h = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None, :], len(grid), 0)
    cut = grid[:, : bands * rows].reshape(len(grid), bands, rows)
    for k in range(rows):
        h = mix(h ^ cut[:, :, k])
    return h


def confirm(sets: list[np.ndarray], label: np.ndarray, num: int, den: int = 100, width: int = 16384) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with den * intersection >= num * union.

    With two labels only pairs across them count. Intersections are exact: products of 0/1 matrices over the
    shingles that at least two sets have, `width` of them at a time.
    """
    n = len(sets)
    sizes = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    _, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    new = np.cumsum(shared) - 1
    keep = shared[col]
    col, owner = new[col[keep]], owner[keep]
    order = np.argsort(col, kind="stable")
    col, owner = col[order], owner[order]
    total = int(shared.sum())
    common = np.zeros((n, n), np.float64)
    for a in range(0, total, width):
        i, j = np.searchsorted(col, [a, a + width])
        m = np.zeros((n, min(width, total - a)), np.float32)
        m[owner[i:j], col[i:j] - a] = 1
        common += m @ m.T
    common = np.rint(common).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - common
    ok = np.triu(den * common >= num * union, 1)
    if len(set(label.tolist())) > 1:
        ok &= label[:, None] != label[None, :]
    root = list(range(n))

    def find(v):
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    out = []
    for i, j in np.argwhere(ok).tolist():
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root: the least node of its component.

    Each round every node hooks to its least neighbour, halves its path, and the edges are rewritten on what is
    left; nodes that hook leave for good. Only sums by key and joins: no component meets in one task.
    """
    edges = settle(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    mapping = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        p = settle(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "hooks")
        up = p.select(F.col("node").alias("root"), F.col("root").alias("up"))
        p = settle(p.join(up, "root").select("node", F.col("up").alias("root")), "halved")
        to = p.select(F.col("node").alias("root"), F.col("root").alias("up"))
        mapping = p if mapping is None else settle(mapping.join(to, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "roots")
        pa_, pb = p.select(F.col("node").alias("a"), F.col("root").alias("ra")), p.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = edges.join(pa_, "a").join(pb, "b").where("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        edges = settle(edges, "edges")
    if mapping is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return mapping


def _kind(docs: DataFrame, id_col: str) -> str:
    return docs.schema[id_col].dataType.simpleString()


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int, rows: int, bands: int) -> DataFrame:
    """id, n_shingles, a 128-bit fingerprint (f1, f2) of the set, and its band keys (none for an empty set)."""

    def run(batches):
        begin()
        for batch in batches:
            texts = raw(batch.column(1))
            for a, b in slices(texts):
                flat, bounds = shingle_sets(texts[a:b], size)
                n = np.diff(bounds)
                f = []
                for seed in (0x1234567, 0x89ABCDEF):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat ^ np.uint64(seed)), dtype=np.uint64)])
                    f.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
                keys = band_keys(sketch(flat, bounds, rows * bands), rows).view(np.int64)
                ends = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[n > 0].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), pa.array(f[0]), pa.array(f[1]), lists], names=["id", "n_shingles", "f1", "f2", "bands"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {_kind(docs, id_col)}, n_shingles long, f1 long, f2 long, bands array<long>")


def _blocks(members: DataFrame, similarity: float, block: int) -> DataFrame:
    """(id, grp, unit, label, task): the comparisons every member takes part in.

    A group of at most `block` members is one unit. A larger one is dealt into size classes (linked sets lie in one
    or in neighbouring classes) and each class by hash into blocks; a unit is a block with itself or with another, so
    that a unit never holds more than about 2 * block sets.
    """
    width = math.log(1 / similarity) * 1.0001
    n = members.groupBy("grp").agg(F.count("*").alias("n_grp"))
    large = settle(n.where(F.col("n_grp") > block).select("grp"), "large")
    one = members.join(side(large), "grp", "left_anti").select("id", F.concat(F.lit("g"), "grp").alias("unit"), F.lit(0).alias("label"))
    classed = members.join(side(large), "grp").withColumn("c", F.floor(F.log("n_shingles") / F.lit(width)).cast("int"))
    m = classed.groupBy("grp", "c").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("m"))
    near = m.select("grp", "c", "m")
    for step, name in ((-1, "below"), (1, "above")):
        near = near.join(m.select("grp", (F.col("c") - step).alias("c"), F.col("m").alias(name)), ["grp", "c"], "left")
    near = settle(near, "classes")
    dealt = classed.join(side(near), ["grp", "c"]).withColumn("i", F.pmod(F.xxhash64("id"), F.col("m")).cast("int"))

    def many(count, name):
        seq = F.when(F.coalesce(count, F.lit(0)) > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(seq, name)

    def unit(c1, i1, c2, i2):
        return F.concat_ws("_", F.lit("b"), "grp", c1.cast("string"), i1.cast("string"), c2.cast("string"), i2.cast("string"))

    c, i = F.col("c"), F.col("i")
    units = F.concat(
        many(F.col("m"), lambda j: F.struct(unit(c, F.least(i, j), c, F.greatest(i, j)).alias("unit"), i.alias("label"))),
        many(F.col("above"), lambda j: F.struct(unit(c, i, c + 1, j).alias("unit"), F.lit(-1).alias("label"))),
        many(F.col("below"), lambda j: F.struct(unit(c - 1, j, c, i).alias("unit"), F.lit(-2).alias("label"))),
    )
    more = dealt.select("id", F.explode(units).alias("u")).select("id", "u.unit", "u.label")
    return one.unionByName(more)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, rows: int = 6, bands: int = 56, block: int = 400) -> DataFrame:
    """Per row: id, n_shingles, component_id (least id reachable over links), kept (id = component_id).

    Two texts are linked where 100 * intersection >= percent * union of their sets of `size`-word shingles. Texts with
    equal sets are one node. Candidates share a band of `rows` sketch coordinates (a pair at 80 % is missed with a
    chance of 4e-8, at 85 % 3e-12); every bucket gives a star, the stars' components are groups, and all pairs
    within a group are compared on whole sets, in blocks, each giving a spanning forest. Nothing is capped.
    Null and empty texts and those without a word have no shingles and no links. A row whose id is null is linked
    with nothing, has component_id null and is kept. Repeated rows give a row each; ids that clash in text are judged
    row by row. Ids may be numbers or texts. Other columns are ignored. An empty table gives no rows.
    """
    sig = settle(signatures(docs, id_col, text_col, size, rows, bands), "signatures")
    real = sig.where("id IS NOT NULL AND n_shingles > 0")
    reps = settle(real.groupBy("f1", "f2", "n_shingles").agg(F.min("id").alias("rep")), "sets")
    lone = real.join(reps.withColumnRenamed("rep", "id"), ["f1", "f2", "n_shingles", "id"]).select("id", F.explode("bands").alias("key"))
    lows = lone.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("hi")).where("a < hi").select("key", "a")
    stars = lone.join(lows, "key").where("id != a").select("a", F.col("id").alias("b"))
    groups = components(stars)
    members = groups.select(F.col("node").alias("id"), F.col("root").alias("grp")).join(reps.select(F.col("rep").alias("id"), "n_shingles").dropDuplicates(["id"]), "id")
    members = settle(members, "members")
    linked = _confirmed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), members, size, percent, block)
    found = components(linked).select(F.col("node").alias("rep"), F.col("root").alias("comp"))
    out = sig.select("id", "n_shingles", "f1", "f2").join(reps, ["f1", "f2", "n_shingles"], "left").join(found, "rep", "left")
    comp = F.when(F.col("id").isNull() | (F.col("n_shingles") == 0), F.col("id")).otherwise(F.coalesce("comp", "rep"))
    out = out.select(F.col("id").alias(id_col), "n_shingles", comp.alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def _confirmed(docs: DataFrame, members: DataFrame, size: int, percent: int, block: int) -> DataFrame:
    kind = _kind(docs, "id")

    def sets(batches):
        begin()
        for batch in batches:
            texts = raw(batch.column(1))
            for a, b in slices(texts):
                flat, bounds = shingle_sets(texts[a:b], size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([flat[i:j].tobytes() for i, j in zip(bounds, bounds[1:], strict=False)], pa.binary())], names=["id", "shingles"])

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, unit in pdf.groupby("unit", sort=False):
            unit = unit.drop_duplicates(["id", "shingles"])
            if len(unit) > 1:
                ids = unit["id"].tolist()
                arrays = [np.frombuffer(x, np.uint64) for x in unit["shingles"]]
                out += [(ids[i], ids[j]) for i, j in confirm(arrays, unit["label"].to_numpy(), percent)]
        return pd.DataFrame(out, columns=["a", "b"], dtype=None if out else "object")

    units = _blocks(members, percent / 100, block)
    tasks = max(1, members.count() // block)
    units = units.withColumn("task", F.when(F.col("unit").startswith("g"), F.pmod(F.xxhash64("unit"), F.lit(tasks)).cast("string")).otherwise(F.col("unit")))
    hashed = docs.join(members.select("id"), "id").mapInArrow(sets, f"id {kind}, shingles binary")
    return units.join(settle(hashed, "shingles"), "id").groupBy("task").applyInPandas(compare, f"a {kind}, b {kind}")
