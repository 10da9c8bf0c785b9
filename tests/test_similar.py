"""The similar lookup against every pair compared."""

import random

import numpy as np
from pyspark.sql import functions as F

from aligna import queries
from aligna.functions import similar
from aligna.operators import memory


def changed(rng, text, share):
    """text with about a share of its characters dropped, replaced or doubled."""
    out = []
    for c in text:
        z = rng.random() / share if share else 1
        out.append("" if z < 0.3 else rng.choice("abexyz") if z < 0.6 else c + rng.choice("abq ") if z < 1 else c)
    return "".join(out).strip() or "b"


def made(rng, letters, size):
    out = ""
    while len(out) < size:
        out += "".join(rng.choice(letters) for _ in range(rng.randint(1, 8))) + " "
    return out[:size].strip() or "a"


def brute(q, texts, ords, other):
    top = (0.0, -1)
    for k in np.argsort(ords):
        r = memory.ratio(q, texts[k]) if not (other and q == texts[k]) else 0.0
        top = (r, int(k)) if r >= 0.85 and r > top[0] else top
    return top


def test_best_is_that_of_all_pairs():
    rng, hits = random.Random(7), 0
    for round_ in range(8):
        letters = ["ab", "abcde", "abcdefghijklmnopqrstuvwxyzABC.,\u00e9\u4e2d", "aaaaaaaabc"][round_ % 4]
        base = [made(rng, letters, size) for size in (1, 3, 8, 20, 60, 120, 199, 210, 330)]
        texts = sorted({changed(rng, b, p) for b in base for p in (0, 0.02, 0.05, 0.1, 0.15, 0.25)})
        asked = [changed(rng, b, p) for b in base for p in (0, 0.05, 0.12)] + [b[len(b) // 10 :] + b[: len(b) // 10] for b in base] + ["".join(c + rng.choice(["", "", "q"]) for c in b) for b in base]
        ords = np.array(rng.sample(range(10**6), len(texts)))
        got = memory.best(asked, texts, ords, 0.85, other=round_ % 2 == 1)
        assert got == [brute(q, texts, ords, round_ % 2 == 1) for q in asked]
        hits += sum(k >= 0 for _, k in got)
    assert hits > 80


def test_many_candidates_at_once():
    rng = random.Random(3)
    base = made(rng, "abcdefghij", 70)
    texts = sorted({changed(rng, base, 0.2) for _ in range(300)})
    asked = [changed(rng, base, 0.1) for _ in range(5)]
    ords = np.arange(len(texts))[::-1].copy()
    assert memory.best(asked, texts, ords, 0.85) == [brute(q, texts, ords, False) for q in asked]


def longest(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        last = 0
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if c == d else max(row[j], row[j - 1])
    return row[-1]


def test_only_pairs_with_enough_in_common_in_order_are_let_through():
    """Of texts with nearly the same characters in other orders, those are let through that have a common subsequence as long as must be matched."""
    rng = random.Random(11)
    words = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or"]
    texts = ["".join(rng.choice(words) + rng.choice(["", "", " "]) for _ in range(200))[: rng.randint(40, 330)].strip() for _ in range(150)]
    texts = sorted({changed(rng, a, p) for a in texts for p in (0, 0.12)})
    asked = [changed(rng, a, 0.08) for a in texts[::12]]
    y = similar.Texts(texts)
    i, k = similar.candidates(similar.Texts(asked, y.letters), y, 0.85)[:2]
    got = set(zip(i.tolist(), k.tolist(), strict=True))
    sure = {(a, b) for a, s in enumerate(asked) for b, t in enumerate(texts) if memory.ratio(s, t) >= 0.85}
    assert len(sure) > 20 and sure <= got and all(2 * longest(asked[a], texts[b]) >= 0.85 * (len(asked[a]) + len(texts[b])) for a, b in got)


def test_common_subsequences_within_the_band():
    """Of texts of any length, in one word or several, the longest is found wherever it is long enough."""
    rng = random.Random(13)
    for size in (5, 60, 150, 190, 230, 420):
        base = made(rng, "abcdefg", size)
        texts, asked = ([changed(rng, base, p) for p in (0.02, 0.1, 0.15, 0.2, 0.25, 0.3) for _ in range(4)] for _ in range(2))
        y = similar.Texts(texts)
        x = similar.Texts(asked, y.letters)
        i, k = (a.ravel() for a in np.indices((len(asked), len(texts))))
        fit = similar.matched(x.n[i], y.n[k], 0.85) <= np.minimum(x.n[i], y.n[k])
        i, k = i[fit], k[fit]
        live, most = similar.within(x, i, y.rows(np.arange(len(texts))), k, y.n[k], 0.85)
        real = np.array([longest(asked[a], texts[b]) for a, b in zip(i, k, strict=True)])
        enough = real >= similar.matched(x.n[i], y.n[k], 0.85)
        assert live.tolist() == np.flatnonzero(enough).tolist() and most.tolist() == real[enough].tolist()


def test_any_dealing_gives_the_same(spark):
    rng = random.Random(5)
    texts = sorted({changed(rng, made(random.Random(i % 9), "abcdefgh", 15 * (i % 9 + 1)), 0.05) for i in range(120)})
    m = spark.createDataFrame([(i, f" {t}", f"T{i}") for i, t in enumerate(texts)], "ord long, source_text string, target_text string")
    u = m.select(F.col("ord").alias("k"), "source_text")
    whole, cut = (sorted(tuple(r) for r in memory.fuzzy(u, m, "k", block=b, part=p, other=True).collect()) for b, p in ((10**6, 10**6), (7, 5)))
    assert whole == cut and len(whole) > 60 and all(k != o and t == f"T{o}" for k, o, t, _ in whole)


def test_query_searches_all_documents(spark, tmp_path):
    """Ids divisible by 100 ask; entries come from even and odd documents, the asking ones included, but never the same text."""
    rows = [(100, "alpha beta gamma delta epsilon\nnothing is like this one"), (3, "alpha beta gamma delta epsilom"), (4, "alpha beta gamma delta epsilon"), (200, "alpha beta gamma delta epsilo"), (301, "alpha beta gamma")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.unit: (r.tm_ord, r.similarity) for r in queries.QUERIES["tm_fuzzy_difflib"](spark, str(tmp_path)).collect()}
    # of equals the least ord: 3 and 4 are as near to 200's line
    assert got == {"100/body/p[0]": (200_000_000, 0.983051), "200/body/p[0]": (3_000_000, 0.983051)}
