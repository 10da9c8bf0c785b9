"""Hierarchical Pitman-Yor language model, seated by Gibbs sampling, for scoring whole texts.

Restaurants: one for each context (the preceding word, by its 64-bit hash, as many as the corpus has), all of whose
tables are customers of one root restaurant over words, whose base is uniform over the V training words and one
unknown word. Words are keyed by a 64-bit hash.

Data flow. Tasks write documents down as chunks of about CHUNK bytes and send, for every word a chunk holds, its
contexts and counts to one of as many buckets (by the word's hash) as there are chunks. A bucket so has all customers
of its words. What a context's customers and tables sum up to over all buckets is added in shards by the context's
hash, which answer the buckets that ask (totals); only four sums over the corpus and two after each sweep meet at
the driver. Every sweep seats each (context, word) anew given all others (the context's table total is that of the
sweep before, as in distributed Gibbs samplers). A pair met once always has one table, so that sweeps carry only the
others. Generators are seeded by bucket and sweep, so a lost task gives the same seats again. Buckets return averaged
log probabilities to the chunks, which sum them up.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aligna.llm.common import begin, drop, heavy_rows, mix, numbered, raw, settle, trim, word_hashes

CHUNK, SWEEPS, BURN_IN = 12 << 20, 3, 1
#: A word with more than 1 / (PARTS * buckets) of all tokens, or LEAST_SHARE, is split by context over several buckets.
PARTS, LEAST_SHARE = 8, 1e-6
#: The end of a text, and what stands before its first word; no word is a space.
END = b" "


#: Customers up to which Stirling numbers come from their recurrence; beyond, from an integral.
RECURRENCE = 1024
#: Pairs that a chunk scores at once.
RUN = 1 << 17


def ratios(c: int, t: np.ndarray, d: float) -> np.ndarray:
    """Logs of S(c, t + 1) / S(c, t) of generalised Stirling numbers, for large c.

    S(c, t) is c! / (t! d**t) times the c-th coefficient of (1 - (1 - z)**d)**t. Cauchy's integral over z = exp(-s / c)
    is taken along a parabola around the cut, through the saddle of each t, where its terms don't cancel.
    """
    t = np.append(t, t[-1] + 1).astype(np.float64)
    low, high = np.full(len(t), -7.0), np.full(len(t), np.log(40.0 * c))
    for _ in range(50):  # the saddle: 1 = t d (1 - q)**(d - 1) q / (c (1 - (1 - q)**d)), q = exp(-s / c)
        mid = (low + high) / 2
        q = np.exp(-np.exp(mid) / c)
        falls = t * d * (1 - q) ** (d - 1) * q < c * (1 - (1 - q) ** d)
        low, high = np.where(falls, low, mid), np.where(falls, mid, high)
    s0 = np.maximum(np.exp(high), 4.0)[:, None]
    y = np.linspace(0, 1, 129)[None, :] * np.sqrt(45 / s0)
    z = s0 * (1 + 1j * y) ** 2
    f = z + t[:, None] * np.log(1 - (-np.expm1(-z / c)) ** d)
    peak = f.real.max(1, keepdims=True)
    terms = (np.exp(f - peak) * (1 + 1j * y)).real
    log = np.log((terms.sum(1) - terms[:, 0] / 2) * s0[:, 0] * y[:, 1]) + peak[:, 0]
    return np.diff(log) - np.log(t[1:] * d)


def stirling_ratios(cs: list[int], d: float):
    """For each of these ascending c a function of an array of consecutive t < c: logs of S(c, t + 1) / S(c, t)."""
    row = np.zeros(1)  # log S(n, t), t = 1..n
    n = 1
    for c in cs:
        while n < min(c, RECURRENCE):
            t = np.arange(1, n + 1)
            row = np.logaddexp(np.append(np.log(n - t * d) + row, -np.inf), np.append(-np.inf, row))
            n += 1
        if c <= RECURRENCE:
            steps = np.diff(row)
            yield c, lambda t, steps=steps: steps[t - 1]
        else:
            yield c, lambda t, c=c: ratios(c, t, d)


def draw(c: int, ratio, p: np.ndarray, strength: np.ndarray, d: float, u: np.ndarray) -> np.ndarray:
    """Table counts at the quantiles u of their conditional: weight S(c, t) * product of p * (strength + d * k), k < t.

    Counts are gone through in blocks, until what is left weighs nothing in double precision.
    """
    log, at, width = [np.zeros((len(p), 1))], 1, 16
    while at < c:
        t = np.arange(at, min(c, at + width))
        step = np.log(p[:, None] * (strength[:, None] + d * t)) + ratio(t)
        log.append(np.cumsum(step, 1) + log[-1][:, -1:])
        at, width = int(t[-1]) + 1, min(256, 2 * width)
        most = np.max([x.max(1) for x in log], 0)
        if ((step[:, -1] < -0.7) & (log[-1][:, -1] < most - 40)).all():
            break
    log = np.concatenate(log, 1)
    weights = np.cumsum(np.exp(log - log.max(1, keepdims=True)), 1)
    return 1 + (weights[:, :-1] < u[:, None] * weights[:, -1:]).sum(1)


def seat(c: np.ndarray, t: np.ndarray, total: np.ndarray, p: np.ndarray, theta: float, d: float, rng) -> np.ndarray:
    """New table counts for c customers of one dish each, given the parent's probability p and the old counts t.

    total: tables of the whole restaurant, this dish's included. All customers of the dish leave and are seated
    anew: the count is drawn from its exact conditional given all other tables, whatever the number of customers.
    """
    out = t.copy()
    many = np.flatnonzero(c > 1)
    if not len(many):
        return out
    many = many[np.argsort(c[many], kind="stable")]
    strength = theta + d * np.maximum(total[many] - t[many], 0).astype(np.float64)
    u, p, cc = rng.random(len(many)), p[many], c[many]
    values, starts = np.unique(cc, return_index=True)
    ends = np.append(starts[1:], len(cc))
    for (value, ratio), a, b in zip(stirling_ratios(values.tolist(), d), starts.tolist(), ends.tolist(), strict=True):
        rows = max(1, 400_000 // min(value, 512))
        for i in range(a, b, rows):
            part = slice(i, min(b, i + rows))
            out[many[part]] = draw(value, ratio, p[part], strength[part], d, u[part])
    return out


def predicted(c, t, tables, customers, parent, theta: float, d: float):
    """Probability of a dish with c customers at t tables, in a restaurant of so many tables and customers."""
    return (c - d * t + (theta + d * tables) * parent) / (theta + customers)


def chunk_row(chunk: int, ids, texts: list[bytes], held: list[bool], share: float) -> dict:
    """A chunk as kept: sizes of its texts, word numbers, the words' hashes, the end's number,
    and the words that have half of that share of its tokens, with their numbers."""
    flat, bounds, words = numbered(texts, lower=True)
    flat, bounds, words = np.insert(flat, bounds[1:], len(words)), bounds + np.arange(len(bounds)), [*words, END]
    hashes = word_hashes(words)
    times = np.bincount(flat, minlength=len(words))
    often = times > max(1, LEAST_SHARE / 2 * len(flat), share / 2 * len(flat))
    return {
        "chunk": chunk, "ids": ids, "held": held, "sizes": np.diff(bounds).astype(np.uint32).tobytes(), "flat": flat.astype(np.uint32).tobytes(), "hashes": hashes.tobytes(), "end": len(words) - 1,
        "often": [{"h": h, "n": x} for h, x in zip(hashes[often].view(np.int64).tolist(), times[often].tolist(), strict=True)], "n": len(flat),
    }


def pairs_of(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk: the ranks of word and context of each distinct pair, by word and context, each token's pair, sizes."""
    sizes = np.frombuffer(row["sizes"], np.uint32).astype(np.int64)
    hashes = np.frombuffer(row["hashes"], np.uint64)
    rank = np.empty(len(hashes), np.int64)
    rank[np.argsort(hashes, kind="stable")] = np.arange(len(hashes))
    tokens = rank[np.frombuffer(row["flat"], np.uint32)]
    before = np.empty(len(tokens), np.int64)
    before[1:] = tokens[:-1]
    before[np.cumsum(sizes) - sizes] = rank[row["end"]]
    before += tokens * len(rank)
    del tokens
    pairs, inverse = np.unique(before, return_inverse=True)
    return pairs // len(rank), pairs % len(rank), inverse.astype(np.int32), sizes


def shard_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """One of n ranges of 64-bit hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def splits_of(kept: DataFrame, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, of the words to split, and over how many buckets.

    A word with a share of all tokens has half of it in chunks where it has half of it, so that counts of those
    chunks alone find it. At most 2 / LEAST_SHARE words, which is the bound of all that is sent by such words.
    """
    total = kept.agg(F.sum("n")).first()[0] or 0
    least = max(LEAST_SHARE, 1 / (PARTS * n_buckets)) / 2 * total
    found = kept.select(F.explode("often").alias("o")).groupBy(F.col("o.h").alias("h")).agg(F.sum("o.n").alias("n")).where(F.col("n") >= least).toPandas().sort_values("h")
    order = np.argsort(found["h"].to_numpy(np.int64).view(np.uint64))
    parts = np.ceil(found["n"].to_numpy(np.float64) / max(1, total) * PARTS * n_buckets).astype(np.int64) + 1
    return found["h"].to_numpy(np.int64).view(np.uint64)[order], parts[order]


def places(hashes: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of these hashes are in the sorted array often, and their places there."""
    at = np.minimum(np.searchsorted(often, hashes), max(0, len(often) - 1))
    found = np.flatnonzero(often[at] == hashes) if len(often) else np.zeros(0, np.int64)
    return found, at[found]


def route(hashes: np.ndarray, word: np.ndarray, before: np.ndarray, n_buckets: int, splits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk's pairs: their order by bucket and word, where a new (bucket, word) begins in it, and these buckets."""
    of_word = shard_of(hashes, n_buckets)
    bucket = of_word[word]
    parts = np.zeros(len(hashes), np.uint64)
    found, at = places(hashes, splits[0])
    parts[found] = splits[1][at]
    many = np.flatnonzero(parts[word])
    part = mix(hashes[before[many]]) % parts[word[many]] + np.uint64(1)
    bucket[many] = shard_of(mix(hashes[word[many]] + part * np.uint64(0x9E3779B97F4A7C15)), n_buckets)
    order = np.argsort(bucket, kind="stable")
    bucket, sorted_word = bucket[order], word[order]
    begins = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (sorted_word[1:] != sorted_word[:-1])))
    return order, begins, bucket[begins]


def sent(row, n_buckets: int, splits):
    """What a chunk sends to each bucket: hashes of its words, how many pairs each has, their contexts and counts."""
    word, before, inverse, sizes = pairs_of(row)
    hashes = np.sort(np.frombuffer(row["hashes"], np.uint64))
    train = ~np.repeat(np.array(row["held"], bool), sizes)
    counts = np.bincount(inverse[train], minlength=len(word)).astype(np.uint32)
    order, begins, bucket = route(hashes, word, before, n_buckets, splits)
    words, per_word = hashes[word[order[begins]]], np.diff(begins, append=len(order)).astype(np.uint32)
    contexts, counts = hashes[before[order]], counts[order]
    edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(begins))
    pair_edges = np.append(begins, len(order))
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        w, p = slice(i, j), slice(pair_edges[i], pair_edges[j])
        yield {"chunk": row["chunk"], "bucket": int(bucket[i]), "a": words[w].tobytes(), "b": per_word[w].tobytes(), "c": contexts[p].tobytes(), "d": counts[p].tobytes()}


def merge_with(often: np.ndarray):
    return lambda pdf: merge(pdf, often)


def merge(pdf: pd.DataFrame, often: np.ndarray) -> pd.DataFrame:
    """One row for a bucket: its words' pairs with summed counts, its contexts, and where each chunk's pairs are."""
    trim()
    pdf = pdf.sort_values("chunk")
    hashes = [np.frombuffer(x, np.uint64) for x in pdf["a"]]
    sizes = [np.frombuffer(x, np.uint32).astype(np.int64) for x in pdf["b"]]
    words, rank = np.unique(np.concatenate(hashes), return_inverse=True)
    contexts, cls = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["c"]]), return_inverse=True)
    pairs, at = np.unique(np.repeat(rank, np.concatenate(sizes)) * len(contexts) + cls, return_inverse=True)
    counts = np.bincount(at, np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["d"]]), len(pairs)).astype(np.int64)
    word, cls = pairs // len(contexts), pairs % len(contexts)
    of_word = np.bincount(word, counts, len(words))
    shared, place = places(words, often)
    own = np.ones(len(words), bool)
    own[shared] = False
    ends = np.cumsum([s.sum() for s in sizes])[:-1]
    maps = [np.diff(m, prepend=0).astype(np.uint32).tobytes() for m in np.split(at, ends)]  # in order, so that steps are small
    return pd.DataFrame(
        {
            "bucket": [int(pdf["bucket"].iloc[0])], "chunks": [pdf["chunk"].tolist()], "maps": [maps], "sizes": [list(pdf["b"])],
            "word": [word.astype(np.uint32).tobytes()], "cls": [cls.astype(np.uint32).tobytes()], "c": [counts.astype(np.uint32).tobytes()],
            "keys": [contexts.tobytes()], "sums": [[int(counts.sum()), int((of_word[own] > 0).sum()), int((counts == 1).sum()), int((counts == 2).sum())]],
            "shared": [shared.astype(np.uint32).tobytes()], "place": [place.astype(np.uint32).tobytes()], "many": [of_word[shared].astype(np.uint32).tobytes()],
        }
    )


MERGED = "bucket long, chunks array<long>, maps array<binary>, sizes array<binary>, word binary, cls binary, c binary, keys binary, sums array<long>, shared binary, place binary, many binary"
CORE = "bucket long, word binary, cls binary, c binary, keys binary, static binary, t binary, root binary, t0 binary, customers long, root_tables long, shared binary, place binary, many binary"


def _columns(row) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(row[x], np.uint32).astype(np.int64) for x in ("word", "cls", "c"))


def core_row(row) -> pd.DataFrame:
    """A merged bucket's pairs met more than once, their contexts, and each word's customers of the other pairs.

    shared: the bucket's words that others have too, place: where these are among all such words, many: their
    customers here (of a merged bucket: their tokens). customers and root_tables count the bucket's own words alone.
    """
    word, cls, c = _columns(row)
    n_words, many = int(word[-1]) + 1, c > 1
    used, at = np.unique(cls[many], return_inverse=True)
    static, root = np.bincount(word, c == 1, n_words), np.bincount(word, c > 0, n_words)
    found = {"word": word[many], "cls": at, "c": c[many], "static": static, "t": np.ones(many.sum()), "root": root > 0}
    found = {k: [v.astype(np.uint32).tobytes()] for k, v in found.items()}
    keys, shared = np.frombuffer(row["keys"], np.uint64)[used].tobytes(), np.frombuffer(row["shared"], np.uint32)
    own = np.ones(n_words, bool)
    own[shared] = False
    return pd.DataFrame({"bucket": [int(row["bucket"])], **found, "keys": [keys], "t0": [b""], "customers": [int(root[own].sum())], "root_tables": [int((root[own] > 0).sum())], "shared": [row["shared"]], "place": [row["place"]], "many": [root[shared].astype(np.uint32).tobytes()]})


def summed(rows: DataFrame, n: int) -> np.ndarray:
    """`many` of the words that buckets share, added up over all: n numbers."""

    def run(frames):
        for pdf in frames:
            for _, row in pdf.iterrows():
                yield pd.DataFrame({"place": np.frombuffer(row["place"], np.uint32).astype(np.int64), "many": np.frombuffer(row["many"], np.uint32).astype(np.int64)})

    found = rows.select("place", "many").mapInPandas(run, "place long, many long").groupBy("place").agg(F.sum("many").alias("many")).toPandas()
    out = np.zeros(n, np.int64)
    out[found["place"].to_numpy(np.int64)] = found["many"]
    return out


def opening(row) -> list[dict]:
    """A merged bucket's tables by context at the start; it asks for the totals of contexts whose seats can change."""
    _, cls, c = _columns(row)
    keys = np.frombuffer(row["keys"], np.uint64)
    seen, moves = np.bincount(cls, c > 0, len(keys)).astype(np.uint32), np.bincount(cls, c > 1, len(keys)) > 0
    return [{"bucket": row["bucket"], "want": want, "keys": keys[at].tobytes(), "x": seen[at].tobytes()} for want, at in ((True, moves), (False, ~moves & (seen > 0)))]


def moved(row) -> list[dict]:
    """A core row's tables by context beyond one for each pair; it asks for their totals."""
    return [{"bucket": row["bucket"], "want": True, "keys": row["keys"], "x": added(row).tobytes()}]


def added(row) -> np.ndarray:
    """Tables of a core row's contexts beyond one for each pair."""
    cls, t = np.frombuffer(row["cls"], np.uint32), np.frombuffer(row["t"], np.uint32).astype(np.int64)
    return np.bincount(cls, t - 1, len(row["keys"]) // 8).astype(np.uint32)


def _each(make):
    def run(frames):
        for pdf in frames:
            for _, row in pdf.iterrows():
                yield pd.DataFrame(make(row))

    return run


def totals(sources: list, n_shards: int) -> DataFrame:
    """Sums by key over all messages, sent back in order to the buckets that want them: bucket, shard, keys, x.

    sources: tables, each with a function from a row to its messages (bucket, want, keys, x), which is called where
    messages are split by shard, so that a task has one Python worker and messages cross to Python once.
    x: numbers of four bytes, one row after another, each as long as keys. Keys are sorted, so shards are in order too.
    Each shard also keeps its sums: a row with its keys for bucket -1; the keys of answers are left out.
    """

    def pieces(message: dict) -> pd.DataFrame:
        keys, out = np.frombuffer(message["keys"], np.uint64), []
        if len(keys):
            x, shard = np.frombuffer(message["x"], np.uint32).reshape(-1, len(keys)), shard_of(keys, n_shards)
            starts = np.searchsorted(shard, np.arange(n_shards + 1))
            for s in np.unique(shard).tolist():
                at = slice(starts[s], starts[s + 1])
                out.append((s, message["bucket"], message["want"], keys[at].tobytes(), x[:, at].tobytes()))
        return pd.DataFrame(out, columns=["shard", "bucket", "want", "keys", "x"])

    def split(make):
        def run(frames):
            for pdf in frames:
                for _, row in pdf.iterrows():
                    yield from map(pieces, make(row))
            trim()

        return run

    def add(pdf):
        trim()
        keys = [np.frombuffer(k, np.uint64) for k in pdf["keys"]]
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        places = np.split(at, np.cumsum([len(k) for k in keys])[:-1])
        sums = np.zeros((max(len(v) // (4 * len(k)) for v, k in zip(pdf["x"], keys, strict=True)), len(found)), np.uint32)
        for p, v in zip(places, pdf["x"], strict=True):  # a message's own keys are distinct
            sums[:, p] += np.frombuffer(v, np.uint32).reshape(-1, len(p))
        back = [(-1, found.tobytes(), sums.tobytes())] + [(b, b"", sums[:, p].tobytes()) for b, want, p in zip(pdf["bucket"], pdf["want"], places, strict=True) if want]
        return pd.DataFrame(back, columns=["bucket", "keys", "x"]).assign(shard=int(pdf["shard"].iloc[0]))

    rows = None
    for table, make in sources:
        found = table.mapInPandas(split(make), "shard long, bucket long, want boolean, keys binary, x binary")
        rows = found if rows is None else rows.unionByName(found)
    return rows.repartition(n_shards, "shard").groupBy("shard").applyInPandas(add, "bucket long, shard long, keys binary, x binary")


def _answer(back: pd.DataFrame, width: int) -> np.ndarray:
    """The shards' answers to a bucket, joined: one row for each of the numbers asked for."""
    parts = [np.frombuffer(x, np.uint32).reshape(width, -1) for x in back.sort_values("shard")["x"]]
    return np.concatenate([np.zeros((width, 0), np.uint32), *parts], axis=1).astype(np.int64)


class Bucket:
    """A bucket's seats: of all its pairs, or of those met more than once beside fixed customers of each word.

    cls: numbers of two or four bytes, the place of a pair's context in the totals given.
    """

    def __init__(self, row, setting: dict):
        self.number, self.setting = int(row["bucket"]), setting
        self.word = np.frombuffer(row["word"], np.uint32).astype(np.int64)
        self.c = np.frombuffer(row["c"], np.uint32).astype(np.int64)
        self.cls = np.frombuffer(row["cls"], np.uint16 if len(row["cls"]) < len(row["c"]) else np.uint32).astype(np.int64)
        static = row.get("static")
        self.n_words = len(static) // 4 if static is not None else int(self.word[-1]) + 1 if len(self.word) else 0
        self.static = np.zeros(self.n_words, np.int64) if static is None else np.frombuffer(static, np.uint32).astype(np.int64)
        self.t = (self.c > 0).astype(np.int64)
        self.shared, self.place = (np.frombuffer(row.get(x, b""), np.uint32).astype(np.int64) for x in ("shared", "place"))
        self.own = np.ones(self.n_words, bool)
        self.own[self.shared] = False
        self.count()
        self.root_t = (self.customers > 0).astype(np.int64)
        self.base = 1.0 / (setting["v"] + 1)

    def count(self):
        self.customers = np.bincount(self.word, self.t, self.n_words).astype(np.int64) + self.static

    def root_p(self, state: dict) -> np.ndarray:
        s = self.setting
        customers, root_t = self.customers.copy(), self.root_t.copy()
        if len(self.shared):
            customers[self.shared], root_t[self.shared] = state["shared"][0][self.place], state["shared"][1][self.place]
        return (customers - s["d1"] * root_t + (s["theta1"] + s["d1"] * state["root_tables"]) * self.base) / (s["theta1"] + state["customers"])

    def sweep(self, k: int, state: dict) -> None:
        s, rng = self.setting, np.random.default_rng([11, self.number, k])
        p = self.root_p(state)
        self.t = seat(self.c, self.t, state["tables"][self.cls], p[self.word], s["theta2"], s["d2"], rng)
        self.count()
        at = np.flatnonzero((self.customers > 0) & self.own)
        total = np.full(len(at), state["root_tables"], np.float64)
        self.root_t[at] = seat(self.customers[at], self.root_t[at], total, np.full(len(at), self.base), s["theta1"], s["d1"], rng)

    def predict(self, state: dict) -> np.ndarray:
        s = self.setting
        return predicted(self.c, self.t, state["tables"][self.cls], s["by_class"][self.cls], self.root_p(state)[self.word], s["theta2"], s["d2"])


def sweep_with(setting: dict, k: int, state: dict):
    """A function that seats a core row anew in sweep k, given the shards' answers."""

    def sweep(one: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        trim()
        row = one.iloc[0].to_dict()
        tables = _answer(back, 1)[0]
        if k:
            tables = tables + np.frombuffer(row["t0"], np.uint32)
        else:
            row["t0"] = tables.astype(np.uint32).tobytes()
        b = Bucket(row, setting)
        b.t = np.frombuffer(row["t"], np.uint32).astype(np.int64)
        b.root_t = np.frombuffer(row["root"], np.uint32).astype(np.int64)
        b.count()
        b.sweep(k, state | {"tables": tables})
        row |= {"t": b.t.astype(np.uint32).tobytes(), "root": b.root_t.astype(np.uint32).tobytes(), "customers": int(b.customers[b.own].sum()), "root_tables": int(b.root_t[b.own].sum()), "many": b.customers[b.shared].astype(np.uint32).tobytes()}
        return pd.DataFrame([row])

    return sweep


def _sums(rows: DataFrame, name: str) -> np.ndarray:
    """An array column summed element by element."""
    found = rows.select(F.posexplode(name).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(1 + max((r.i for r in found), default=-1), np.float64)
    for r in found:
        out[r.i] = r.x
    return out


def fitted(kept: DataFrame, n_buckets: int, splits, theta: tuple[float, float]) -> tuple[DataFrame, int, int, dict]:
    """What each chunk needs to score its texts, from buckets and shards; all tokens and words learnt; the setting."""

    def send(frames):
        for pdf in frames:
            for _, row in pdf.iterrows():
                trim()
                yield pd.DataFrame(sent(row, n_buckets, splits))

    pairs = kept.drop("ids", "often").mapInPandas(send, "chunk long, bucket long, a binary, b binary, c binary, d binary")
    merged = settle(pairs.repartition(n_buckets, "bucket").groupBy("bucket").applyInPandas(merge_with(splits[0]), MERGED), "merged")
    n, v, n1, n2 = [*_sums(merged, "sums"), 0, 0, 0, 0][:4]
    tokens = summed(merged, len(splits[0]))  # of the words that buckets share
    v += int((tokens > 0).sum())
    d = float(np.clip(n1 / max(1, n1 + 2 * n2), 0.05, 0.95))
    setting = {"v": v, "d1": d, "d2": d, "theta1": theta[0], "theta2": theta[1]}
    lean = merged.select("bucket", "word", "cls", "c", "keys", "shared", "place")
    core = settle(lean.mapInPandas(_each(core_row), CORE), "core")
    start = settle(totals([(lean, opening)], n_buckets), "totals")
    ask, cores, states = start.where("bucket >= 0"), [], []
    for k in range(SWEEPS + 1):
        found = core.agg(F.sum("customers"), F.sum("root_tables")).first()
        customers = summed(core, len(splits[0]))
        if k:
            busy, (_, root) = np.flatnonzero(customers), states[-1]["shared"]
            root = np.where(customers > 0, np.maximum(root, 1), 0)
            total = np.full(len(busy), states[-1]["root_tables"])
            root[busy] = seat(customers[busy], np.minimum(root, customers)[busy], total, np.full(len(busy), 1.0 / (v + 1)), theta[0], d, np.random.default_rng([11, k]))
        else:
            root = (customers > 0).astype(np.int64)
        states.append({"customers": float(found[0] or 0) + float(customers.sum()), "root_tables": float(found[1] or 0) + float(root.sum()), "shared": (customers, root)})
        cores.append(core)
        if k == SWEEPS:
            break
        core = settle(core.repartition(n_buckets, "bucket").groupBy("bucket").cogroup(ask.repartition(n_buckets, "bucket").groupBy("bucket")).applyInPandas(sweep_with(setting, k, states[k]), CORE), "core")
        if k <= BURN_IN:
            drop(cores[k])
        ask = totals([(core.select("bucket", "cls", "keys", "t"), moved)], n_buckets).where("bucket >= 0")

    # every chunk learns of its words, as contexts, the tables at the start and what each used sweep has added
    used = range(BURN_IN + 1, SWEEPS + 1)

    def message(j: int | None, want: bool):
        def make(row):
            x = np.zeros((1 + len(used), len(row["keys"]) // 8), np.uint32)
            if j == 0:
                x[0] = np.frombuffer(row["x"], np.uint32)
            elif j:
                x[j] = added(row)
            return [{"bucket": row["bucket"], "want": want, "keys": row["keys"], "x": x.tobytes()}]

        return make

    def wanted(row):
        return message(None, True)({"bucket": row["chunk"], "keys": np.sort(np.frombuffer(row["hashes"], np.uint64)).tobytes()})

    asked, given = [(start.where("bucket = -1"), message(0, False)), (kept.select("chunk", "hashes"), wanted)], None
    for j, k in enumerate(used):
        asked.append((cores[k].select("bucket", "cls", "keys", "t"), message(j + 1, False)))
        seats = cores[k].select("bucket", F.lit(k).alias("k"), "t", "root")
        given = seats if given is None else given.unionByName(seats)

    def answer(one, back):
        """For each chunk: its pairs' customers and tables, and its words' customers and probabilities in the root."""
        trim()
        row = one.iloc[0].to_dict()
        b = Bucket(row, setting)
        many, seated, parents = b.c > 1, [], []
        for k in used:
            seats = back[back["k"] == k].iloc[0]
            b.t = (b.c > 0).astype(np.int64)
            b.t[many] = np.frombuffer(seats["t"], np.uint32)
            b.root_t = np.frombuffer(seats["root"], np.uint32).astype(np.int64)
            b.count()
            seated.append(b.t)
            parents.append(b.root_p(states[k]))
        of_word = np.bincount(b.word, b.c, b.n_words).astype(np.uint32)
        of_word[b.shared] = tokens[b.place]
        out = []
        for chunk, at, sizes in zip(row["chunks"], row["maps"], row["sizes"], strict=True):
            at, of = np.cumsum(np.frombuffer(at, np.uint32)), np.frombuffer(sizes, np.uint32).astype(np.int64)
            words = b.word[at[np.cumsum(of) - of]]
            low, repeated = np.minimum(b.c[at], 255).astype(np.uint8), at[many[at]]
            tables = np.stack([t[repeated] for t in seated]).astype(np.uint32)
            out.append((chunk, b.number, low.tobytes(), b.c[at[low == 255]].astype(np.uint32).tobytes(), tables.tobytes(), of_word[words].tobytes(), np.stack([p[words] for p in parents]).tobytes(), sizes))
        return pd.DataFrame(out, columns=["chunk", "bucket", "low", "high", "tables", "counts", "parents", "sizes"])

    pieces = merged.select("bucket", "chunks", "maps", "sizes", "word", "cls", "c", "shared", "place").repartition(n_buckets, "bucket").groupBy("bucket").cogroup(given.repartition(n_buckets, "bucket").groupBy("bucket"))
    back = settle(pieces.applyInPandas(answer, "chunk long, bucket long, low binary, high binary, tables binary, counts binary, parents binary, sizes binary"), "back")
    contexts = settle(totals(asked, n_buckets).where("bucket >= 0").select(F.col("bucket").alias("chunk"), "shard", "x"), "contexts")
    for table in (merged, start, *cores[BURN_IN + 1 :]):
        drop(table)
    empty = [F.lit(None).cast("binary").alias(x) for x in ("low", "high", "tables", "counts", "parents", "sizes")]
    return back.withColumn("x", F.lit(None).cast("binary")).unionByName(contexts.select("chunk", F.col("shard").alias("bucket"), *empty, "x")), n, v, setting


def score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", theta: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability of the text).

    held_out: a boolean column; rows where it is true are not learnt from (null counts as false). Tokens: A-Z lowered
    runs without ASCII white space, then one end. The discounts are n1 / (n1 + 2 * n2) of the pairs' counts, kept
    within 0.05 and 0.95. A null or empty text is its end alone; a null id is kept; repeated rows count and are scored
    each; other columns are ignored; an empty table gives no rows. With nothing to learn from every word is unknown.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(1, -(-size // CHUNK))

    def chunks(batches):
        begin()
        first = TaskContext.get().partitionId() << 24
        ids, texts, held, size, n = [], [], [], 0, 0
        for batch in batches:
            schema = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(batch.column(0).type)), ("held", pa.list_(pa.bool_())), *[(x, pa.binary()) for x in ("sizes", "flat", "hashes")], ("end", pa.int64()), ("often", pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int64())]))), ("n", pa.int64())])
            for i, t, h in zip(batch.column(0).to_pylist(), raw(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t)
                held.append(h)
                size += len(t) + 8
                if size >= CHUNK:
                    yield pa.RecordBatch.from_pylist([chunk_row(first + n, ids, texts, held, 1 / (PARTS * n_buckets))], schema=schema)
                    ids, texts, held, size, n = [], [], [], 0, n + 1
        if texts:
            yield pa.RecordBatch.from_pylist([chunk_row(first + n, ids, texts, held, 1 / (PARTS * n_buckets))], schema=schema)

    kept = settle(docs.mapInArrow(chunks, f"chunk long, ids array<{kind}>, held array<boolean>, sizes binary, flat binary, hashes binary, end long, often array<struct<h:long,n:long>>, n long"), "chunks")
    splits = splits_of(kept, n_buckets)
    with heavy_rows(docs.sparkSession):
        back, n, v, setting = fitted(kept, n_buckets, splits, theta)

    used = SWEEPS - BURN_IN

    def scored(chunk: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        trim()
        row, asked = chunk.iloc[0], back["x"].notna()
        tables = _answer(back[asked].rename(columns={"bucket": "shard"}), 1 + used)
        back = back[~asked].sort_values("bucket")
        word, before, tokens, sizes = pairs_of(row)
        hashes = np.sort(np.frombuffer(row["hashes"], np.uint64))
        order, begins, _ = route(hashes, word, before, n_buckets, splits)
        count, at = np.zeros(len(hashes), np.int64), word[order[begins]]  # of words, as ranked
        count[at] = np.frombuffer(b"".join(back["counts"]), np.uint32)
        low = np.frombuffer(b"".join(back["low"]), np.uint8)
        c = low.astype(np.int64)
        c[low == 255] = np.frombuffer(b"".join(back["high"]), np.uint32)
        seated = np.concatenate([np.frombuffer(x, np.uint32).reshape(used, -1) for x in back["tables"]], 1)
        parents = np.zeros((used, len(hashes)))
        parents[:, at] = np.concatenate([np.frombuffer(x, np.float64).reshape(used, -1) for x in back["parents"]], 1)
        log, ends = np.empty(len(word)), np.append(0, np.cumsum(c > 1))
        for i in range(0, len(word), RUN):  # pairs in runs, so that what is worked out beside them stays small
            part = slice(i, i + RUN)
            some, of_word, of_context, p = c[part], word[order[part]], before[order[part]], 0.0
            many = slice(ends[i], ends[min(i + RUN, len(word))])
            for k in range(used):
                t = (some > 0).astype(np.int64)
                t[some > 1] = seated[k, many]
                p = p + predicted(some, t, tables[0][of_context] + tables[1 + k][of_context], count[of_context], parents[k][of_word], setting["theta2"], setting["d2"]) / used
            log[order[part]] = np.log10(p)
        del low, c, seated, parents, tables, before, order, ends
        base, starts = np.log10((count + 0.5) / (n + 0.5 * (v + 1))), np.cumsum(sizes) - sizes

        def per_doc(x):
            return np.add.reduceat(x[tokens], starts)

        ids = list(row["ids"])
        return pd.DataFrame({"id": pd.Series(ids, dtype="Int64" if kind in ("bigint", "int") else "object"), "held_out": list(row["held"]), "n_tokens": sizes, "n_known": per_doc((count > 0)[word].astype(np.int64)), "train_tokens": np.full(len(sizes), int(n)), "base_score": per_doc(base[word]), "score": per_doc(log)})

    with heavy_rows(docs.sparkSession):
        pairs = kept.drop("often", "n").repartition(n_buckets, "chunk").groupBy("chunk").cogroup(back.repartition(n_buckets, "chunk").groupBy("chunk"))
        out = settle(pairs.applyInPandas(scored, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"), "scores")
    drop(kept)
    drop(back)
    return out.withColumnRenamed("id", id_col)
