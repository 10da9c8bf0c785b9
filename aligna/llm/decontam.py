"""Benchmark decontamination by a broadcast set of n-grams."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aligna.llm.common import carried

#: A-Z to a-z; every ASCII character that is neither a digit nor a letter to a space; UTF-8 beyond ASCII stays.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes) -> list[bytes]:
    """Lower-cased runs of digits, letters and characters beyond ASCII."""
    return text.translate(TABLE).split()


class Windows:
    """The windows of all items as sorted hashes of word numbers, for each window length that occurs."""

    def __init__(self, items: list[tuple[object, bytes]], n: int):
        self.number: dict[bytes, int] = {}
        grams: dict[int, dict[tuple, set[int]]] = {}
        self.items: list = []
        for key, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words(text)]
            if not ids:
                continue
            k = len(self.items)
            self.items.append(str(key) if key is not None else "null")
            size = min(n, len(ids))
            for i in range(len(ids) - size + 1):
                grams.setdefault(size, {}).setdefault(tuple(ids[i : i + size]), set()).add(k)
        self.by_size = []
        for size, found in sorted(grams.items()):
            gram = np.array(list(found), np.int64).reshape(len(found), size)
            h = self.hashes(gram.ravel(), size)[::size] if len(found) else np.zeros(0, np.uint64)
            order = np.argsort(h, kind="stable")
            self.by_size.append((size, h[order], gram[order], [sorted(v) for v in np.array([*found.values(), None], object)[:-1][order]]))

    @staticmethod
    def hashes(ids: np.ndarray, size: int) -> np.ndarray:
        """Hash of each window of that many numbers."""
        total = np.zeros(len(ids) - size + 1, np.uint64)
        for k in range(size):
            total = total * MULTIPLIER + ids[k : k + len(total)].astype(np.uint64)
        return total

    def scan(self, tokens: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words lie in an occurrence of a window, and the numbers of the items that have one."""
        ids = np.fromiter((self.number.get(w, 0) for w in tokens), np.int64, len(tokens))
        hit, found = np.zeros(len(ids) + 1, np.int64), set()
        outside = np.concatenate([[0], np.cumsum(ids == 0)])
        for size, hashes, grams, owners in self.by_size:
            if len(ids) < size:
                continue
            at = np.flatnonzero(outside[size:] == outside[:-size])  # windows of benchmark words alone
            if not len(at):
                continue
            h = self.hashes(ids, size)[at]
            lo = np.searchsorted(hashes, h)
            ok = lo < len(hashes)
            at, h, lo = at[ok], h[ok], lo[ok]
            ok = hashes[lo] == h
            for i, j, x in zip(at[ok].tolist(), lo[ok].tolist(), h[ok], strict=True):
                while j < len(hashes) and hashes[j] == x:  # equal hashes stand together; the words decide
                    if (grams[j] == ids[i : i + size]).all():
                        hit[i] += 1
                        hit[i + size] -= 1
                        found.update(owners[j])
                    j += 1
        return np.cumsum(hit)[:-1] > 0, found


def _windows(benchmark: DataFrame, item_col: str, text_col: str, n: int, most_bytes: int) -> Windows:
    size = benchmark.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"benchmark holds {size} bytes of text, over the {most_bytes} that may be broadcast; pass its parts one after the other")
    rows = benchmark.select(F.col(item_col).alias("k"), F.col(text_col).alias("t")).toLocalIterator()
    return Windows([(r.k, (r.t or "").encode()) for r in rows], n)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 10, most_bytes: int = 64 << 20) -> DataFrame:
    """docs with n_words, n_hit, items (ids as strings, sorted) and clean_text (without the hit spans).

    A window is n consecutive words of an item; an item of fewer words is one window, one without words none. Every
    word inside any occurrence of a window is hit. The benchmark is broadcast; its size is checked first and a
    larger one is refused, never cut. Map-only over docs. A null text has no words and clean_text null; null item ids
    count as the text 'null'; repeated rows give a row each; an empty benchmark hits nothing. All columns of docs
    stay; those by a new one's name are replaced.
    """
    windows = docs.sparkSession.sparkContext.broadcast(_windows(benchmark, item_col, item_text_col, n, most_bytes))

    def run(texts):
        w, out = windows.value, []
        for text in texts:
            tokens = words(text)
            hit, found = w.scan(tokens)
            out.append((len(tokens), int(hit.sum()), sorted(w.items[k] for k in found), (cut(text, hit) if found else text).decode()))
        return list(zip(*out, strict=True))

    out = carried(docs, text_col, run, [("n_words", "long", pa.int64()), ("n_hit", "long", pa.int64()), ("items", "array<string>", pa.list_(pa.string())), ("clean_text", "string", pa.string())])
    if text_col in out.columns:
        out = out.withColumn("clean_text", F.when(F.col(text_col).isNotNull(), F.col("clean_text")))
    return out


def cut(text: bytes, hit: np.ndarray) -> bytes:
    """The text without its hit words and what stands between neighbouring ones."""
    out, last, inside = [], 0, False
    for m, h in zip(WORD.finditer(text.translate(TABLE)), hit, strict=True):
        if h and not inside:
            out.append(text[last : m.start()])
        if h:
            last = m.end()
        inside = bool(h)
    return b"".join([*out, text[last:]])


def items_digest():
    """Column: lower-case hex SHA-256 of the sorted item ids, comma-joined."""
    return F.sha2(F.concat_ws(",", "items"), 256)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
