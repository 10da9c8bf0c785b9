"""Statistics of documents, for the quality operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aligna.llm.common import begin, mix, numbered, raw, slices, word_hashes

#: Inputs of the quality models. All are from the text alone.
FEATURES = ["log_words", "word_length", "symbol_share", "digit_share", "upper_share", "mark_share", "dup_line_share", "repeat_share", "unique_share", "line_words", "long_word_share", "one_char_share", "top_word_share", "upper_word_share", "beyond_ascii_share", "bang_share", "bracket_share"]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SYMBOLS = b"#*$%&|<>"


def _count(text: bytes, of: bytes) -> int:
    return len(text) - len(text.translate(None, of))


DIGITS, UPPER, MARKS = b"0123456789", bytes(range(65, 91)), b".,;:!?'\"-()"
CONTINUED, BEYOND = bytes(range(0x80, 0xC0)), bytes(range(0xC0, 0x100))


def repeats(ids: np.ndarray, owner: np.ndarray, size: int, words: np.ndarray) -> np.ndarray:
    """Marks the words in windows of that size which a document has twice or more.

    ids: word numbers of all documents end to end; owner: each word's document; words: a hash of each number.
    Windows are grouped by a 64-bit hash with their document; equal hashes are compared word by word.
    """
    n = len(ids) - size + 1
    mark = np.zeros(len(ids) + 1, np.int64)
    if n > 0:
        at = np.flatnonzero(owner[:n] == owner[size - 1 :])
        h = mix(owner[at].astype(np.uint64) + np.uint64(1))
        hashed = words[ids]
        for k in range(size):
            h = mix(h ^ hashed[at + k]) if k == size - 1 else (h ^ hashed[at + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        order = np.argsort(h, kind="stable")
        hs, at = h[order], at[order]
        same = np.flatnonzero(hs[1:] == hs[:-1])
        if len(same):
            a, b = at[same], at[same + 1]
            equal = owner[a] == owner[b]
            for k in range(size):
                equal &= ids[a + k] == ids[b + k]
            if not equal.all():  # two windows share a hash: group by the words themselves
                keys: dict[tuple, list[int]] = {}
                for i in at.tolist():
                    keys.setdefault((owner[i], *ids[i : i + size].tolist()), []).append(i)
                twice = np.array([i for v in keys.values() if len(v) > 1 for i in v], np.int64)
            else:
                twice = np.union1d(a, b)
            np.add.at(mark, twice, 1)
            np.add.at(mark, twice + size, -1)
    return np.cumsum(mark)[:-1] > 0


def measure(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """COUNTS as int64 and FEATURES as float64, a row for each text."""
    ids, bounds, words = numbered(texts)
    n = np.diff(bounds)
    owner = np.repeat(np.arange(len(texts)), n)
    lengths = np.fromiter((len(w) - _count(w, CONTINUED) for w in words), np.int64, len(words))
    upper = np.fromiter((len(w) > 1 and w.isupper() for w in words), np.int64, len(words))

    def per_doc(values):
        total = np.concatenate([[0], np.cumsum(values)])
        return total[bounds[1:]] - total[bounds[:-1]]

    hashed = word_hashes(words)
    chars = per_doc(lengths[ids])
    repeated = per_doc(repeats(ids, owner, 5, hashed))
    pairs, times = np.unique(owner * max(1, len(words)) + ids, return_counts=True)
    unique = np.bincount(pairs // max(1, len(words)), minlength=len(texts))
    top = np.zeros(len(texts), np.int64)
    np.maximum.at(top, pairs // max(1, len(words)), times)
    symbols, dup, lines, text_chars, shares = [], [], [], [], []
    for t in texts:
        kept = [line for line in t.split(b"\n") if line.strip(b" \t\n\r\x0b\x0c")]
        dup.append(len(kept) - len(set(kept)))
        lines.append(len(kept))
        symbols.append(_count(t, SYMBOLS))
        size = len(t) - _count(t, CONTINUED)
        text_chars.append(size)
        shares.append([_count(t, DIGITS), _count(t, UPPER), _count(t, MARKS), _count(t, BEYOND), t.count(b"!"), _count(t, b"{}[]<>|\\")])
    symbols, dup, lines = (np.array(x, np.int64) for x in (symbols, dup, lines))
    size, words_, lines_ = np.maximum(1, text_chars), np.maximum(1, n), np.maximum(1, lines)
    digit, up, mark, beyond, bang, bracket = np.array(shares, np.float64).reshape(len(texts), 6).T / size
    counts = np.stack([n, chars, symbols, dup, repeated], 1).astype(np.int64).reshape(len(texts), len(COUNTS))
    features = np.stack([np.log1p(n), chars / words_, symbols / size, digit, up, mark, dup / lines_, repeated / words_, unique / words_, n / lines_, per_doc((lengths > 12)[ids]) / words_, per_doc((lengths == 1)[ids]) / words_, top / words_, per_doc(upper[ids]) / words_, beyond, bang, bracket], 1)
    return counts, features.reshape(len(texts), len(FEATURES))


def doc_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, COUNTS, FEATURES, of the whole text. Map-only.

    Words are runs without ASCII white space; word_chars counts their code points; n_symbols the characters
    #*$%&|<>; n_dup_lines lines (with a word) equal to an earlier one; n_repeat_words the words in windows of five
    that the text has twice or more. Null texts count as empty: all zeros. Repeated rows give a row each.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        begin()
        for batch in batches:
            texts = raw(batch.column(1))
            for a, b in slices(texts):
                counts, features = measure(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *[pa.array(c) for c in counts.T], *[pa.array(np.ascontiguousarray(f)) for f in features.T]], names=[id_col, *COUNTS, *FEATURES])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join([*(f"{c} long" for c in COUNTS), *(f"{f} double" for f in FEATURES)]))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, keep=None, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """FEATURES and labels of at most `most` labelled rows: those least by a hash of the id, the same each time.

    `keep`: a column over labels that says which ids may be learnt from. Null labels and ids, and ids with clashing
    labels, are left out.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(id_col).agg(F.min(label).alias("y"), F.max(label).alias("y2")).where("y = y2")
    chosen = (known if keep is None else known.where(keep)).orderBy(F.xxhash64(id_col), id_col).limit(most).select(id_col, "y")
    found = docs.select(id_col, text_col).join(F.broadcast(chosen.select(id_col)), id_col)
    rows = doc_stats(found, id_col, text_col).join(F.broadcast(chosen), id_col).select(F.col(id_col).alias("id"), "y", *FEATURES).toPandas()
    rows = rows.sort_values(["id", *FEATURES]).drop_duplicates("id")
    return rows[FEATURES].to_numpy(np.float64).reshape(-1, len(FEATURES)), rows["y"].to_numpy(np.float64)
