"""Token counts with a whole-token shortcut."""

from __future__ import annotations

import gc
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aligna.llm.common import KEPT, begin, raw

#: Fixed value: the published split pattern of this byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
UNEVEN = re.compile(r"\s | \s|^ | $")
EVEN = re.compile(r"(?<=\S)(?= \S)")
LETTERS = re.compile(" [A-Za-zÀ-ÖØ-öø-ÿ]+")


def proven_single(path: str) -> frozenset[str]:
    """The vocabulary strings that, alone, are one pre-token and encode as one token."""
    import regex
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(path)
    pattern, specials = regex.compile(PATTERN), {t.content for t in tk.get_added_tokens_decoder().values()}
    texts = {tk.decode([i], skip_special_tokens=False) for i in range(tk.get_vocab_size())}
    texts = [t for t in texts if t and "�" not in t and t not in specials and pattern.fullmatch(t)]
    texts = [t for t in texts if len(pattern.findall(t)) == 1]
    return frozenset(t for t, e in zip(texts, tk.encode_batch_fast(texts, add_special_tokens=False), strict=True) if len(e.ids) == 1)


class Counter:
    """Counts tokens piece by piece.

    A text is cut before each lone space between two characters that aren't white space; no pre-token crosses
    such a place, and nothing before it looks past it. Pieces are counted once and kept in a bounded cache.
    """

    MOST, MOST_TOKENS = 150_000, 400_000

    def __init__(self, path: str, single: frozenset[str]):
        import regex
        from tokenizers import Tokenizer

        self.tk, self.single = Tokenizer.from_file(path), single
        self.find = regex.compile(PATTERN).findall
        specials = sorted((t.content for t in self.tk.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.starts = np.zeros(self.tk.get_vocab_size(with_added_tokens=True) + 1, bool)
        for token, i in self.tk.get_vocab(with_added_tokens=True).items():
            self.starts[i] = token.startswith("Ġ")
        self.pieces: dict[str, int] = {}
        self.merged: dict[str, int] = {}

    def _merge(self, tokens: list[str]) -> dict[str, int]:
        """Merge-encoded lengths of pre-tokens that are not proven single."""
        out = {}
        words = [t for t in tokens if LETTERS.fullmatch(t)]
        rest = [t for t in tokens if not LETTERS.fullmatch(t)]
        for k in range(0, len(words), 1000):
            part = words[k : k + 1000]
            ids = np.array(self.tk.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids)
            first = np.flatnonzero(self.starts[ids])
            if len(first) == len(part) and first[0] == 0:
                out.update(zip(part, np.diff(np.append(first, len(ids))).tolist(), strict=True))
            else:
                rest += part
        out.update((t, len(e.ids)) for t, e in zip(rest, self.tk.encode_batch_fast(rest, add_special_tokens=False), strict=True))
        return out

    def _learn(self, missing: list[str]) -> None:
        single, merged, find = self.single, self.merged, self.find
        if len(merged) + len(missing) > self.MOST_TOKENS:
            merged = self.merged = {}
        found = [find(p) for p in missing]
        merged.update(self._merge(list(set(chain.from_iterable(found)).difference(single, merged))))
        length = merged.get  # a pre-token that isn't there is proven to be one token
        self.pieces.update((p, sum([length(t, 1) for t in ts])) for p, ts in zip(missing, found, strict=True))

    def _cut(self, text: str) -> list[str]:
        if UNEVEN.search(text):
            return EVEN.split(text)
        first, *more = text.split(" ")
        return [first, *[" " + p for p in more]]

    def count(self, docs: list[bytes]) -> list[int]:
        parts, extra = [], []
        for d in docs:
            text, n = d.decode(), 0
            if self.special and "<|" in text and self.special.search(text):
                texts = self.special.split(text)
                n = len(texts) - 1
                parts.append([p for t in texts for p in self._cut(t)])
            else:
                parts.append(self._cut(text))
            extra.append(n)
        seen = self.pieces
        missing = (every := set(chain.from_iterable(parts))).difference(seen)
        if missing:
            if len(seen) + len(missing) > self.MOST:
                self.pieces, missing = {}, every
            gc.disable()  # many lists live here for a moment, none in a cycle
            try:
                self._learn(list(missing))
            finally:
                gc.enable()
            seen = self.pieces
        return [n + sum(map(seen.__getitem__, ps)) for n, ps in zip(extra, parts, strict=True)]


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit (n_tokens > limit), as the tokenizer counts the whole text.

    Map-only. Pre-tokens proven to be one token are counted directly; the others are merged once and remembered.
    Null and empty texts have 0 bytes and tokens; a null id is kept; repeated rows give a row each; other columns are
    ignored; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    single = docs.sparkSession.sparkContext.broadcast(proven_single(tokenizer))  # at most the vocabulary

    def run(batches):
        begin("tokens")
        if "tokens" not in KEPT or KEPT["tokens"][0] != tokenizer:
            KEPT["tokens"] = tokenizer, Counter(tokenizer, single.value)
        counter = KEPT["tokens"][1]
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                texts = raw(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, texts), pa.int64()), pa.array(counter.count(texts), pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    out = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
