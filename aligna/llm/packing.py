"""Sum-of-squares online packing of token sequences."""

from __future__ import annotations

import gc
import itertools
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from aligna.llm.common import KEPT, begin, raw

SCHEMA = "start long, length long, ids binary, doc_tokens long, sequence_id long, `offset` long"
#: How this tokenizer normalises and splits a text, as its file states it.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: The same split for lower-cased text of the 191 visible characters up to U+00FF, and line ends.
SHORT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\na-zªµºß-öø-ÿ0-9²³¹¼½¾]+|\n")
SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")
#: A chunk with any other character.
WIDE = re.compile("[^!-~¡-ÿ]")


def byte_marks() -> list[str]:
    """The visible character that stands for each byte in a byte-level vocabulary; a space and a line end stay."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    marks, more = [], 256
    for b in range(256):
        marks.append(chr(b if b in own else more))
        more += b not in own
    marks[10], marks[32] = "\n", " "
    return marks


class Encoder:
    """Token ids of whole texts, by white-space separated chunk.

    The tokenizer drops white space and no pre-token crosses it, so the ids of a text are those of its chunks (split
    at ASCII white space) end to end. Chunks are kept in two generations of bounded size: when the young one is full
    it becomes the old one, and what is met again moves up, so that frequent chunks are never learnt anew. Chunks of
    visible characters up to U+00FF, which NFC leaves as they are, are split here and merged by the library's model
    alone, many at once, and cut where pre-tokens end; others, and all of a tokenizer that splits otherwise, go
    through the library whole.
    """

    MOST, RUN = 400_000, 2000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tk = Tokenizer.from_file(path)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.ends = np.zeros(self.tk.get_vocab_size(with_added_tokens=True) + 1, bool)
        for token, i in self.tk.get_vocab(with_added_tokens=True).items():
            self.ends[i] = token.endswith("</w>")
        self.ends[-1] = True  # beyond the vocabulary: stands before the first token
        plan = json.loads(self.tk.to_str())
        splits = (plan["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        self.known = (plan["normalizer"] or {}).get("normalizers") == NORMALIZER and splits[0].get("pattern") == {"Regex": SPLIT} and [x["type"] for x in splits] == ["Split", "ByteLevel"]
        plan |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.model = Tokenizer.from_str(json.dumps(plan))
        self.model.model._resize_cache(0)  # chunks kept here come by once
        self.marks = "".join(byte_marks())
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tk.get_added_tokens_decoder().values()) or "(?!)")

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tk.encode_batch_fast(texts, add_special_tokens=False)]

    def _merged(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of chunks whose pre-tokens SHORT finds."""
        tokens = SHORT.findall(b"\n".join([*chunks, b""]).decode().lower())
        at = np.array([i for i, t in enumerate(tokens) if t == "\n"])
        n = np.diff(at, prepend=-1) - 1  # pre-tokens of each chunk
        text = " ".join(tokens).encode().decode("latin-1").translate(self.marks)
        ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        last = np.flatnonzero(self.ends[np.concatenate([[len(self.ends) - 1], ids])])
        if len(last) != 1 + int(n.sum()) or last[-1] != len(ids):  # a byte the vocabulary lacks
            return self._whole([c.decode() for c in chunks])
        cut, whole = [0, *(4 * last[np.cumsum(n)]).tolist()], ids.tobytes()
        return [whole[a:b] for a, b in itertools.pairwise(cut)]

    def _learn(self, missing: list[bytes]) -> None:
        """Ids of new chunks, into the young generation."""
        wide = set(missing)
        if self.known:
            lines = b"\n".join(missing).decode()
            if WIDE.search(lines.replace("\n", "")) is None and self.special.search(lines) is None:
                wide = set()
            else:
                wide = {c for c in missing if WIDE.search(t := c.decode()) or self.special.search(t)}
        short = [c for c in missing if c not in wide] if wide else missing
        for k in range(0, len(short), self.RUN):
            part = short[k : k + self.RUN]
            self.young.update(zip(part, self._merged(part), strict=True))
        if wide:
            self.young.update(zip(wide, self._whole([c.decode() for c in wide]), strict=True))

    def _ids(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of distinct chunks."""
        if len(self.young) > self.MOST:
            self.old, self.young = self.young, {}
        young, older = self.young, self.old.get
        ids = list(map(young.get, chunks))
        gaps = [i for i, x in enumerate(ids) if x is None]
        if gaps:
            missing = []
            for i in gaps:
                x = older(word := chunks[i])
                if x is None:
                    missing.append(word)
                else:
                    young[word] = x
            self._learn(missing)
            for i in gaps:
                ids[i] = young[chunks[i]]
        return ids

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Little-endian uint32 ids of each text; null counts as empty."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        every = split.flatten().dictionary_encode()
        names, at = every.dictionary, every.indices.to_numpy()
        bounds = split.offsets.to_numpy()
        places = np.frombuffer(names.buffers()[1], np.int32)[names.offset : names.offset + len(names) + 1].tolist()
        data = (names.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
        gc.disable()  # many objects live here for a moment, none in a cycle
        try:
            ids = self._ids([data[a:b] for a, b in itertools.pairwise(places)])
        finally:
            gc.enable()
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        flat = np.frombuffer(b"".join(ids), "<u4")
        n = sizes[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        shift = (np.cumsum(sizes) - sizes)[at] - ends[:-1]
        whole = flat[np.repeat(shift, n) + np.arange(ends[-1])].tobytes()
        cut = (4 * ends[bounds - bounds[0]]).tolist()
        return [whole[a:b] for a, b in itertools.pairwise(cut)]


def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    begin("packing")
    if "packing" not in KEPT or KEPT["packing"][0] != path:
        KEPT["packing"] = path, Encoder(path)
    return KEPT["packing"][1]


class SumOfSquares:
    """Online packer of pieces into windows of `size` tokens.

    level[h] counts the open windows filled to h. A piece of s tokens goes to the fill level that makes the
    sum of level[h]**2 least (ties: the fullest window); level 0 opens a window. A full window is given out
    at once. A text longer than a window is cut: its full windows go out, its rest is placed as above. Where a piece
    would open a window, it may be cut at a level that it overflows instead: that window goes out, and the rest opens
    one. The same sum decides, a cut counting `cut` more. A cut opens no more windows than it closes, and levels
    that many windows share make it cheap: so open windows stay within a few for each level, whatever the texts'
    sizes and number, and need no limit.
    finish() joins what is still open by cutting pieces of the emptiest windows into the gaps of the fullest;
    the last one goes out as windows whose lengths are powers of two, which need no padding.
    """

    def __init__(self, size: int, first_id: int = 0, cut: int = 2):
        self.size, self.next_id, self.cut = size, first_id, cut
        self.level = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[list]] = {}
        self.n_open = 0
        self.done: list[tuple] = []

    def _close(self, pieces: list) -> None:
        at = 0
        for key, start, ids, total in pieces:
            self.done.append((key, start, len(ids) // 4, ids, total, self.next_id, at))
            at += len(ids) // 4
        self.next_id += 1

    def choose(self, s: int) -> int:
        """The fill level at which a piece of s tokens fits whole."""
        level, size = self.level, self.size
        h = np.flatnonzero(level[1 : size - s + 1])[::-1] + 1
        least, best = 2 * level[s] + 1 if s < size else 0, 0
        if len(h):
            to = h + s
            cost = 1 - 2 * level[h] + np.where(to < size, 2 * level[to] + 1, 0)
            k = int(cost.argmin())
            if cost[k] <= least:
                best = int(h[k])
        return best

    def choose_cut(self, s: int) -> int:
        """The fill level at which a piece that would open a window is better cut; 0: none."""
        level, size = self.level, self.size
        h = np.flatnonzero(level[size - s + 1 : size]) + size - s + 1
        if not len(h):
            return 0
        cost = 2 - 2 * level[h] + 2 * level[h + s - size] + self.cut
        k = int(cost.argmin())
        return int(h[k]) if cost[k] < 2 * level[s] + 1 else 0

    def add(self, key, ids: bytes) -> None:
        total, start = len(ids) // 4, 0
        while total - start >= self.size:
            self._close([(key, start, ids[4 * start : 4 * (start + self.size)], total)])
            start += self.size
        s = total - start
        if not s:
            return
        h = self.choose(s) or self.choose_cut(s)
        window = []
        if h:
            window = self.open[h].pop()
            self.level[h] -= 1
            self.n_open -= 1
            if h + s >= self.size:
                n = self.size - h
                window.append((key, start, ids[4 * start : 4 * (start + n)], total))
                self._close(window)
                start, s, h, window = start + n, s - n, 0, []
                if not s:
                    return
        window.append((key, start, ids[4 * start :], total))
        self.open.setdefault(h + s, []).append(window)
        self.level[h + s] += 1
        self.n_open += 1

    def _join(self) -> None:
        """Fill the gaps of the fullest open windows from the emptiest; at most one stays open."""
        windows = [(h, w) for h in sorted(self.open, reverse=True) for w in self.open[h]]
        self.open, self.n_open = {}, 0
        self.level[:] = 0
        i, j = 0, len(windows) - 1
        while i < j:
            fill, w = windows[i]
            low, v = windows[j]
            key, start, ids, total = v.pop()
            n = min(self.size - fill, len(ids) // 4)
            w.append((key, start, ids[: 4 * n], total))
            if 4 * n < len(ids):
                v.append((key, start + n, ids[4 * n :], total))
            windows[i], windows[j] = (fill + n, w), (low - n, v)
            if fill + n == self.size:
                self._close(w)
                i += 1
            if not v:
                j -= 1
        for fill, w in windows[i : j + 1]:
            if w:
                self.open[fill] = [w]
                self.level[fill] = self.n_open = 1

    def finish(self) -> None:
        self._join()
        for fill, w in [(h, w) for h, ws in self.open.items() for w in ws]:
            queue = w[::-1]
            while fill:
                want = 1 << (fill.bit_length() - 1)
                fill -= want
                part = []
                while want:
                    key, start, ids, total = queue.pop()
                    n = min(want, len(ids) // 4)
                    part.append((key, start, ids[: 4 * n], total))
                    if 4 * n < len(ids):
                        queue.append((key, start + n, ids[4 * n :], total))
                    want -= n
                self._close(part)
        self.open, self.n_open = {}, 0
        self.level[:] = 0

    def take(self) -> list[tuple]:
        done, self.done = self.done, []
        return done


def runs(texts: pa.Array, most: int = 4 << 20):
    """Bounds of runs of texts of about that many bytes."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        end = min(len(texts), int(np.searchsorted(size, most + (size[start - 1] if start else 0))) + 1)
        yield start, end
        start = end


def pieces(text: bytes, most: int = 4 << 20):
    """A text cut before white space into pieces of about that many bytes."""
    start = 0
    while start < len(text):
        found = SPACE.search(text, start + most)
        end = found.start() if found else len(text)
        yield text[start:end]
        start = end


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, end_id: int = 2) -> DataFrame:
    """Pieces (id, start, length, ids, doc_tokens, sequence_id, offset) of all texts, packed into windows.

    ids: the piece's token ids as little-endian uint32. A text's ids end with end_id. No shuffle: every task packs
    the rows it reads with its own level array and leaves no padding. A very long text is encoded piece by piece.
    Null and empty texts are one piece that holds end_id alone; repeated rows are packed each for itself; a null
    id is kept; other columns are ignored; an empty table gives no rows. Texts are never cut off.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    last = np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc = encoder(tokenizer)
        packer = SumOfSquares(size, TaskContext.get().partitionId() << 40)

        def rows(id_type):
            cols = list(zip(*packer.take(), strict=True)) or [[]] * 7
            kinds = [id_type, pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 3]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for a, b in runs(batch.column(1)):
                texts = batch.column(1).slice(a, b - a)
                if b - a == 1 and texts.nbytes > 8 << 20:
                    ids = [b"".join(enc.encode(pa.array([p.decode()]))[0] for p in pieces(raw(texts)[0]))]
                else:
                    ids = enc.encode(texts)
                for key, x in zip(batch.column(0).slice(a, b - a).to_pylist(), ids, strict=True):
                    packer.add(key, x + last)
                yield rows(id_type)
        if id_type is not None:
            packer.finish()
            yield rows(id_type)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")
