"""Packing token sequences into windows by multiway differencing (Karmarkar and Karp).

A document's ids, an end id last, are cut into whole windows, which stay alone, and a rest cut into pieces of at most
``piece`` ids. The rests of about ``windows_at_once`` windows are packed together: every piece starts as a partition with
one loaded window; the two partitions with the widest spread are merged, the fullest window of one meeting the emptiest of
the other, until one partition is left. Where a window exceeds the capacity, the window count rises by one and the
differencing is done again, so no window is ever over capacity and every id lies in exactly one piece.

Packing happens in the task that tokenizes, a bounded number of ids at a time: nothing is shuffled, memory doesn't grow
with the input, and a task that runs again on another executor gives the same windows. Each task's last batch is packed as
all others; its windows share less than one window of padding for the batch.

Cases: null and empty texts give the end id alone. Very long texts are tokenized whole. Repeated rows are packed each, ties
between pieces of one length keep their order, an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import LOWER, UPPER, slices, text_of

#: Line ends become blanks and A-Z small, as in the vocabulary's own normal form.
_PLAIN = bytes.maketrans(b"\n" + UPPER.encode(), b" " + LOWER.encode())
#: A mark between an ASCII letter or digit and a blank, or the end.
_MARK = re.compile(rb"(?<=[a-z0-9])([.,])(?= |\Z)")
#: Small Latin letters only: one piece in normal form already, so the merges can be asked for directly.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: How byte-level vocabularies write the bytes that are no visible Latin-1 characters (of those that occur in such words).
_BYTES = {b: 290 + b - 128 for b in range(128, 161)} | {173: 323}
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def differencing(lengths: list[int], windows: int) -> list[list[int]]:
    """Indexes of ``lengths`` for each of ``windows`` near-equal windows."""
    if not lengths:
        return []
    last = windows - 1
    partitions = []  # ascending sums per slot; a merged one also has its two parts and which of their slots met
    heap = []
    for i, length in enumerate(lengths):
        sums = np.zeros(windows, np.int64)
        sums[last] = length
        partitions.append((sums, None, None, None))
        heap.append((-length, i))
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        merged = partitions[a][0] + partitions[b][0][::-1]  # both ascend: the fullest of one meets the emptiest of the other
        order = np.argsort(merged, kind="stable")
        merged = merged[order] - merged[order[0]]  # only differences matter
        partitions[a], partitions[b] = (None, *partitions[a][1:]), (None, *partitions[b][1:])
        heapq.heappush(heap, (-int(merged[last]), len(partitions)))
        partitions.append((merged, a, b, order))
    place: dict[int, np.ndarray] = {len(partitions) - 1: np.arange(windows)}  # the window that each slot became
    groups: list[list[int]] = [[] for _ in range(windows)]
    for k in range(len(partitions) - 1, -1, -1):
        _, a, b, order = partitions[k]
        became = place.pop(k)
        if order is None:
            groups[became[last]].append(k)
            continue
        of_a = np.empty_like(became)
        of_a[order] = became
        place[a], place[b] = of_a, of_a[::-1]
    return [sorted(g) for g in groups]


def pack_lengths(lengths: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most ``capacity``; their number rises until none is over it."""
    if not lengths:
        return []
    windows = max(1, -(-sum(lengths) // capacity))
    while True:
        packed = differencing(lengths, windows)
        if max(sum(lengths[i] for i in group) for group in packed) <= capacity:
            return [group for group in packed if group]
        windows += 1


#: The rules of the vocabulary that chunks are cut for: fixed values of its file.
_NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}
]}
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}


def _cut_at_blanks(held: dict) -> bool:
    """Whether a tokenizer file has the rules above, so that chunks between blanks can be tokenized one by one."""
    marks = all(t["content"].startswith("<|") for t in held["added_tokens"])
    model = held["model"]
    plain = not model.get("continuing_subword_prefix") and not model.get("byte_fallback") and not model.get("ignore_merges")
    return marks and plain and held["normalizer"] == _NORMALIZER and held["pre_tokenizer"] == _PRE_TOKENIZER


#: SHA-256 of the one file whose merges of letters are known to be those of ``_letter_merges``; a test holds it to that.
_KNOWN = "53fa9d558ea625daafcd57cd61e7be7b3c7043ea584b22d09575cf5ea9131b0a"


def _letter_merges(vocabulary: dict[str, int]):
    """``encode_ordinary`` of a faster merger for words of letters that end in ``_``, for the known file.

    Merging the neighbours that make the earliest token is the same as applying merge rules in order, where every rule makes
    a token of its own and every token, taken alone, is merged to itself.
    """
    import tiktoken

    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ranks = {}
    for token, rank in vocabulary.items():
        body = bytes(byte[c] for c in token.removesuffix("</w>"))
        if rank < 256:  # the single bytes
            ranks[body] = rank
        elif not re.search(rb"[^a-z\x80-\xff]", body):
            ranks[body + (b"_" if token.endswith("</w>") else b"")] = rank
    return tiktoken.Encoding("letters", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class _Chunks(dict):
    """Ids of chunks, made when first asked for. ``most`` are held, and as many of those held before them, so that chunks
    asked for often stay."""

    def __init__(self, tokenizer, letters, most: int):
        self.encode, self.merge, self.most, self.before = tokenizer.encode, tokenizer.model.tokenize, most, {}
        self.letters = letters

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.before.get(chunk)
        if ids is None:
            if not _LETTERS.fullmatch(chunk):
                ids = array("I", self.encode(chunk.decode(), add_special_tokens=False).ids).tobytes()
            elif self.letters:
                ids = array("I", self.letters(chunk.decode() + "_")).tobytes()
            else:
                ids = array("I", [t.id for t in self.merge(chunk.decode("latin-1").translate(_BYTES))]).tobytes()
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        self[chunk] = ids
        return ids


class Tokens:
    """Ids of whole texts in UTF-8. Blanks, line ends, and a full stop or comma between a letter and a blank part tokens in this
    vocabulary's rules, so the chunks between them are tokenized once and remembered. A file with other rules gets its texts
    whole."""

    def __init__(self, path: str, most: int = 100_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on every core already
        from tokenizers import Tokenizer

        with open(path, "rb") as file:
            text = file.read()
        tokenizer, held = Tokenizer.from_buffer(text), json.loads(text)
        self.whole = None if _cut_at_blanks(held) else tokenizer
        known = hashlib.sha256(text).hexdigest() == _KNOWN
        self.held = _Chunks(tokenizer, _letter_merges(held["model"]["vocab"]) if known else None, most)

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        if self.whole:
            coded = self.whole.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
            return [array("I", e.ids).tobytes() for e in coded]
        ids = self.held.__getitem__
        return [b"".join(map(ids, self._chunks(text))) for text in texts]

    def forget(self) -> None:
        """Drop the chunks held; only the tokenizer stays."""
        self.held.clear()
        self.held.before = {}

    @staticmethod
    def _chunks(text: bytes) -> list[bytes]:
        if b"<|" in text:  # may name a special token, whose case counts
            return text.split(b" ")
        return _MARK.sub(rb" \1", text.translate(_PLAIN)).split(b" ")


@cache
def _tokens(path: str) -> Tokens:
    """One tokenizer for all tasks of a worker. Its chunks go when a task ends, as the worker next serves other stages too."""
    return Tokens(path)


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 1, piece: int = 512, windows_at_once: int = 128
) -> DataFrame:
    """Pieces of every row of ``docs (doc_id, text)``: ``ids`` are little-endian unsigned 32-bit integers, ``start`` counts
    the document's ids before the piece, ``offset`` those before it in its sequence."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(tokenizer)
        end_id = np.array([end], "<u4").tobytes()
        next_id = TaskContext.get().partitionId() << 33
        rests, rest_ids = [], 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        def windows(pieces: list[tuple]) -> list[tuple]:
            nonlocal next_id
            rows = []
            for group in pack_lengths([p[2] for p in pieces], capacity):
                at = 0
                for i in group:
                    rows.append((*pieces[i], next_id, at))
                    at += pieces[i][2]
                next_id += 1
            return rows

        try:
            for batch in slices(batches):
                ready, held = [], 0
                for doc_id, ids in zip(batch[0].to_pylist(), tokens(batch[1].cast(pa.binary()).to_pylist()), strict=True):
                    ids += end_id
                    n = len(ids) // 4
                    whole = n - n % capacity
                    for start in range(0, whole, capacity):
                        ready.append((doc_id, start, capacity, ids[4 * start : 4 * (start + capacity)], n, next_id, 0))
                        next_id += 1
                    for start in range(whole, n, piece):
                        stop = min(n, start + piece)
                        rests.append((doc_id, start, stop - start, ids[4 * start : 4 * stop], n))
                    rest_ids += n - whole
                    held += whole
                    if rest_ids >= capacity * windows_at_once:
                        ready += windows(rests)
                        held, rests, rest_ids = held + rest_ids, [], 0
                    if held >= 1 << 20:
                        yield batch_of(ready)
                        ready, held = [], 0
                if ready:
                    yield batch_of(ready)
            if rests:
                yield batch_of(windows(rests))
        finally:
            tokens.forget()

    rows = docs.select(F.col("doc_id").cast("long"), text_of("text").alias("text"))
    return rows.mapInArrow(task, SCHEMA)
