"""Hierarchical multi-length packing of tokenised documents.

A document's ids are cut into windows of the longest tier; the rest goes to the shortest tier that holds it. Within a
tier the longest rests open windows, and each window's gap is filled from shorter rests, best fit first, the last one
cut to size. Every window is full, so nothing is padded; what is left at a task's end is laid in windows of the
longest tier, and the remainder in sequences whose lengths are powers of two. Sequences of one length are dealt into
step groups of equal token counts.

A task packs its own part of the input with a buffer of bounded size: no shuffle, and no document is held whole with
others beyond that buffer. Ids follow from (task, order in task), both of which a rerun of the task reproduces.

Defined results: a null or empty text is the end id alone; each row is packed, repeated ones too; an empty table gives
no pieces; a null doc_id is carried as null.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import ready

TIERS = (256, 512, 1024, 2048)
END_ID = 1
#: Tokens that a task buffers before it packs them, and chunks that it remembers.
BUFFER_TOKENS, REMEMBERED = 1 << 20, 200_000
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
_UNEVEN = re.compile(r"[^\S \n]|\s\s")


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes, equal to those of the tokenizers file of the same vocabulary.

    A single space or line feed between other characters always starts a token, so a text is the concatenation of its
    space-led chunks, which repeat and are remembered. Texts with other white space are encoded whole.
    """

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        plain = self.plain

        class Known(dict):
            def __init__(self, lead: str):
                self.lead = lead

            def __missing__(self, word: str) -> bytes:
                if len(self) >= REMEMBERED:
                    self.clear()
                out = self[word] = np.array(plain(self.lead + word), "<u4").tobytes()
                return out

        self.first, self.later = Known(""), Known(" ")
        self.feed = np.array(plain("\n"), "<u4").tobytes()

    def whole(self, text: str) -> bytes:
        ids: list[int] = []
        for k, part in enumerate(text.split(SPECIAL)):
            if k:
                ids.append(SPECIAL_ID)
            ids += self.plain(part)
        return np.array(ids, "<u4").tobytes()

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if SPECIAL in text or _UNEVEN.search(text):
            return self.whole(text)
        first, later = self.first, self.later
        out = []
        for line in text.split("\n"):
            words = line.split(" ")
            if len(words) == 1:
                out.append(first[line] if line else b"")
            else:
                one = words.pop(0)
                out.append((first[one] if one else b"") + b"".join(map(later.__getitem__, words)))
        return self.feed.join(out)


class Packer:
    """Packs documents one after another; pieces gathers (doc_id, start, length, crc32, doc_tokens, sequence_id, offset, tier, step_group)."""

    def __init__(self, prefix: int = 0, tiers: tuple[int, ...] = TIERS, buffer_tokens: int = BUFFER_TOKENS, step_tokens: int = 32_768):
        self.tiers, self.longest, self.buffer_tokens, self.step_tokens = tuple(sorted(tiers)), max(tiers), buffer_tokens, step_tokens
        self.prefix, self.sequences, self.filled = prefix, 0, dict.fromkeys(tiers, 0)
        self.items: list[tuple[int, int, object, int, bytes, int]] = []  # length, order, doc_id, start, ids, doc_tokens
        self.held = self.order = 0
        self.pieces: list[tuple] = []

    def add(self, doc_id: object, ids: bytes) -> None:
        n, at = len(ids) // 4, 0
        while n - at >= self.longest:
            self._emit([(self.longest, 0, doc_id, at, ids[4 * at : 4 * (at + self.longest)], n)])
            at += self.longest
        if at < n:
            self.order += 1
            self.items.append((n - at, self.order, doc_id, at, ids[4 * at :], n))
            self.held += n - at
        if self.held >= self.buffer_tokens:
            self._fill()

    def close(self) -> None:
        self._fill()
        left, self.items, self.held = self.items, [], 0
        total = sum(x[0] for x in left)
        while total:
            size = self.longest if total >= self.longest else 1 << (total.bit_length() - 1)
            total -= size
            took: list[tuple] = []
            while size:
                x = left.pop(0)
                if x[0] > size:
                    x, rest = self._cut(x, size)
                    left.insert(0, rest)
                took.append(x)
                size -= x[0]
            self._emit(took)

    def _fill(self) -> None:
        """Packs full windows, longest tier first, until what is left fills none."""
        pool = sorted(self.items, key=lambda x: x[:2])
        lens = [x[0] for x in pool]
        total = sum(lens)
        while pool:
            longest = pool[-1]
            window = next(w for w in self.tiers if w >= longest[0])
            if total < window:
                break
            pool.pop()
            lens.pop()
            took, gap = [longest], window - longest[0]
            while gap:
                at = bisect_right(lens, gap) - 1
                if at >= 0:
                    x = pool.pop(at)
                    lens.pop(at)
                else:  # all are longer than the gap: the shortest is cut
                    x, rest = self._cut(pool.pop(0), gap)
                    lens.pop(0)
                    insort(pool, rest, key=lambda y: y[:2])
                    insort(lens, rest[0])
                took.append(x)
                gap -= x[0]
            total -= window
            self._emit(took)
        self.items, self.held = pool, total

    @staticmethod
    def _cut(x: tuple, n: int) -> tuple[tuple, tuple]:
        length, order, doc_id, start, ids, doc_tokens = x
        return (n, order, doc_id, start, ids[: 4 * n], doc_tokens), (length - n, order, doc_id, start + n, ids[4 * n :], doc_tokens)

    def _emit(self, items: list[tuple]) -> None:
        size = sum(x[0] for x in items)
        group = self.filled.get(size, 0) // self.step_tokens
        self.filled[size] = self.filled.get(size, 0) + size
        offset = 0
        for length, _, doc_id, start, ids, doc_tokens in items:
            self.pieces.append((doc_id, start, length, zlib.crc32(ids), doc_tokens, self.prefix + self.sequences, offset, size, group))
            offset += length
        self.sequences += 1


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def _packed(make: Callable[[], Callable[[str | None], bytes]], tiers: tuple[int, ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = make(), np.array([END_ID], "<u4").tobytes()
        packer = Packer(TaskContext.get().partitionId() << 40, tiers)
        names = [x.split()[0] for x in PIECES.split(", ")]

        def taken() -> pd.DataFrame:
            out, packer.pieces = pd.DataFrame(packer.pieces, columns=names), []
            return out.astype({"doc_id": "Int64"})

        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                packer.add(None if pd.isna(doc_id) else int(doc_id), encode(text) + end)
            if packer.pieces:
                yield taken()
        packer.close()
        if packer.pieces:
            yield taken()

    return run


def pack(docs: DataFrame, ranks_path: str | None = None, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """The pieces (PIECES) of docs (doc_id, text); ranks_path: a tiktoken file of the byte-level vocabulary."""
    ready(docs.sparkSession)

    def make() -> Encoder:
        import public_tokenizers

        return Encoder(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInPandas(_packed(make, tiers), PIECES)
