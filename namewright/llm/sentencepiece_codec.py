"""SentencePiece encoding and decoding with an Aho-Corasick automaton and a single-pass Viterbi.

The automaton holds all pieces. As it reads a text it stops at each position on the longest piece that ends there;
its output links lead to the shorter ones. Each relaxes the best score of its end from that of its start, so one pass
finds the segmentation with the highest sum of piece scores; equal sums go to the longer last piece. A character that
no piece covers falls back to its UTF-8 bytes.

No piece of these vocabularies holds a space mark after another character, and none a line feed, so texts part into
chunks whose segmentations are independent; chunks repeat and are remembered, in a table of bounded size.

The vocabulary's file is of the byte-pair kind. The named method segments by summed scores, as the library's unigram
models do; tests hold it against a brute-force search and against the library reading the same pieces as such a model.

Defined results: a null text gives null ids and text, an empty one no ids; decode(encode(x)) = x for every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready

MARK = "▁"
REMEMBERED = 200_000
_CHUNK = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


class Codec:
    """Encoder and decoder over a SentencePiece model file."""

    def __init__(self, model_path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = model.get_piece_size()
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)}
        self.pieces = {model.id_to_piece(i): (i, model.get_score(i)) for i in range(n) if i not in special}
        self.unknown = min(s for _, s in self.pieces.values()) - 10.0
        self.single = frozenset(p for p in self.pieces if len(p) == 1)
        self.automaton = ahocorasick.Automaton()
        for p, (i, s) in self.pieces.items():
            self.automaton.add_word(p, (len(p), s, i))
        self.automaton.make_automaton()
        self.bytes_of = [b""] * n
        for p, (i, _) in self.pieces.items():
            self.bytes_of[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.bytes_of[i] = bytes([b])
        codec = self

        class Known(dict):
            def __missing__(self, chunk: str) -> bytes:
                if len(self) >= REMEMBERED:
                    self.clear()
                out = self[chunk] = np.array(codec.viterbi(chunk), "<i4").tobytes()
                return out

        self.known = Known()

    def viterbi(self, chunk: str) -> list[int]:
        """Ids of the best segmentation of a chunk."""
        n = len(chunk)
        best, start, piece = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        done = -1
        single, unknown = self.single, self.unknown

        def pass_over(upto: int) -> None:
            """Gives the ends up to upto their fallback before pieces relax them."""
            nonlocal done
            while done < upto:
                done += 1
                if chunk[done] not in single:
                    best[done + 1], start[done + 1], piece[done + 1] = best[done] + unknown, done, -1

        for end, (size, score, i) in self.automaton.iter(chunk):
            if end > done:
                pass_over(end)
            s = best[end + 1 - size] + score
            if s > best[end + 1]:
                best[end + 1], start[end + 1], piece[end + 1] = s, end + 1 - size, i
        pass_over(n - 1)
        out: list[int] = []
        at = n
        while at:
            if piece[at] < 0:
                out += [self.byte_ids[b] for b in reversed(chunk[start[at] : at].encode("utf-8", "surrogatepass"))]
            else:
                out.append(piece[at])
            at = start[at]
        return out[::-1]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if not text:
            return b""
        # a mark of the text itself would read as a space: it goes by its bytes
        parts = (MARK + text.replace(" ", MARK)) if MARK not in text else None
        if parts is not None:
            return b"".join(map(self.known.__getitem__, _CHUNK.findall(parts)))
        raw = np.array([self.byte_ids[b] for b in MARK.encode()], "<i4").tobytes()
        pieces = [b"".join(map(self.known.__getitem__, _CHUNK.findall(p.replace(" ", MARK)))) for p in (" " + text).split(MARK)]
        return raw.join(pieces)

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the space that encode() puts first."""
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "surrogatepass")
        return text[1:] if text[:1] == " " else text


def encode_decode(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, ids, n_tokens, decoded (their text), exact (whether that is the text) for docs (doc_id, text)."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        codec = Codec(model_path or public_tokenizers.path("piece_bpe_32k.model"))
        for batch in batches:
            ids, decoded, exact = [], [], []
            for t in batch.column("text").to_pylist():
                x = None if t is None else np.frombuffer(codec.encode(t), "<i4")
                back = None if t is None else codec.decode(x.tolist())
                ids.append(x)
                decoded.append(back)
                exact.append(back == t)
            sizes = [None if x is None else len(x) for x in ids]
            offsets = np.concatenate([[0], np.cumsum([s or 0 for s in sizes])]).astype(np.int32)
            flat = np.concatenate([x for x in ids if x is not None] or [np.empty(0, "<i4")])
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()), mask=pa.array([s is None for s in sizes]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column, pa.array(sizes, pa.int64()), pa.array(decoded, pa.string()), pa.array(exact)], names=["doc_id", "ids", "n_tokens", "decoded", "exact"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, decoded string, exact boolean")
