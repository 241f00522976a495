"""Byte-level BPE: texts to ids with offsets, and ids back to bytes."""

from __future__ import annotations

import base64
import codecs
import os
from collections.abc import Iterator
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of text whose pieces are held at once; pieces of a longer text held at once; pieces kept from one chunk to the next.
CHUNK, PIECES, KEPT = 2_000_000, 400_000, 300_000


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte: printable Latin-1 for itself, the others for characters from 256 up, in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in printable else next(rest)) for b in range(256)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Encoder:
    """Texts to ids by a file of ranks, without special tokens.

    The pattern cuts a text into pieces; each piece is written in byte characters and merged on its own. A merge is any
    two tokens that make a third, and goes before another if its result ranks lower; a piece that is a token stays
    whole. Ids of pieces met before are kept."""

    def __init__(self, path: str, pattern: str, offsets: bool = False):
        from tokenizers import Tokenizer, models, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        ranks, char = read_ranks(path), byte_characters()
        name = {token: "".join(map(char.__getitem__, token)) for token in ranks}
        merges = [(name[t[:i]], name[t[i:]]) for t in sorted(ranks, key=ranks.get) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.library = Tokenizer(models.BPE({name[t]: r for t, r in ranks.items()}, merges, ignore_merges=True))
        self.library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.pattern, self.offsets = regex.compile(pattern), offsets
        self.known: dict[str, bytes] = {}
        self.spans: dict[str, np.ndarray] = {}

    def _cut(self, text: str) -> Iterator[list[str]]:
        if len(text) <= CHUNK:
            yield self.pattern.findall(text)
        else:
            found = self.pattern.finditer(text)
            while some := [m[0] for m in islice(found, PIECES)]:
                yield some

    def _learn(self, pieces: set[str]) -> None:
        """Ids of pieces that are not known yet, which the library gets as words of one list."""
        if new := [p for p in pieces if p not in self.known]:
            made = self.library.encode(new, is_pretokenized=True, add_special_tokens=False)
            bounds = np.searchsorted(np.array(made.word_ids), np.arange(len(new) + 1)).tolist()
            ids = np.array(made.ids, "<u4").tobytes()
            self.known.update(zip(new, [ids[4 * a : 4 * b] for a, b in pairwise(bounds)]))
            if self.offsets:
                spans = np.array(made.offsets, np.int64).reshape(-1, 2)
                self.spans.update(zip(new, [spans[a:b] for a, b in pairwise(bounds)]))

    def encode(self, texts: list[str]) -> list[tuple[bytes, np.ndarray | None]]:
        """Each text's ids as little-endian unsigned 32-bit integers and, with offsets, each id's first character and the
        one after its last. An id that holds a part of a character spans that character."""
        out, cuts = [], [self._cut(t) for t in texts]
        if short := sum(map(len, texts)) <= CHUNK:  # else there is one text, whose pieces come in several lots
            cuts = [list(c) for c in cuts]
            self._learn({p for c in cuts for lot in c for p in lot})
        for lots in cuts:
            ids, spans, at = [], [np.zeros((0, 2), np.int64)], 0
            for lot in lots:
                if not short:
                    self._learn(set(lot))
                ids.append(b"".join([self.known[p] for p in lot]))
                if self.offsets:
                    for p in lot:
                        spans.append(self.spans[p] + at)
                        at += len(p)
                if not short:
                    self._forget()
            out.append((b"".join(ids), np.concatenate(spans) if self.offsets else None))
        self._forget()
        return out

    def _forget(self) -> None:
        """Keep what was met while it is not too much."""
        if len(self.known) > KEPT or sum(map(len, self.known.values())) > 16 * KEPT:
            self.known.clear()
            self.spans.clear()


class Decoder:
    """Ids to bytes, by the reversed table of byte characters."""

    def __init__(self, path: str):
        char = byte_characters()
        byte = {c: b for b, c in char.items()}
        name = {rank: "".join(map(char.__getitem__, token)) for token, rank in read_ranks(path).items()}
        self.token = {rank: bytes(map(byte.__getitem__, text)) for rank, text in name.items()}

    def bytes_of(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))

    def texts_of(self, ids: np.ndarray) -> list[str]:
        """The text that each id adds: a character that is split over ids comes with the id that ends it."""
        read = codecs.getincrementaldecoder("utf-8")("replace")
        return [read.decode(self.token[i]) for i in ids.tolist()]


def _files(vocabulary: str) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(f"{vocabulary}.tiktoken"), public_tokenizers.PATTERN


def _lots(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most CHUNK bytes in column `at`, or one row."""
    from pyarrow import compute

    ends = np.cumsum(compute.fill_null(compute.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CHUNK, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def encode(docs: DataFrame, vocabulary: str = "byte_bpe_multi_50k", offsets: bool = False) -> DataFrame:
    """doc_id and the ids of its text (binary: little-endian unsigned 32-bit), one row for each row of docs.

    With offsets also `starts` and `ends`, arrays of character places in the text. Takes doc_id and text; a null or
    empty text has no ids; texts of any length are encoded whole, some pieces at a time. Rows with equal or null ids stay
    apart, an empty table gives no rows, other columns are ignored. Nothing is shuffled."""
    schema = "doc_id long, ids binary" + ", starts array<int>, ends array<int>" * offsets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*_files(vocabulary), offsets)
        for batch in batches:
            for lot in _lots(batch, 1):
                found = encoder.encode([t or "" for t in lot.column(1).to_pylist()])
                columns = [lot.column(0), pa.array([ids for ids, _ in found], pa.binary())]
                if offsets:
                    bounds = pa.array(np.cumsum([0, *(len(s) for _, s in found)]), pa.int32())
                    columns += [pa.ListArray.from_arrays(bounds, pa.array(np.concatenate([s[:, i] for _, s in found]), pa.int32())) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "starts", "ends"][: len(columns)])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str = "byte_bpe_multi_50k") -> DataFrame:
    """doc_id, ids and `decoded`, the bytes that the ids stand for. Null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(_files(vocabulary)[0])
        for batch in batches:
            for lot in _lots(batch, 1):
                back = [decoder.bytes_of(np.frombuffer(x.as_buffer(), "<u4")) if x.is_valid else b"" for x in lot.column(1)]
                yield pa.RecordBatch.from_arrays([*lot.columns, pa.array(back, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, the number of ids, and digests of the ids and of the decoded bytes."""
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
