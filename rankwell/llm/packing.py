"""Packing along a space-filling curve."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwell.llm.common import documents_of
from rankwell.sources.scratch import materialize

SEQUENCE_TOKENS = 1024
DIMENSIONS, BITS = 3, 16  # of the curve: a key of 48 bits
FEATURES = 256  # of the hashed document vectors
MEMO_WORDS = 700_000  # words whose ids a Python worker remembers; only speed depends on it
RANGE_BYTES = 8 << 20  # of compressed ids, in a range that one task fills sequences from
_BLOCK = 1 << 20  # ids of one output batch

_WORKER: dict = {}
_OTHER_SPACE = re.compile(r"[^\S \n]")


def _has_other_space(text: str) -> bool:
    if text.isascii():
        return any(c in text for c in "\t\r\x0b\x0c\x1c\x1d\x1e\x1f")
    return _OTHER_SPACE.search(text) is not None


class Encoder:
    """Ids of a byte-level BPE vocabulary, word by word: equal to those of the tokenizers library on whole texts.

    The pre-tokenizer's pattern puts a single space in front of the word that follows, so a text may be cut before
    every single space between two other characters; the pieces' ids are remembered. Ids are kept as two bytes each.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        # the printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, others follow 255
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        special = {t["content"]: t["id"] for t in described["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in described["model"]["vocab"].items() if token not in special}
        self._bpe = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self._special = set(special)
        if max(*ranks.values(), *special.values()) > 0xFFFF:
            raise ValueError("ids over 65535 do not fit two bytes")
        self._begins_word = np.zeros(1 << 16, bool)
        self._begins_word[[i for token, i in ranks.items() if token.startswith(b" ")]] = True
        self._known: dict[str, bytes] = {}

    def _direct(self, text: str) -> bytes:
        if not any(s in text for s in self._special):
            return np.asarray(self._bpe.encode_ordinary(text), "<u2").tobytes()
        return np.asarray(self._bpe.encode(text, allowed_special=self._special), "<u2").tobytes()

    def ids(self, text: str) -> bytes:
        words = text.split(" ")
        # with spaces and line feeds the only white space, the counts agree where none stands at an end or by another
        apart = len(text.split()) == len(words) + text.count("\n") and not _has_other_space(text)
        if not apart or any(s in text for s in self._special):
            return self._direct(text)
        known, first = self._known, words[0]
        words = words[1:]
        try:
            return self._direct(first) + b"".join(map(known.__getitem__, words))
        except KeyError:
            if len(known) > MEMO_WORDS:
                known.clear()
            if not self._learn(list({word: None for word in words if word not in known})):
                return self._direct(text)
            return self._direct(first) + b"".join(map(known.__getitem__, words))

    def _learn(self, words: list[str]) -> bool:
        """Ids of new words, encoded in one go: no word holds a space, so a token that begins with one begins a word.

        False, and nothing learnt, where not every word has such a token: then the text is encoded whole.
        """
        ids = np.asarray(self._bpe.encode_ordinary(" " + " ".join(words)), "<u2")
        begins = np.flatnonzero(self._begins_word[ids])
        if len(begins) != len(words):
            return False
        whole = ids.tobytes()
        cuts = [*(2 * begins).tolist(), len(whole)]
        self._known.update((word, whole[a:b]) for word, a, b in zip(words, cuts, cuts[1:], strict=False))
        return True


def _encoder(path: str) -> Encoder:
    if path not in _WORKER:
        _WORKER[path] = Encoder(path)
    return _WORKER[path]


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions along the Hilbert curve of integer points (rows) with ``bits`` bits in each dimension (Skilling 2004)."""
    x = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(len(x)):
            high = (x[i] >> level) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << 1) | (((axis ^ flip) >> level) & 1)
    return key


_PROJECTION = np.random.default_rng(8).choice([-1.0, 1.0], size=(FEATURES, DIMENSIONS))


def curve_keys(documents: list[bytes]) -> np.ndarray:
    """Hilbert keys of documents given as two-byte ids: damped counts of hashed ids, projected to three dimensions."""
    vectors = np.zeros((len(documents), FEATURES))
    for i, ids in enumerate(documents):
        hashed = (np.frombuffer(ids, "<u2").astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(24)
        vectors[i] = np.sqrt(np.bincount(hashed, minlength=FEATURES))
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    spread = 1 / (1 + np.exp(-1.7 * vectors @ _PROJECTION))  # about even in 0 to 1
    return hilbert_keys((spread * ((1 << BITS) - 1)).astype(np.int64))


def tokenize_documents(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, curve, ids): every document's ids with ``end_id`` after them, two bytes each, compressed."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        encoder, packed = _encoder(path), zstandard.ZstdCompressor(level=1)
        end = np.asarray([end_id], "<u2").tobytes()
        for batch in batches:
            for start in range(0, len(batch), 500):
                part = batch.iloc[start : start + 500]
                ids = [encoder.ids(text or "") + end for text in part["text"]]
                yield pd.DataFrame({"doc_id": part["doc_id"], "curve": curve_keys(ids), "ids": [packed.compress(i) for i in ids]})

    rows = documents_of(docs, id_col, text_col).withColumn("text", F.col("text").cast("string"))
    return rows.mapInPandas(encode, f"doc_id {docs.schema[id_col].dataType.simpleString()}, curve long, ids binary")


def _powers(n: int) -> list[int]:
    return [1 << bit for bit in range(n.bit_length() - 1, -1, -1) if n >> bit & 1]


def pack_documents(
    docs: DataFrame,
    *,
    tokenizer: str | None = None,
    end_id: int = 0,
    sequence_tokens: int = SEQUENCE_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids), one row for every piece of a document.

    Documents are tokenised once and written, then sorted by ranges of their Hilbert key (ties by id), about
    ``RANGE_BYTES`` of compressed ids each, and each range
    fills sequences of ``sequence_tokens`` with document after document, cutting where a sequence is full. What is left
    at the end of a range is cut into sequences of a power of two, so nothing is padded. ``ids`` holds the piece's ids
    as little-endian 32-bit numbers. Sequence ids are the range's number times 2**40, and on from there.

    Null and empty texts have ``end_id`` alone. Repeated rows are packed each for itself. No rows give no pieces.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    tokens = materialize(tokenize_documents(docs, path, end_id, id_col, text_col), "packing-tokens")
    packed = tokens.agg(F.coalesce(F.sum(F.octet_length("ids").cast("long")), F.lit(0))).first()[0]
    along = tokens.repartitionByRange(1 + packed // RANGE_BYTES, "curve", "doc_id").sortWithinPartitions("curve", "doc_id")

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        unpacked, sequence, used = zstandard.ZstdDecompressor(), TaskContext.get().partitionId() << 40, 0
        rows: list[tuple] = []
        held, pending = 0, 0  # ids in rows; the first row of the open sequence
        columns = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
        for batch in batches:
            for doc_id, packed in zip(batch["doc_id"], batch["ids"], strict=True):
                ids = np.frombuffer(unpacked.decompress(packed), "<u2")
                start = 0
                while start < len(ids):
                    length = min(sequence_tokens - used, len(ids) - start)
                    rows.append((doc_id, start, length, len(ids), sequence, used, ids[start : start + length].astype("<u4").tobytes()))
                    start, used, held = start + length, used + length, held + length
                    if used == sequence_tokens:
                        sequence, used, pending = sequence + 1, 0, len(rows)
                        if held >= _BLOCK:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, held, pending = [], 0, 0
        last, rows = rows[pending:], rows[:pending]
        sizes = _powers(used)
        offset = 0
        for doc_id, start, length, doc_tokens, _, _, ids in last:
            taken = 0
            while taken < length:
                here = min(sizes[0] - offset, length - taken)
                rows.append((doc_id, start + taken, here, doc_tokens, sequence, offset, ids[4 * taken : 4 * (taken + here)]))
                taken, offset = taken + here, offset + here
                if offset == sizes[0]:
                    sizes, sequence, offset = sizes[1:], sequence + 1, 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    kind = docs.schema[id_col].dataType.simpleString()
    return along.mapInPandas(
        fill, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    )


def query(docs: DataFrame) -> DataFrame:
    pieces = pack_documents(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
