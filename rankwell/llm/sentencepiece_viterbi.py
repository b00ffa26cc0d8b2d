"""SentencePiece encoding and decoding by a Viterbi search that neighbouring words share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwell.llm.common import documents_of

MARK = "▁"  # stands for a space
MEMO_WORDS = 700_000  # encoded words a Python worker remembers; only speed depends on it
_PLAIN, _BYTE, _BPE = 1, 6, 2  # kinds of piece and of model in the model's file
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
BATCH_ROWS = 3_000  # documents whose new words are encoded together

_WORKER: dict = {}


class PieceModel:
    """A BPE piece model with byte fallback: pieces, their scores, which are merge ranks, and which two of them may follow each other.

    Merging by score gives every prefix of a word one last piece, and a row of pieces is what merging gives where each
    neighbouring two of them are (the prefix property of BPE). So the forward pass of the Viterbi search keeps, for every
    prefix, the last piece of its one admissible segmentation; a plain sum of the scores would give other ids than the
    library does.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        described = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            described.ParseFromString(file.read())
        normal = described.normalizer_spec
        if normal.precompiled_charsmap or normal.remove_extra_whitespaces or described.trainer_spec.model_type != _BPE:
            raise ValueError("a BPE model that leaves the text as it is is needed")
        self.prefixed = normal.add_dummy_prefix
        self.pieces = [p.piece for p in described.pieces]
        self.scores = {p.piece: (p.score, i) for i, p in enumerate(described.pieces) if p.type == _PLAIN}
        if any(MARK in p.lstrip(MARK) for p in self.scores):
            raise ValueError("pieces that reach over a space cannot be found word by word")
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(described.pieces) if p.type == _BYTE}
        if len(self.bytes) != 256:
            raise ValueError("a model with byte fallback is needed")
        self._bytes_of = [piece.encode() for piece in self.pieces]
        for b, i in self.bytes.items():
            self._bytes_of[i] = bytes([b])
        self._known: dict[str, bytes] = {}
        self._admitted: dict[tuple[str, str], bool] = {}
        self.usable = {piece for piece in self.scores if self._merged(list(piece)) == [piece]}  # others no merging gives
        self.reaches: dict[str, int] = {}  # by their last two letters, the length of the longest piece
        for piece in self.usable:
            self.reaches[piece[-2:]] = max(len(piece), self.reaches.get(piece[-2:], 1))

    # Merging rebuilt on two pieces only, to decide whether they stay apart.
    def _merged(self, symbols: list[str]) -> list[str]:
        symbols = list(symbols)
        while len(symbols) > 1:
            ranked = [(self.scores[a + b][0], -i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in self.scores]
            if not ranked:
                break
            at = -max(ranked)[1]
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def admits(self, before: str, piece: str) -> bool:
        """Whether merging the letters of two pieces gives the two pieces."""
        key = (before, piece)
        known = self._admitted.get(key)
        if known is None:
            if len(self._admitted) > 400_000:
                self._admitted.clear()
            known = self._admitted[key] = self._merged(list(before + piece)) == [before, piece]
        return known

    def ids_of(self, piece: str) -> list[int]:
        """A piece's id, or those of the bytes of a letter that is no piece."""
        found = self.scores.get(piece)
        return [found[1]] if found else [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of distinct words. Sorted, they are a trie walked depth first: a word keeps the forward pass of the
        letters it shares with the word before. Of the pieces that end at a place only one is admitted after what
        stands before it, so the search stops there; longer pieces are tried first."""
        out: dict[str, list[int]] = {}
        last: list[str] = [""]  # the last piece of every prefix
        previous = ""
        usable, reaches, admitted, admits, ids_of = self.usable, self.reaches, self._admitted, self.admits, self.ids_of
        for word in sorted(words):
            shared = 0
            for a, b in zip(previous, word, strict=False):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                reach = reaches.get(word[end - 2 : end], 1) if end > 1 else 1
                for start in range(end - reach if end > reach else 0, end):
                    piece = word[start:end]
                    if piece in usable or end - start == 1:
                        if not start:
                            break
                        before = last[start]
                        known = admitted.get((before, piece))
                        if known or (known is None and admits(before, piece)):
                            break
                else:
                    raise AssertionError(f"no admissible piece ends at {end} of {word!r}")
                last.append(piece)
            end, pieces = len(word), []
            while end:
                pieces.append(last[end])
                end -= len(last[end])
            out[word] = [i for piece in reversed(pieces) for i in ids_of(piece)]
            previous = word
        return out

    def marked(self, text: str) -> list[str]:
        """Words of a text, each with the spaces before it as marks."""
        if not text:
            return []
        return _WORD.findall((MARK if self.prefixed else "") + text.replace(" ", MARK))

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes are put together, marks become spaces, the mark put in front goes."""
        text = b"".join(map(self._bytes_of.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.prefixed and text.startswith(" ") else text

    def encode_documents(self, texts: list[str]) -> list[bytes]:
        """Ids of texts as two bytes each: the distinct words that are new are encoded together, then looked up."""
        split, known = [self.marked(text) for text in texts], self._known
        fresh = {word for words in split for word in words if word not in known}
        if len(known) + len(fresh) > MEMO_WORDS:
            known.clear()
            fresh = {word for words in split for word in words}
        known.update((word, np.asarray(ids, "<u2").tobytes()) for word, ids in self.encode_words(list(fresh)).items())
        return [b"".join(map(known.__getitem__, words)) for words in split]


def _model(path: str) -> PieceModel:
    if path not in _WORKER:
        _WORKER[path] = PieceModel(path)
    return _WORKER[path]


def encode_pieces(docs: DataFrame, *, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids), one row for every row of ``docs``: the ids that the library gives the whole text, as an array.

    ``model`` is the path of a SentencePiece BPE model with byte fallback, at the same place on every machine. Words
    are what stands between spaces, with the spaces before them as marks; no piece reaches over the end of one. Each
    task encodes the distinct words of its batches over the trie of their letters. Null and empty texts have no ids,
    repeated rows each their own, and no rows give none. A literal ▁ has the ids of a space, as in the library.
    """
    path = model or public_tokenizers.path("piece_bpe_32k.model")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = _model(path)
        for batch in batches:
            for start in range(0, len(batch), BATCH_ROWS):
                part = batch.iloc[start : start + BATCH_ROWS]
                ids = [np.frombuffer(i, "<u2").astype(np.int32) for i in pieces.encode_documents([t or "" for t in part["text"]])]
                yield pd.DataFrame({"doc_id": part["doc_id"], "ids": ids})

    rows = documents_of(docs, id_col, text_col).withColumn("text", F.col("text").cast("string"))
    return rows.mapInPandas(encode, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode_pieces(path: str | None = None) -> Column:
    """A function of a column of ids: the text they stand for.

    Null and empty arrays give the empty text; bytes that are no UTF-8 become replacement characters, and what was a
    literal ▁ before encoding comes back as a space.
    """
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([_model(path).decode([] if ids is None else list(ids)) for ids in batch])

    return decode


def query(docs: DataFrame) -> DataFrame:
    """Per document: its number of pieces, a checksum of their ids, and whether decoding them gives the text back."""
    path = public_tokenizers.path("piece_bpe_32k.model")

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from zlib import crc32

        pieces = _model(path)
        for batch in batches:
            for start in range(0, len(batch), BATCH_ROWS):
                texts = [t or "" for t in batch["text"].iloc[start : start + BATCH_ROWS]]
                encoded = pieces.encode_documents(texts)
                yield pd.DataFrame({
                    "doc_id": batch["doc_id"].iloc[start : start + BATCH_ROWS],
                    "n_pieces": [len(ids) // 2 for ids in encoded],
                    "ids_crc32": [crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes()) for ids in encoded],
                    "round_trip": [pieces.decode(np.frombuffer(i, "<u2").tolist()) == t for i, t in zip(encoded, texts, strict=True)],
                })

    return docs.select("doc_id", "text").mapInPandas(digest, "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean")
