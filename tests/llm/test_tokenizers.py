import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rankwell.llm import packing, sentencepiece_viterbi, token_counts

DOCS = "doc_id long, text string, digest string, ids int"
WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
SPACES = " \n\t\r\x0b\x0c\x1c\x1f\x85\xa0 　"
PIECES = st.sampled_from([*SPACES, *"aeTH.,'1é漢ßİ́▁😀", "the", "'s", "<|endoftext|>", "<|startoftext|>", "  ", "ing"])
TEXTS = st.lists(PIECES, max_size=25).map("".join)


def frame(spark, texts, start=0):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts, start)], DOCS)


def samples():
    dice = random.Random(2)
    texts = ["".join(dice.choice(["the ", "Thing", "\n", " ", "é", "<|endoftext|>", "12", "x\xa0y", "!?"]) for _ in range(dice.randrange(50))) for _ in range(60)]
    return [*texts, None, "", " ", "word " * 20_000, "a" * 5_000, texts[0], texts[1]]


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_counts_word_by_word_are_the_librarys(text):
    whole = len(_word().encode(text, add_special_tokens=False))
    assert token_counts.count_words_apart([text], WORD) == [whole]


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_packing_ids_are_the_librarys(text):
    ids = np.frombuffer(packing._encoder(BYTE).ids(text), "<u2").tolist()
    assert ids == _byte().encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, max_size=5))
def test_pieces_are_the_librarys(texts):
    model = sentencepiece_viterbi._model(PIECE)
    for text, ids in zip(texts, model.encode_documents(texts), strict=True):
        ids = np.frombuffer(ids, "<u2").tolist()
        assert ids == _piece().encode(text)
        assert model.decode(ids) == text.replace("▁", " ")


_LOADED = {}


def _word():
    return _LOADED.setdefault("word", Tokenizer.from_file(WORD))


def _byte():
    return _LOADED.setdefault("byte", Tokenizer.from_file(BYTE))


def _piece():
    return _LOADED.setdefault("piece", sentencepiece.SentencePieceProcessor(model_file=PIECE))


def test_token_counts_use_and_fill_the_cache(spark, tmp_path):
    texts, cache = samples(), str(tmp_path / "cache")
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(frame(spark, texts), cache=cache).collect()}
    want = {i: (len((t or "").encode()), len(_word().encode(t or "", add_special_tokens=False))) for i, t in enumerate(texts)}
    assert got == want
    stored = spark.read.parquet(cache)
    n = stored.count()
    assert n == stored.select("digest").distinct().count()
    token_counts.count_tokens(frame(spark, [texts[3], "new text", "new  text"]), cache=cache).collect()
    assert spark.read.parquet(cache).count() == n + 1
    other = token_counts.count_tokens(frame(spark, ["a  b", "a b"]), tokenizer=BYTE, cache=cache).collect()
    assert sorted(r.n_tokens for r in other) == sorted(len(_byte().encode(t).ids) for t in ("a  b", "a b"))
    assert token_counts.query(frame(spark, []).limit(0)).count() == 0


def test_packing_covers_every_id_once_without_padding(spark):
    texts = samples()
    ids = {i: np.array([*_byte().encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in enumerate(texts)}
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in packing.query(frame(spark, texts)).collect():
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        docs[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(docs) == set(ids)
    for spans in [*docs.values(), *sequences.values()]:
        end = 0
        for start, length in sorted(spans):
            assert start == end and length > 0
            end += length
    assert all(sum(n for _, n in docs[i]) == len(ids[i]) for i in ids)
    sizes = [sum(n for _, n in s) for s in sequences.values()]
    assert all(n <= 1024 and n & (n - 1) == 0 for n in sizes)
    assert packing.query(frame(spark, []).limit(0)).count() == 0


REPEATED = [(1, "some words"), (1, "some words"), (1, "other words here"), (None, "no id"), (None, None), (2, ""), (2, "")]


def test_rows_that_repeat_ids_or_have_none_are_kept_each(spark):
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in REPEATED], DOCS)

    def ordered(rows):
        return sorted(rows, key=str)

    counted = token_counts.query(docs).collect()
    assert ordered((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in counted) == ordered(
        (i, len(t or ""), len(_word().encode(t or "", add_special_tokens=False)), False) for i, t in REPEATED
    )
    encoded = sentencepiece_viterbi.encode_pieces(docs).collect()
    assert ordered((r.doc_id, list(r.ids)) for r in encoded) == ordered((i, _piece().encode(t or "")) for i, t in REPEATED)
    pieces = packing.query(docs).collect()
    tokens = [(i, len(_byte().encode(t or "", add_special_tokens=False).ids) + 1) for i, t in REPEATED]
    assert ordered((r.doc_id, r.doc_tokens) for r in pieces if not r.start) == ordered(tokens)
    assert sum(r.length for r in pieces) == sum(n for _, n in tokens)


def test_hilbert_neighbours_are_one_step_apart():
    for dims, bits in ((2, 4), (3, 3)):
        side = 1 << bits
        points = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = packing.hilbert_keys(points, bits)
        assert sorted(keys) == list(range(side**dims))
        steps = np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1)
        assert set(steps) == {1}


def test_sentencepiece_operator_round_trip(spark):
    texts = samples()
    encoded = sentencepiece_viterbi.encode_pieces(frame(spark, texts))
    decoded = encoded.withColumn("text", sentencepiece_viterbi.decode_pieces()("ids")).collect()
    assert {r.doc_id: r.text for r in decoded} == {i: (t or "") for i, t in enumerate(texts)}
    assert all(list(r.ids) == _piece().encode(texts[r.doc_id] or "") for r in decoded)
    assert all(r.round_trip for r in sentencepiece_viterbi.query(frame(spark, texts)).collect())
    assert sentencepiece_viterbi.query(frame(spark, []).limit(0)).count() == 0


def test_words_that_cannot_be_told_apart_are_encoded_with_their_text():
    encoder, library = packing.Encoder(BYTE), Tokenizer.from_file(BYTE)
    encoder._begins_word = np.zeros_like(encoder._begins_word)
    for text in ("some words of a text", "one", "a b\nc d"):
        assert np.frombuffer(encoder.ids(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids
    assert not encoder._known


def test_decoding_of_nothing_marks_and_broken_bytes(spark):
    given = [None, [], _piece().encode("a▁b"), _piece().encode("é漢")[:-1]]
    rows = spark.createDataFrame(list(enumerate(given)), "n int, ids array<int>")
    got = [r.text for r in rows.select("n", sentencepiece_viterbi.decode_pieces()("ids").alias("text")).orderBy("n").collect()]
    assert got[:3] == ["", "", "a b"] and got[3].startswith("é")
