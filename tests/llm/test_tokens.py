"""Vocabulary encoders, the piece codec, token files and packing against the libraries and exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as vocabularies
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from casebook.llm import packing, piece_codec, token_files
from casebook.llm.vocab import ByteEncoder, WordEncoder

P = vocabularies.path
TEXT = st.text(alphabet=st.sampled_from(list("abcdetsnTHE  \n\n\t.,;!'-0123éßñÅ日本😀 ́<|>/[]\x00\x01▁")), max_size=80)


def library(name):
    t = Tokenizer.from_file(P(name))
    t.encode_special_tokens = True
    return t


BYTE, WORD = ByteEncoder(P("byte_bpe_50k.json"), P("byte_bpe_50k.tiktoken"), vocabularies.PATTERN), WordEncoder(P("word_bpe_49k.json"))
LIB_BYTE, LIB_WORD = library("byte_bpe_50k.json"), library("word_bpe_49k.json")
SP, CODEC = sentencepiece.SentencePieceProcessor(model_file=P("piece_bpe_32k.model")), piece_codec.codec(P("piece_bpe_32k.model"))


def lists(ids, begin):
    return [ids[a:b].tolist() for a, b in zip(begin, begin[1:])]


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6))
def test_encoders_agree_with_the_library(texts):
    assert lists(*BYTE.encode(pa.array(texts, pa.string()))) == [LIB_BYTE.encode(t, add_special_tokens=False).ids for t in texts]
    assert lists(*WORD.encode(pa.array(texts, pa.string()))) == [LIB_WORD.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6))
def test_pieces_agree_with_the_library(texts):
    ids, begin = CODEC.encode(pa.array(texts, pa.string()))
    assert lists(ids, begin) == SP.encode(texts)
    assert [x.decode() for x in CODEC.decode(ids, begin)] == SP.decode(SP.encode(texts))


@pytest.mark.parametrize("n", [1, 2, 7, 15, 16, 17, 31, 33, 64, 100, 333])
def test_runs_of_spaces(n):
    for text in (" " * n, "x" + " " * n + "y", " " * n + "\n"):
        assert lists(*CODEC.encode(pa.array([text]))) == [SP.encode(text)]


def test_codec_edge_rows(spark, edge, none, edge_rows):
    found = {(r["doc_id"], r["n_tokens"]): r for r in piece_codec.digests(edge, P("piece_bpe_32k.model")).collect()}
    for i, text in edge_rows:
        ids = SP.encode(text or "")
        r = found[i, len(ids)]
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(SP.decode(ids).encode()).hexdigest()
    assert piece_codec.digests(none, P("piece_bpe_32k.model")).count() == 0
    both = piece_codec.decode(piece_codec.encode(edge.where("doc_id < 9"), P("piece_bpe_32k.model")), P("piece_bpe_32k.model"))
    assert {r["doc_id"]: r["text"] for r in both.collect()}[5] == "one two three"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 60_000) | st.integers(0, 300), max_size=400), min_size=1, max_size=30), st.sampled_from([8, 64, 1024]))
def test_token_file_round_trip(docs, block):
    docs = [d or [1] for d in docs]
    ids = np.concatenate([np.array(d, np.uint32) for d in docs])
    raw = token_files.pack_ids(np.arange(len(docs)), np.array([len(d) for d in docs]), ids, block)
    file = token_files.TokenFile(raw)
    assert [(i, x.tolist()) for i, _, x in file.documents(step=2)] == list(enumerate(docs))
    k = len(docs) // 2
    start = sum(map(len, docs[:k]))
    assert file.ids(start, len(docs[k])).tolist() == docs[k]


def test_token_files_edge_rows(spark, edge, none, edge_rows):
    from casebook.llm.common import fresh_path

    path = fresh_path(spark, "t")
    found = token_files.read_token_files(token_files.write_token_files(edge, P("word_bpe_49k.json"), 1, path), path, with_ids=True).collect()
    want = [[*LIB_WORD.encode(t or "", add_special_tokens=False).ids, 1] for _, t in edge_rows]
    assert sorted((r["doc_id"], r["ids"]) for r in found) == sorted((i, x) for (i, _), x in zip(edge_rows, want))
    at = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    path = fresh_path(spark, "t")
    assert token_files.read_token_files(token_files.write_token_files(none, P("word_bpe_49k.json"), 1, path), path).count() == 0


def best_fit_decreasing(lengths, capacity):
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, f in enumerate(free) if f >= n]
        if fits:
            i = min(fits, key=lambda i: free[i])
            free[i] -= n
        else:
            free.append(capacity - n)
    return len(free)


@pytest.mark.parametrize("seed", range(6))
def test_plan_packs_as_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 100])
    lengths = [rng.randint(1, capacity) if rng.random() < 0.5 else rng.randint(1, 1 + capacity // 4) for _ in range(rng.randint(1, 400))]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    plan = packing.plan_bins(histogram, capacity)
    assert plan["bin"].max() >= 0
    bins = {}
    rows = list(zip(*(plan[k].tolist() for k in ("length", "rank", "bin", "offset"))))
    for (n, rank, first, offset), after in zip(rows, [*rows[1:], (None,) * 4]):
        count = (after[1] if after[0] == n else histogram[n]) - rank
        for k in range(count):
            bins.setdefault(first + k, []).append((offset, n))
    assert sum(map(len, bins.values())) == len(lengths)
    for pieces in bins.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(bins) == best_fit_decreasing(lengths, capacity)


def test_tree_finds_the_tightest():
    tree = packing.CapacityTree(20)
    for r in (3, 9, 20):
        tree.add(r, 1)
    assert [tree.tightest(n) for n in (1, 3, 4, 10, 20)] == [3, 3, 9, 20, 20]
    tree.add(20, -1)
    assert tree.tightest(10) is None


def test_packing_edge_rows(spark, edge, none, edge_rows):
    found = packing.pack_documents(edge).collect()
    sizes = sorted(len(LIB_BYTE.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in edge_rows)
    per = {}
    for r in found:
        per.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in found) == sum(sizes)
    for pieces in per.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048
    long = sorted((r["piece"], r["start"], r["length"]) for r in found if r["doc_id"] == 9)
    assert all(n == 2048 for _, _, n in long[1:]) and [s for _, s, _ in long] == [0, *np.cumsum([n for _, _, n in long])[:-1].tolist()]
    assert packing.pack_documents(none).count() == 0


def test_sequences_hold_the_ids(spark, edge):
    from casebook.llm.common import materialize

    pieces = packing.token_pieces(edge.where("doc_id < 7"), P("byte_bpe_50k.json"), P("byte_bpe_50k.tiktoken"), vocabularies.PATTERN, 64, with_ids=True)
    made = packing.sequences(packing.best_fit(materialize(pieces, "p"), 64)).collect()
    assert all(len(r["ids"]) <= 64 for r in made) and sum(len(r["doc_ids"]) for r in made) == pieces.count()
