"""The encoder against a public library, and the mixture's properties."""

from __future__ import annotations

import os
import random
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoweave.llm import bpe
from chronoweave.llm.mixing import mix

pytestmark = pytest.mark.skipif(not Path(bpe.FOLDER, "byte_bpe_50k.json").exists(), reason="no vocabulary")


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(bpe.FOLDER, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def _ids(encoder, texts):
    ids, counts = bpe._Kept(encoder).encode(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if texts else []


ODD = ["", " ", "\r\n\r\n a", "<|endoftext|>", "naïve café’s", "Привет, мир! ٣ 课程表 😀🧪", "a" * 1000, "аб" * 500, " " * 777 + "x", "й й", "I'll we've 12ab34", "​﻿", "x\x00y\x1c\x85z"]


def test_odd_texts(encoder, library):
    assert _ids(encoder, ODD) == [library(t) for t in ODD]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text(encoder, library, texts):
    assert _ids(encoder, texts) == [library(t) for t in texts]


def test_matrix_equals_heap(encoder):
    rnd = random.Random(3)
    pieces = [bytes(rnd.choices(b"abcdetn sr\xd0\xb0\xd1\x82", k=rnd.randint(1, bpe.WIDEST))) for _ in range(400)]
    for piece, ids in zip(pieces, encoder.encode_pieces(pieces), strict=True):
        assert ids.tolist() == encoder._merge_long(piece).tolist()


def _other_library(name):
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    if name.endswith("tiktoken"):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(bpe.FOLDER, name).read_bytes().splitlines())}
        return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    t = Tokenizer.from_file(os.path.join(bpe.FOLDER, name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json"])
def test_other_vocabularies(name):
    encoder, library = bpe.Encoder(name), _other_library(name)
    rnd = random.Random(9)
    alphabet = "abAB \n\t.,'1٣é½ſΣσςİıяЯёЁй课😀\u0301\u200b\x1c\x85"
    texts = [t for t in ODD if t] + ["ab 12345 cd", "ΑΣ ΑΣΑ", "Й й Ё́"] + ["".join(rnd.choices(alphabet, k=rnd.randrange(1, 200))) for _ in range(400)]
    assert _ids(encoder, texts) == [library(t) for t in texts]
    assert _ids(bpe.Encoder(name.split(".")[0] if "multi" in name or "word" in name else name), ["ab cd"]) == [library("ab cd")]


def test_other_kinds_of_files_are_refused(tmp_path):
    with pytest.raises(ValueError, match="no vocabulary"):
        bpe.Encoder("piece_bpe_32k")
    with pytest.raises(ValueError, match="no vocabulary"):
        bpe.Encoder("piece_bpe_32k.model")
    (tmp_path / "odd.json").write_text('{"normalizer": {"type": "NFKC"}, "model": {"type": "BPE", "vocab": {}, "merges": []}, "pre_tokenizer": {"type": "Whitespace"}}')
    with pytest.raises(ValueError, match="NFKC"):
        bpe.Encoder("odd", str(tmp_path))


def test_tables(spark, library):
    rows = [(1, "Привет, мир"), (2, None), (3, ""), (4, "слово " * 50_000), (5, "Привет, мир"), (None, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.ids for r in bpe.token_ids(frame, "text", ["doc_id"]).collect()}
    assert got == {k: library(t or "") for k, t in rows}
    counts = {r.doc_id: r.tokens for r in bpe.token_counts(frame, "text", ["doc_id"]).collect()}
    assert counts == {k: len(v) for k, v in got.items()}
    assert bpe.token_ids(frame.limit(0), "text", ["doc_id"]).count() == 0


SIZES, TARGETS = "id long, source string, size long, repeats int", "source string, target_share double, max_repeats int"


def _mixed(spark, rows, targets, total=None):
    chosen, shares = mix(spark.createDataFrame([(*r, 9) for r in rows], SIZES).repartition(5), "id", "source", "size", spark.createDataFrame(targets, TARGETS), total)
    return {r.id: r for r in chosen.collect()}, {r.source: r for r in shares.collect()}


def test_shares(spark):
    rnd = random.Random(5)
    rows = [(n, "big", rnd.randrange(1, 60)) for n in range(4000)] + [(10_000 + n, "mid", rnd.randrange(1, 60)) for n in range(400)] + [(20_000 + n, "small", rnd.randrange(1, 60)) for n in range(60)]
    rows += [(30_000, "other", 5), (30_001, None, 5), (None, "big", 5), (30_002, "big", 0)]
    targets = [("big", 0.6, 1), ("mid", 0.3, 3), ("small", 0.1, 2), (None, 0.1, 1)]
    chosen, shares = _mixed(spark, rows, targets)
    sizes = {r[0]: r[2] for r in rows}
    for source, share, most in targets[:3]:
        mine = [r for r in chosen.values() if r.source == source]
        assert all(1 <= r.repeats <= most and r.size == sizes[r.id] for r in mine)
        assert max(r.repeats for r in mine) - min(r.repeats for r in mine) <= 1
        assert abs(sum(r.size * r.repeats for r in mine) - shares[source].budget) <= 60
        assert shares[source].reached == sum(r.size * r.repeats for r in mine)
        assert shares[source].share == pytest.approx(share, abs=0.01)
        assert shares[source].met
    assert {r.source for r in chosen.values()} == {"big", "mid", "small"}
    again, _ = _mixed(spark, rows, targets)
    assert {(r.id, r.repeats) for r in again.values()} == {(r.id, r.repeats) for r in chosen.values()}


def test_a_long_record_does_not_break_a_share(spark):
    rnd = random.Random(8)
    rows = [(n, "a", 5000 if n % 20 == 0 else rnd.randrange(20, 80)) for n in range(400)] + [(1000 + n, "b", rnd.randrange(20, 80)) for n in range(600)]
    chosen, shares = _mixed(spark, rows, [("a", 0.5, 1), ("b", 0.5, 1)], total=40_000)
    for s in shares.values():
        assert 0.99 * s.budget <= s.reached <= s.budget == 20_000
        assert s.met
    assert {r.repeats for r in chosen.values()} == {1}
    assert sum(r.sets_total for r in _mixed(spark, rows, [("a", 0.5, 1), ("b", 0.5, 1)])[1].values()) == 1


def test_unmet_and_empty(spark):
    rows = [(n, "a", 10) for n in range(100)] + [(1000 + n, "b", 10) for n in range(2)]
    chosen, shares = _mixed(spark, rows, [("a", 0.5, 1), ("b", 0.4, 3), ("none", 0.1, 2)], total=1000)
    assert shares["a"].reached == 500
    assert shares["b"].reached == 60
    assert not shares["b"].met
    assert shares["none"].reached == 0
    assert all(r.repeats == 3 for r in chosen.values() if r.source == "b")
    assert _mixed(spark, [], [("a", 0.5, 1)])[0] == {}
    assert _mixed(spark, rows, [])[0] == {}
