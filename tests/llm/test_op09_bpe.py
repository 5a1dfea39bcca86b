import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import op09_prefix_bpe as op
from graphloom.llm.common import tokenizer_file
from graphloom.llm.pieces import UNITS
from tests.llm.helpers import documents, edge_rows, write

PATH = tokenizer_file("byte_bpe_multi_50k.tiktoken")
RANKS = op.read_ranks(PATH)
LIB = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
BPE, ENCODE = op._make_coder(PATH, P.PATTERN)


@given(st.text(max_size=200) | st.text(alphabet=" \n\tab'slé\x1c1.,!\xa0ñ日　", max_size=80))
@settings(max_examples=400, deadline=None)
def test_ids_equal_the_library(text):
    ids = np.frombuffer(ENCODE(text), "<u4").tolist()
    assert ids == LIB.encode_ordinary(text)
    assert BPE.decode(ids) == text.encode()
    assert "".join(UNITS.findall(text)) == text


@given(st.binary(max_size=60), st.binary(max_size=30), st.integers(0, 60), st.integers(0, 60))
@settings(max_examples=200, deadline=None)
def test_appends_and_edits_equal_encoding_anew(text, new, a, b):
    last = BPE.prefixes(text)
    more, after = BPE.append(text, last, new)
    assert after == BPE.prefixes(more)
    a, b = sorted((min(a, len(text)), min(b, len(text))))
    edited, out, _ = BPE.replace(text, last, a, b, new)
    assert edited == text[:a] + new + text[b:] and out == BPE.prefixes(edited)


def test_edit_recomputes_only_near_it():
    text = b"thequickbrownfox" * 200
    _, out, made = BPE.replace(text, BPE.prefixes(text), 100, 103, b"zz")
    assert made < 3 * BPE.max_len + 10 and BPE.walk(out) == BPE.walk(BPE.prefixes(text[:100] + b"zz" + text[103:]))


def test_every_prefix_is_the_library_encoding():
    text = "unbelievableness überraschend"
    last = BPE.prefixes(text.encode())
    for k in range(1, len(text.encode()) + 1):
        part = text.encode()[:k]
        assert BPE.walk(last[: k + 1]) == list(LIB._encode_single_piece(part))


def test_query_on_edge_rows(spark, tmp_path):
    got = op.op9_prefix_bpe(spark, write(spark, tmp_path, documents=documents(spark))).collect()
    want = []
    for r in edge_rows():
        ids = LIB.encode_ordinary(r[1] or "")
        want.append((r[0] is None, r[0] or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == sorted(want)


def test_columns_round_trip_and_empty(spark, tmp_path):
    df = documents(spark)
    back = op.decode_column(op.encode_column(df, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert sorted(bytes(r["bytes"]) for r in back) == sorted((r[1] or "").encode() for r in edge_rows())
    assert op.op9_prefix_bpe(spark, write(spark, tmp_path, documents=documents(spark, []))).count() == 0


@pytest.mark.parametrize("pair", [("a", "b"), ("th", "e"), (" t", "he")])
def test_fits_is_what_merging_says(pair):
    a, b = (RANKS[x.encode()] for x in pair)
    assert BPE.fits(a, b) == (list(LIB._encode_single_piece("".join(pair).encode())) == [a, b])


OTHER = r"\w{1,3}| +\w|\W+"
_, OTHER_ENCODE = op._make_coder(PATH, OTHER)


@given(st.text(max_size=120) | st.text(alphabet=" \nab'é.,1", max_size=80))
@settings(max_examples=150, deadline=None)
def test_another_pattern_is_followed(text):
    lib = tiktoken.Encoding("other", pat_str=OTHER, mergeable_ranks=RANKS, special_tokens={})
    assert np.frombuffer(OTHER_ENCODE(text), "<u4").tolist() == lib.encode_ordinary(text)


def test_very_long_pieces():
    for text in ("a" * 50_000, "ab" * 20_000, " " * 30_000, "日本" * 5_000):
        ids = np.frombuffer(ENCODE(text), "<u4").tolist()
        assert BPE.decode(ids) == text.encode() and len(ids) <= len(text.encode())
    assert np.frombuffer(ENCODE("ab" * 2_000), "<u4").tolist() == LIB.encode_ordinary("ab" * 2_000)
