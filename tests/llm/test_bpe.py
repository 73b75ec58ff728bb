import hashlib

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from auditloom.llm import bpe
from tests.llm.cases import docs, rows


@pytest.fixture(scope="module")
def reference():
    ranks = {t: i for i, t in enumerate(bpe.load_ranks())}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_same_as_merging_by_rank(reference, text):
    enc, dec = bpe.coder()
    ids = enc.encode(text)
    assert ids == reference.encode_ordinary(text)
    assert dec.decode(ids).decode("utf-8") == text


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, "https://example.com/a?b=c&d=" * 40, "ÀÉÎ" * 500, " " * 3000 + "x"])
def test_long_pieces_are_exact(reference, text):
    assert bpe.coder()[0].encode(text) == reference.encode_ordinary(text)


def test_table_of_all_cases(spark):
    got = bpe.encode_table(docs(spark)).collect()
    data = rows()
    assert len(got) == len(data)
    by = sorted(((r.doc_id, r.decoded_md5, r.round_trip) for r in got), key=repr)
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert by == sorted(((r[0], None if r[1] is None else md5(r[1]), None if r[1] is None else True) for r in data), key=repr)
    assert all(r.token_ids is None for r in got if r.doc_id == 4)
    assert all(r.n_tokens == len(r.token_ids or []) for r in got)


def test_decode_table_is_the_inverse(spark):
    back = bpe.decode_table(bpe.encode_table(docs(spark))).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=repr) == sorted(((r[0], r[1]) for r in rows()), key=repr)


def test_empty_table(spark):
    assert bpe.encode_table(docs(spark, [])).count() == 0
