"""Token ids against a public library, on all texts of a test table and on made-up ones."""

from __future__ import annotations

import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quaver.llm import tokens

tiktoken = pytest.importorskip("tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(tokens.DEFAULT_VOCABULARY), reason="no vocabulary here")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("reference", pat_str=PATTERN, mergeable_ranks=tokens.vocabulary().ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("a's'tredvlm' \n\t12é日’-!　\xa0½ǅ"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=5))
def test_any_text(texts):
    reference = tiktoken.Encoding("reference", pat_str=PATTERN, mergeable_ranks=tokens.vocabulary().ranks, special_tokens={})
    got = [ids for ids, _ in tokens.vocabulary().encode(texts)]
    assert got == [reference.encode_ordinary(t) for t in texts]


def test_table(spark, reference):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    rows = tokens.encoded(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), offsets="at").collect()
    for r in rows:
        assert r["ids"] == reference.encode_ordinary(r["text"] or "")
        assert len(r["at"]) == len(r["ids"]) and list(r["at"]) == sorted(r["at"])


def test_scan_is_associative():
    every, classes, table = tokens._monoid()
    r = np.random.default_rng(0)
    for _ in range(200):
        kinds = r.integers(0, 9, r.integers(1, 40))
        states, s = [], 0
        for k in kinds:
            s = every[classes[k]][s]
            states.append(s)
        assert tokens.scan(classes[kinds]).tolist() == states
    a, b, c = r.integers(0, len(every), (3, 500))
    assert (table[table[a, b], c] == table[a, table[b, c]]).all()
