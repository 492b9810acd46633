import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm.op2_bpe import RANKS, Codec, PrefixEncoder, _mapped, codec, encode_documents, load_ranks


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path(RANKS)), special_tokens={})


CASES = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n\n a", "don't we'll I'd", "tab\tnew\r\nline\x0b\x0cend", "x\x1cy \x1d z", "é ñ ü ß 漢字 かな 🙂🙂", "12 345 6,7", "a b c  d", "<|endoftext|> ok", "zz" * 3000, "=" * 500, "Ab1" * 2000, "　wide　 space 　"]


def test_equals_library(reference):
    c = codec(RANKS, P.PATTERN)
    rng = random.Random(7)
    texts = CASES + ["".join(rng.choice("ab Z\n\t'.é0漢") for _ in range(rng.randrange(60))) for _ in range(1500)]
    for t in texts:
        ids = c.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(t), repr(t)
        assert c.decode(ids) == t.encode()


@given(st.text(max_size=80))
@settings(max_examples=300, deadline=None)
def test_equals_library_any_text(t):
    c = codec(RANKS, P.PATTERN)
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=c.v.ranks, special_tokens={}) if not hasattr(c, "ref") else c.ref
    c.ref = ref
    assert np.frombuffer(c.encode(t), "<u4").tolist() == ref.encode_ordinary(t)


def test_prefixes_appends_and_edits():
    v = codec(RANKS, P.PATTERN).v
    rng = random.Random(3)
    data = bytes(rng.choice(b"thelanding ") for _ in range(300))
    e = PrefixEncoder(v, data)
    for end in (0, 1, 7, 150, 300):
        assert e.ids(end) == v.merged(data[:end])
    grown = PrefixEncoder(v)
    for i in range(0, 300, 37):
        grown.append(data[i : i + 37])
    assert grown.ids() == e.ids()
    for _ in range(40):
        a = rng.randrange(len(e.data) + 1)
        b = min(len(e.data), a + rng.randrange(6))
        new = bytes(rng.choice(b"tion ") for _ in range(rng.randrange(6)))
        kept = e.last[: a + 1]
        e.edit(a, b, new)
        assert e.last[: a + 1] == kept
        assert e.ids() == v.merged(e.data)


def test_documents(spark, reference):
    rows = [(1, "Hello world"), (2, None), (3, ""), (4, "Hello world"), (None, "x" * 50_000), (1, "Hello world")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS n_tokens", "'x' AS ids")
    got = sorted(map(tuple, _mapped(df, RANKS, P.PATTERN, True).collect()), key=str)
    want = []
    for i, t in rows:
        ids = np.array(reference.encode_ordinary(t or ""), "<u4").tobytes()
        want.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    full = encode_documents(df).where("doc_id = 4").first()
    assert bytes(full.decoded) == b"Hello world"
    assert _mapped(df.where("false"), RANKS, P.PATTERN, True).count() == 0


def test_a_word_that_other_chunks_had_is_encoded_once(reference):
    """With other marks a word is another chunk, but the same piece."""
    c, asked = Codec(P.path(RANKS), P.PATTERN), []
    inner = c.encode_pieces
    c.encode_pieces = lambda pieces: asked.extend(pieces) or inner(pieces)
    texts = ["so qwortelblum, it is", "so qwortelblum. it is", "so (qwortelblum qwortelblum) it " + "y" * 100, "it qwortelblum; " + "y" * 100]
    for t in texts:
        assert np.frombuffer(c.encode(t), "<u4").tolist() == reference.encode_ordinary(t)
    assert asked.count(" qwortelblum") == 1 and max(map(len, (*c.young, *c.young_pieces))) <= 64
