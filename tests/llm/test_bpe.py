"""Encoding by prefix dynamic programming against the definition and a public encoder."""

import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablelens.llm.bpe import EditableEncoding, PrefixEncoder, load_ranks
from tablelens.llm.encoding import TOKENIZER_DIR, count_tokens, encode_documents

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
with open(f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken", "rb") as file:
    RANKS = load_ranks(file.read())
PUBLIC = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = PrefixEncoder(RANKS)

bits = st.sampled_from(["a", "the", " ", "  ", "\n", "é", "ß", "'s", "'", "=", "==", "12", "日本", "\t", "x" * 30, "🙂", "\x1c", "\x85", " ", " foo", "<|endoftext|>", "́", "½", "²", "_", "\r\n"])
texts = st.one_of(st.text(max_size=60), st.lists(bits, max_size=25).map("".join))


def merged(data):
    """The definition: merge the pair of lowest rank, leftmost first, until none is left."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        rank, i = min((RANKS.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank == 1 << 60:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [RANKS[p] for p in parts]


@given(texts)
@settings(max_examples=400, deadline=None)
def test_same_as_public_encoder(text):
    ids = ENCODER.encode(text)
    assert ids == PUBLIC.encode_ordinary(text)
    assert ENCODER.decode(ids) == text.encode() and ENCODER.count(text) == len(ids)


def test_tokens_that_fit():
    rng = random.Random(5)
    common = [t for t in RANKS.values() if len(ENCODER.tokens[t]) <= 4]
    for _ in range(20_000):
        a, b = rng.choice(common), rng.choice(common)
        assert ENCODER.fits(a, b) == (merged(ENCODER.tokens[a] + ENCODER.tokens[b]) == [a, b])


@given(st.binary(max_size=40))
@settings(max_examples=200, deadline=None)
def test_every_prefix(data):
    last = ENCODER.extend_last(data, [])
    assert len(last) == len(data)
    for n in range(len(data) + 1):
        want = merged(data[:n]) if data[:n] not in RANKS else [RANKS[data[:n]]]
        assert ENCODER.back(last[:n]) == want


@given(texts, texts, st.data())
@settings(max_examples=300, deadline=None)
def test_appends_and_edits(text, more, data):
    e = EditableEncoding(ENCODER, text)
    e.append(more)
    text += more
    assert e.text == text and e.ids() == PUBLIC.encode_ordinary(text)
    for _ in range(3):
        begin = data.draw(st.integers(0, len(text)))
        end = data.draw(st.integers(begin, len(text)))
        new = data.draw(bits | st.just(""))
        e.edit(begin, end, new)
        text = text[:begin] + new + text[end:]
        assert e.text == text and e.ids() == PUBLIC.encode_ordinary(text)


def test_edits_reencode_little():
    text = "some words in a row, " * 5000
    e = EditableEncoding(ENCODER, text)
    e.edit(50_000, 50_003, "new")
    assert e.reencoded < 60 and e.ids() == PUBLIC.encode_ordinary(e.text)
    e.append("and more")
    assert e.reencoded < 20


@pytest.mark.parametrize("text", ["a" * 200_000, " " * 100_000, "=" * 50_000, "ab" * 50_000, "日" * 30_000, "\n \t" * 30_000])
def test_very_long_pieces(text):
    assert ENCODER.encode(text) == PUBLIC.encode_ordinary(text)


def test_documents(spark):
    rows = [(1, "a text"), (2, ""), (3, None), (4, "a text"), (4, "a text"), (5, "<|endoftext|>"), (6, "x" * 100_000), (7, "naïve\r\n 🙂")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("ids", "tokens", "lang")})
    got = sorted((r["doc_id"], list(r["ids"])) for r in encode_documents(df).collect())
    assert got == sorted((i, PUBLIC.encode_ordinary(t) if t else []) for i, t in rows)
    counts = sorted(tuple(r) for r in count_tokens(df, ["doc_id"]).collect())
    assert counts == sorted((i, len(PUBLIC.encode_ordinary(t or ""))) for i, t in rows)
    assert encode_documents(df.limit(0)).collect() == []
