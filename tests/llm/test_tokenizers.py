"""Byte-level BPE and token counts against the libraries, and round trips."""

import base64
import random

import pytest
import public_tokenizers
import sentencepiece
import tiktoken
from hypothesis import example, given, settings
from hypothesis import strategies as st

from gridloom.llm import bpe, tokencount

RANKS, MODEL, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


TEXT = st.one_of(st.text(max_size=80), st.text("ab ", max_size=300), st.text("aaé漢🎉 \n\t\x1c\x85　'.!1", max_size=120))


@settings(max_examples=300, deadline=None)
@given(TEXT)
@example("a" * 5000)
@example("<|endoftext|> it's  we'll\n\n ")
def test_encoding_equals_the_library_and_decodes(library, text):
    c = bpe.codec(RANKS, PATTERN)
    ids = c.encode(text)
    assert ids == library.encode_ordinary(text) and c.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=200), st.integers(0, 200))
def test_join_is_the_monoids_operation(data, at):
    c = bpe.codec(RANKS, PATTERN)
    assert c.join(c.merge(data[:at]), c.merge(data[at:])) == c.merge(data) == c.encode_bytes(data)


@settings(max_examples=300, deadline=None)
@given(TEXT)
@example("<s>hi</s>  ▁x▁▁ y ")
@example("漢" * 3000)
def test_counts_equal_the_library(pieces, text):
    assert tokencount.counter(MODEL).count([text, "", text]).tolist() == [len(pieces.encode(text)), 0, len(pieces.encode(text))]


@settings(max_examples=150, deadline=None)
@given(TEXT, st.lists(st.integers(0, 300), max_size=6), st.randoms())
def test_state_maps_of_chunks_cut_anywhere_compose(pieces, text, cuts, draw):
    t = tokencount.counter(MODEL).transducer
    marked = tokencount.BLANK + text.replace(" ", tokencount.BLANK) if text else ""
    cuts = [0, *sorted(min(c, len(marked)) for c in cuts), len(marked)]
    maps = [tokencount.StateMap(t, marked[a:b]) for a, b in zip(cuts, cuts[1:])]
    assert tokencount.compose(maps)(0) == t.run(marked) and t.run(marked)[1] == len(pieces.encode(text))
    while len(maps) > 1:  # any shape of the tree
        i = draw.randrange(len(maps) - 1)
        maps[i : i + 2] = [tokencount.Composed(*maps[i : i + 2])]
    assert maps[0](0) == t.run(marked)


def test_a_long_text_without_blanks(pieces):
    draw = random.Random(3)
    text = "".join(draw.choice(["the", "ing", "ß", "tion", "漢字", "0x", "é", "a"]) for _ in range(500_000))
    assert len(text) > 10**6 and tokencount.counter(MODEL).count([text]).tolist() == [len(pieces.encode(text))]


def test_transducer_states_are_made_again_when_full(pieces, monkeypatch):
    monkeypatch.setattr(tokencount, "STATES", 20)
    monkeypatch.setattr(tokencount, "CACHE", 5)
    c, text = tokencount.Counter.load(MODEL), "some words and other words, again and again " * 5
    assert c.count([text]).tolist() == [len(pieces.encode(text))]


def test_odd_rows(odd, none, library, pieces):
    rows = odd.collect()
    plain = lambda out: sorted(str((r[0], *(list(x) for x in r[1:]))) for r in out.collect())
    coded = [(r.doc_id, library.encode_ordinary(r.text or ""), list((r.text or "").encode())) for r in rows]
    assert plain(bpe.encode_decode(odd, RANKS, PATTERN)) == sorted(map(str, coded))
    assert plain(bpe.decode(bpe.encode(odd, RANKS, PATTERN), RANKS, PATTERN)) == sorted(str((i, b)) for i, _, b in coded)
    got = sorted(str(tuple(r)) for r in tokencount.count_tokens(odd, MODEL).collect())
    assert got == sorted(str((r.doc_id, len((r.text or "").encode()), len(pieces.encode(r.text or "")), len(pieces.encode(r.text or "")) > 4096)) for r in rows)
    assert bpe.digests(none, RANKS, PATTERN).count() == tokencount.count_tokens(none, MODEL).count() == 0


def test_a_worker_keeps_the_vocabulary_only(spark):
    import pyarrow as pa

    docs = spark.range(400).selectExpr("id as doc_id", "concat('some ', sha1(string(id)), ' text') as text").repartition(4)
    assert bpe.encode(docs, RANKS, PATTERN).selectExpr("sum(size(ids))").first()[0] > 400

    def kept(batches):
        c = bpe.codec(RANKS, PATTERN)
        yield pa.RecordBatch.from_pydict({"n": [len(c.known) + len(c.known.old) + len(c.short) + len(c.short.old) + len(c.fits)]}, pa.schema([("n", pa.int64())]))

    assert {r.n for r in spark.range(64).repartition(16).mapInArrow(kept, "n long").collect()} == {0}
