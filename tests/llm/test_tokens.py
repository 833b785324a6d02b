import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxloom.llm import tokens

PATH = tokens.vocabulary_path()
ENCODER = tokens.Encoder(PATH)
PLAIN = tokens.load_tokenizer(PATH)

PIECES = [
    "the", " ", "  ", "\n", "\n\n", " \n", "\t", "word", "it's", "'s", "'", "12", "345", "é", "ñañ", "\u00a0",
    "\u3000", "\u2028", "\x85", "\x1c", "<|endoftext|>", "<|", "|>", "endof", "...", "!!", "a", "Z", "😀", "\r\n", "0",
]


def plain(text):
    return PLAIN.encode(text, add_special_tokens=False).ids


def unpacked(data):
    return [int.from_bytes(data[i : i + 4], "little") for i in range(0, len(data), 4)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30).map("".join))
def test_pieces_have_the_librarys_ids(text):
    assert unpacked(ENCODER.encode([text])[0]) == plain(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    text = text.encode("utf-8", "replace").decode()
    assert unpacked(ENCODER.encode([text])[0]) == plain(text)


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.sampled_from(PIECES), max_size=120).map("".join),
    st.integers(20, 60),
    st.integers(1, 30),
)
def test_overlapping_chunks_have_the_librarys_ids(text, chunk, overlap):
    assert tokens.huge_ids(PLAIN, text, chunk, overlap) == plain(text)


@pytest.mark.parametrize("text", [
    "", "x", "a" * 900, " " * 700, "\n" * 500, "word " * 300, "ab" * 400 + " " * 300 + "cd" * 300,
    "<|endoftext|>" * 60, "é" * 500, "1" * 700, "!?" * 400,
])
def test_widens_where_nothing_aligns(text):
    for chunk, overlap in ((50, 5), (64, 16), (200, 1)):
        assert tokens.huge_ids(PLAIN, text, chunk, overlap) == plain(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(
    [*PIECES, "It'll", "ÿÀ", "×", "÷", "ª", "²", "½", "_", "`x", "~", "x" * 120, "0x1F", "don't", "Ǆ", "ʼ", "\u0301"]
), max_size=12).map(" ".join))
def test_spaced_pieces(text):
    assert unpacked(ENCODER.encode([text])[0]) == plain(text)


def test_symbols_are_the_vocabularys():
    for byte, symbol in tokens.byte_symbols().items():
        assert PLAIN.token_to_id(chr(symbol)) is not None
    for text in (" a", "\n", "é", "!~"):
        made = text.encode().decode("latin-1").translate(tokens.byte_symbols())
        assert [t.id for t in PLAIN.model.tokenize(made)] == plain(text)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    for row in docs:
        assert unpacked(ENCODER.encode([row.text])[0]) == plain(row.text)


def test_counts_by_chunks_over_a_given_table(spark):
    """Many texts take the chunked way, and all counts are the library's."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    huge = 2_000
    assert sum(len(text) > huge for text in texts.values()) > 50
    for row in tokens.count_tokens(docs, PATH, huge=huge).collect():
        assert row.n_tokens == len(plain(texts[row.doc_id]))


def test_huge_documents_go_by_chunks(texts, monkeypatch):
    joined = "\n".join(texts.values())[:150_000]
    small = tokens.Encoder(PATH, huge=1000)
    sizes = []
    encode = small.tokenizer.encode

    class Watched:
        def encode(self, text, **kind):
            sizes.append(len(text))
            return encode(text, **kind)

        def get_added_tokens_decoder(self):
            return PLAIN.get_added_tokens_decoder()

    small.tokenizer = Watched()
    assert unpacked(small.encode([joined])[0]) == plain(joined)
    assert len(sizes) > 3 and max(sizes) <= tokens.CHUNK_CHARS + tokens.OVERLAP_CHARS


def test_memory_of_pieces_is_bounded(texts):
    small = tokens.Encoder(PATH, remembered=50)
    draw = random.Random(1)
    for _ in range(20):
        text = " ".join(draw.choices(list(texts.values())[0].split(), k=30))
        assert unpacked(small.encode([text])[0]) == plain(text)
        assert len(small.known) <= 50 + 30 and len(small.words) <= 50 + 60


def test_counts(make_docs, given_docs, texts):
    for row in tokens.count_tokens(given_docs, PATH).collect():
        text = texts[row.doc_id]
        ids = plain(text)
        assert (row.n_bytes, row.n_tokens) == (len(text.encode()), len(ids))
        assert row.over_limit == (len(ids) > 512)
    docs = make_docs(
        (1, None), (2, ""), (3, "a <|endoftext|> b"), (None, "x"), (3, "a <|endoftext|> b"),
        (4, "long " * 60_000), n_tokens="n",
    )
    rows = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in tokens.count_tokens(docs, PATH).collect())
    assert rows == [(0, 1, 1), (1, 0, 0), (2, 0, 0), (3, 17, 4), (3, 17, 4), (4, 300_000, 60_001)]
    assert tokens.count_tokens(docs.limit(0), PATH).count() == 0


def test_edges_of_words_in_a_stretch():
    encoding = PLAIN.encode("a first word, \u00e9t\u00e9 2024\n\n  na\u00efve \U0001f600 x" * 20, add_special_tokens=False)
    words, offsets = encoding.word_ids, encoding.offsets
    whole = {offsets[i][0]: i for i in range(len(words)) if i == 0 or words[i] != words[i - 1]}
    for at in [0, 1, 100, 311, 10_000]:
        assert tokens.first_edges(encoding, at) == {k: i for k, i in whole.items() if k < at}
        kept = {k: i for k, i in whole.items() if k >= at}
        assert tokens.last_edges(encoding, at) == (kept or {max(whole): whole[max(whole)]})
    nothing = PLAIN.encode("", add_special_tokens=False)
    assert tokens.first_edges(nothing, 5) == tokens.last_edges(nothing, 0) == {}
