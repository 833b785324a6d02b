import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxloom.llm import pieces, queries
from voxloom.llm.tokens import vocabulary_path

sentencepiece = pytest.importorskip("sentencepiece")

PATH = vocabulary_path(pieces.MODEL)
CODER = pieces.load_coder(PATH)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
PARTS = [
    "the", " ", "  ", "\n", "▁", "ab", "aa", "a", " a", "é", "你", "好", "\U0001f600", "1", "23", "́", "\x00",
    "ing", " " * 30, "<s>", "</s>", "<0x41>", "-" * 20, "==", " \n", "Z", "ＡＢ", "\t", "�",
]


def coded(text):
    return CODER.encode([text])[0].tolist()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=30).map("".join))
def test_parts_have_the_librarys_ids(text):
    assert coded(text) == LIBRARY.encode(text)
    assert CODER.decode(coded(text)) == LIBRARY.decode(coded(text))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    text = text.encode("utf-8", "replace").decode()
    assert coded(text) == LIBRARY.encode(text)
    assert CODER.decode(coded(text)) == LIBRARY.decode(coded(text))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31_999), st.integers(0, 258)), max_size=12))
def test_any_ids_decode_as_in_the_library(ids):
    assert CODER.decode(ids) == LIBRARY.decode(ids)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    texts = [row.text or "" for row in docs]
    for text, ids in zip(texts, CODER.encode(texts), strict=True):
        assert ids.tolist() == LIBRARY.encode(text)
        assert CODER.decode(ids.tolist()) == LIBRARY.decode(ids.tolist())


@pytest.mark.parametrize("text", [
    " " * 20_000, "a" * 50_000, "the" * 30_000, "ab " * 30_000, "\n" * 20_000,
    "".join(random.Random(3).choices("abcdefghijklmnopqrstuvwxyz", k=60_000)),
    "".join(random.Random(4).choices("你好吗我是的不了", k=20_000)),
], ids=range(7))
def test_very_long_texts(text):
    assert coded(text) == LIBRARY.encode(text)


@pytest.mark.parametrize("block", [1, 2, 3, 7, 20])
def test_blocks_end_where_no_piece_crosses(monkeypatch, block):
    monkeypatch.setattr(pieces, "BLOCK_CHARS", block)
    draw = random.Random(block)
    for _ in range(300):
        text = "".join(draw.choices(PARTS, k=draw.randrange(12)))
        assert coded(text) == LIBRARY.encode(text)


def test_without_the_word_rule(monkeypatch):
    whole = pieces.Coder(PATH)
    whole.words = None
    draw = random.Random(5)
    for _ in range(200):
        text = "".join(draw.choices(PARTS, k=draw.randrange(15)))
        assert whole.encode([text])[0].tolist() == LIBRARY.encode(text)


class Toy(pieces.Coder):
    """A vocabulary of three letters in which merges may make better pairs than their own."""

    def __init__(self, names):
        self.size = len(names)
        self.symbols = {name: i for i, name in enumerate(names)}
        self.pairs = pieces.Pairs(self.pair_table(dict(enumerate(range(len(names))))))


def one_by_one(table, symbols):
    """Merge the best, leftmost pair again and again."""
    symbols = list(symbols)
    while True:
        found = [
            (*table[a * pieces.WIDTH + b], place)
            for place, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False))
            if a * pieces.WIDTH + b in table
        ]
        if not found:
            return symbols
        _, merged, place = min(found, key=lambda f: (f[0], f[2]))
        symbols[place : place + 2] = [merged]


@settings(max_examples=300, deadline=None)
@given(st.randoms(use_true_random=False))
def test_rounds_equal_merging_one_by_one(draw):
    longer = ["".join(draw.choices("abc", k=draw.randint(2, 5))) for _ in range(12)]
    names = [*"abc", *dict.fromkeys(longer)]
    rest = names[3:]
    draw.shuffle(rest)
    toy = Toy(names[:3] + rest)
    texts = ["".join(draw.choices("abc", k=draw.randint(1, 30))) for _ in range(4)]
    symbols = pieces.np.array([toy.symbols[c] for text in texts for c in text], pieces.np.int64)
    span = pieces.np.repeat(pieces.np.arange(4), [len(t) for t in texts])
    merged, owner = toy.merged(symbols, span)
    for n, text in enumerate(texts):
        want = one_by_one(toy.pairs.table, [toy.symbols[c] for c in text])
        assert merged[owner == n].tolist() == want
        assert toy.by_queue([toy.symbols[c] for c in text]).tolist() == want


def test_memory_of_words_is_bounded(texts):
    small = pieces.Coder(PATH, remembered=50)
    draw = random.Random(1)
    for _ in range(20):
        text = " ".join(draw.choices(list(texts.values())[0].split(), k=30))
        assert small.encode([text])[0].tolist() == LIBRARY.encode(text)
        assert len(small.known) <= 50 + 40


def test_tables(spark, make_docs):
    docs = make_docs(
        (1, None), (2, ""), (3, "a b"), (None, "x"), (3, "a b"), (4, "long " * 60_000),
        ids="i", decoded="d",
    )
    rows = pieces.encode_texts(docs, PATH, keys=("doc_id", "ids"), decoded=True).collect()
    got = sorted((row[0] or 0, row[1], len(row[2]), row[3]) for row in rows)
    plain = [(0, "x"), (1, ""), (2, ""), (3, "a b"), (3, "a b"), (4, "long " * 60_000)]
    assert got == [(i, "i", len(LIBRARY.encode(t, add_eos=True)), t) for i, t in plain]
    none = pieces.encode_texts(docs.limit(0), PATH)
    assert none.columns == ["doc_id", "ids"] and none.count() == 0
    lists = spark.createDataFrame(
        [(1, [13, None, 14]), (2, None), (3, [])], "text long, ids array<int>"
    )
    back = pieces.decode_ids(lists, PATH, keys=()).collect()
    assert sorted(row.text for row in back) == sorted(["", "", LIBRARY.decode([13, 14])])
    with pytest.raises(ValueError):
        CODER.decode([32_000])


def test_round_trip(given_docs, texts):
    encoded = pieces.encode_texts(given_docs, PATH)
    for row in pieces.decode_ids(encoded, PATH).collect():
        assert row.text == (texts[row.doc_id] or "").replace("▁", " ")


def test_query(spark, texts):
    for row in queries.op13_pieces(spark, "/root/testdata/sf0.001").collect():
        ids = LIBRARY.encode(texts[row.doc_id] or "", add_eos=True)
        joined = " ".join(map(str, ids))
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
