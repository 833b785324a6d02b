"""Token ids and token counts of whole texts.

The tokenizer library splits a text into words by a pattern and merges the bytes
of each word. A text of ordinary length is cut before every space or line feed
that stands between two other characters: the pattern starts a word there,
whatever comes before, so the pieces have the same ids alone as within the text.
Ids of pieces already seen are remembered. In a new piece of plain characters
(``PLAIN``) the words are plain to see and go to the library's merges directly;
any other piece goes to the library whole, and so does a text with two white-space
characters in a row, other white space, or a special token's string.

A huge text is encoded by overlap resynchronisation (``huge_ids``).

Defined results: a NULL text counts as empty, with no token; repeated rows are
counted each; a text of any length is encoded whole; an empty table gives an
empty result. Columns beside the keys are left out.
"""

import os
import re
import struct

from pyspark.sql import functions as F

from voxloom.llm.shared import byte_list

VOCABULARY = "byte_bpe_50k.json"
#: Texts of more characters are encoded in overlapping chunks: where they are
#: counted, and where their ids are wanted too. Chunks are half as long.
COUNTED_CHARS, HUGE_CHARS = 1 << 13, 1 << 16
CHUNK_CHARS, OVERLAP_CHARS = 1 << 15, 1 << 9
#: Pieces, and words, that a task remembers, and their most characters; beyond
#: that many it starts afresh.
REMEMBERED, LONG_PIECE = 500_000, 100
ROWS_AT_ONCE = 256

#: White space but space and line feed.
OTHER_SPACES = (
    "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
#: The library's words over ASCII without the apostrophe, and Latin-1 letters:
#: a line feed, or letters, digits or other characters with a space before.
PLAIN = re.compile(r"\n| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[!-&(-/:-@\[-`{-~]+")


def vocabulary_path(name=VOCABULARY):
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols():
    """The character that stands for each byte in the vocabulary.

    Printable Latin-1 characters stand for themselves, the other bytes in turn
    for the characters from 256 on.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [byte for byte in range(256) if byte not in printable]
    return {b: b for b in printable} | {b: 256 + n for n, b in enumerate(others)}


def load_tokenizer(path):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def first_edges(encoding, before):
    """{character where it starts: index of its first token} of the words that start before one."""
    edges, earlier = {}, None
    for i in range(len(encoding)):
        word = encoding.token_to_word(i)
        if i == 0 or word != earlier:
            start = encoding.token_to_chars(i)[0]
            if start >= before:
                break
            edges[start] = i
        earlier = word
    return edges


def last_edges(encoding, since):
    """``first_edges`` of the words that start at a character or later, and of the very last word."""
    edges, last = {}, len(encoding) - 1
    word = encoding.token_to_word(last) if last >= 0 else None
    for i in range(last, -1, -1):
        earlier = encoding.token_to_word(i - 1) if i else None
        if i == 0 or word != earlier:
            start = encoding.token_to_chars(i)[0]
            if start < since and edges:
                break
            edges.setdefault(start, i)
        word = earlier
    return edges


def huge_ids(tokenizer, text, chunk=CHUNK_CHARS, overlap=OVERLAP_CHARS):
    """Ids of a text, of which at most one chunk is encoded at a time.

    Two neighbouring chunks share ``overlap`` characters. The library's words
    depend on what follows a word's start and on nothing before it. So where
    both chunks start a word at the same character, all later words of the
    right chunk are those of the whole text if that character starts a word
    there; and it does if the left chunk isn't cut short near it, which holds
    up to the left chunk's last words: a guard wider than any special token's
    string, and its very last word, are left out. If no such place is shared,
    the overlap is doubled, at last to the whole left chunk and more.
    """
    specials = [token.content for token in tokenizer.get_added_tokens_decoder().values()]
    guard = 1 + max(map(len, specials), default=0)

    def encode(start, end):
        return tokenizer.encode(text[start:end], add_special_tokens=False)

    ids = []
    start, end = 0, min(chunk, len(text))
    left, skipped = encode(start, end), 0
    while end < len(text):
        width = overlap
        while True:
            right_start = max(start, end - width)
            right_end = min(len(text), end + chunk)
            right = encode(right_start, right_end)
            shared = seam(left, start, end, right, right_start, guard)
            if shared is not None and shared[0] >= skipped:
                break
            if right_start == start:
                # Everything from the last seam on is in this one encoding.
                shared = (skipped, skipped)
                break
            width *= 2
        left_to, right_from = shared
        ids.extend(left.ids[skipped:left_to])
        start, end, left, skipped = right_start, right_end, right, right_from
    ids.extend(left.ids[skipped:])
    return ids


def seam(left, left_start, left_end, right, right_start, guard):
    """Token indexes, left and right, of the last proven common word start; None if none."""
    # Only words in the overlap are looked at: the chunks are many times as long.
    left_edges = last_edges(left, right_start - left_start)
    if not left_edges:
        return None
    last_word = left_start + max(left_edges)
    limit = min(last_word, left_end - guard)
    right_edges = first_edges(right, limit - right_start)
    for place in sorted(right_edges, reverse=True):
        at = right_start + place
        # The right chunk's own start is a word start by its cut alone.
        if place > 0 and at - left_start in left_edges:
            return left_edges[at - left_start], right_edges[place]
    return None


class Encoder:
    """Texts to ids, as little-endian unsigned 32-bit numbers in bytes."""

    def __init__(self, path, huge=HUGE_CHARS, remembered=REMEMBERED):
        self.tokenizer = load_tokenizer(path)
        self.merge = self.tokenizer.model.tokenize
        self.symbols = byte_symbols()
        self.huge, self.remembered, self.known, self.words = huge, remembered, {}, {}
        self.chunk = min(CHUNK_CHARS, max(huge // 2, 2 * OVERLAP_CHARS))
        self.specials = [
            token.content for token in self.tokenizer.get_added_tokens_decoder().values()
        ]

    def cut(self, text):
        """(first piece, later pieces without their space), or None where that isn't sure."""
        spaces = OTHER_SPACES[:8] if text.isascii() else OTHER_SPACES
        if (
            len(text) > self.huge
            or any(space in text for space in spaces)
            or any(special in text for special in self.specials)
        ):
            return None
        first, *later = text.replace("\n", " \n").split(" ")
        distinct = set(later)
        if "" in distinct or ("\n" in distinct and "\n" in later[:-1]):
            return None
        return first, later, distinct

    def encode(self, texts):
        """Ids of each of a few texts."""
        if len(self.known) > self.remembered:
            self.known.clear()
        if len(self.words) > self.remembered:
            self.words.clear()
        known, result = self.known, []
        for text in texts:
            cut = self.cut(text)
            if cut is not None:
                first, later, distinct = cut
                new = distinct.difference(known)
                if max(map(len, new), default=0) <= LONG_PIECE >= len(first):
                    for piece in new:
                        known[piece] = self.piece(piece if piece[0] == "\n" else " " + piece)
                    parts = [self.piece(first), *map(known.__getitem__, later)]
                    result.append(b"".join(parts))
                    continue
            if len(text) > self.huge:
                ids = huge_ids(self.tokenizer, text, self.chunk)
            else:
                ids = self.whole(text)
            result.append(packed(ids))
        return result

    def whole(self, text):
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def piece(self, text):
        """Ids of a piece, by its words if they are plain."""
        words = PLAIN.findall(text)
        if sum(map(len, words)) != len(text):
            return packed(self.whole(text))
        return b"".join([self.words.get(word) or self.word(word) for word in words])

    def word(self, word):
        symbols = word.encode().decode("latin-1").translate(self.symbols)
        ids = packed([token.id for token in self.merge(symbols)])
        self.words[word] = ids
        return ids


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def encoded_slices(batches, path, huge=HUGE_CHARS):
    """Slices of Arrow batches with the ids of their ``text``; the encoder serves the whole task."""
    encoder = Encoder(path, huge)
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(start, ROWS_AT_ONCE)
            texts = byte_list(part.column("text"))
            yield part, texts, encoder.encode([t.decode("utf-8", "replace") for t in texts])


def count_tokens(docs, path, limit=512, keys=("doc_id",), huge=COUNTED_CHARS):
    """Bytes and tokens of every text: keys, ``n_bytes``, ``n_tokens``, ``over_limit``."""
    import pyarrow as pa

    def count(batches):
        for part, texts, ids in encoded_slices(batches, path, huge):
            columns = [part.column(key) for key in keys]
            sizes = [pa.array(map(len, texts), pa.int64())]
            counts = [pa.array([len(x) // 4 for x in ids], pa.int64())]
            names = [*keys, "n_bytes", "n_tokens"]
            yield pa.RecordBatch.from_arrays(columns + sizes + counts, names)

    narrow = docs.select(*keys, "text")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema[:-1])
    return narrow.mapInArrow(count, f"{types}, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > limit
    )
