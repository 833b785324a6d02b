"""SentencePiece encoding and decoding of whole texts by vectorised merge rounds.

The model is a byte-pair model over characters, with byte fallback, an identity
normaliser and a space put before every text. ``load_coder`` holds the coder to
the library on a few probes and refuses a model of another kind.

Encoding: a merge can only join characters that stand side by side in some piece
of the vocabulary, so a text falls apart, without loss, into words and these into
spans at every pair of characters that no piece holds. All spans not met before
lie one behind the other in one numpy array of symbols. A round finds the rank of
the best pair of every span (a segmented minimum), merges that pair wherever it
stands, leftmost first and without overlap, in all spans at once, and closes the
gaps; spans without a pair leave. Merging all places of a pair at once is what the
library does one at a time, unless a merge makes a pair that is as good or better;
the round is then not applied to that span, which is finished by a queue of pairs.

Defined results: a NULL text counts as empty, which has no id but the end's;
repeated rows are coded each; a text may be of any length (words are coded about a
million characters at a time, and no step grows faster than a word's length times
the number of distinct ranks in it); an empty table gives an empty result; other
columns stay, whatever their names, where they are asked for as ``keys``. NULL ids
are dropped, a NULL list of ids decodes as an empty one, ids outside the vocabulary
raise.
"""

import heapq
import re
from itertools import chain

import numpy as np
from pyspark.sql import functions as F

from voxloom.llm.shared import byte_list

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Characters of a text that are cut into words at once.
BLOCK_CHARS = 1 << 20
#: Words that a task remembers; beyond that many it starts afresh.
REMEMBERED = 500_000
ROWS_AT_ONCE = 256
#: Symbols from here on are characters that are no pieces; any symbol is below ``WIDTH``.
WIDTH = 1 << 21
NONE = np.iinfo(np.int32).max
PROBES = [
    "", " ", "   a  b ", "\n", "a▁b", "<s>x</s>", "<0x0A>", "héllo wörld", "你好\U0001f600",
    "\x00", "aaaaaaaaaa", " " * 40 + "x", "é", "Ａ", "1234567", "The quick brown fox's tail.",
]


class Pairs:
    """Rank and merged piece of every pair of symbols that makes a piece."""

    def __init__(self, table):
        keys = np.array(sorted(table), np.int64)
        found = [table[key] for key in keys.tolist()]
        self.keys = np.append(keys, np.iinfo(np.int64).max)
        self.ranks = np.array([rank for rank, _ in found] + [NONE], np.int32)
        self.ids = np.array([merged for _, merged in found] + [0], np.int32)
        self.table = table

    def look_up(self, left, right):
        wanted = left * WIDTH + right
        at = np.searchsorted(self.keys, wanted)
        known = self.keys[at] == wanted
        return np.where(known, self.ranks[at], NONE), self.ids[at]


class Coder:
    """Texts to ids and back, by one model."""

    def __init__(self, path, remembered=REMEMBERED):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.names = [model.id_to_piece(i) for i in ids]
        kinds = [(model.is_control(i), model.is_unknown(i), model.is_byte(i)) for i in ids]
        if any(model.is_unused(i) for i in ids):
            raise ValueError("models with unused pieces are not supported")
        self.size, self.end, self.unknown = len(self.names), model.eos_id(), model.unk_id()
        self.byte_ids = [i for i in ids if kinds[i][2]]
        if len(self.byte_ids) != 256:
            raise ValueError("the model needs a piece for each byte")
        normal = [i for i in ids if not any(kinds[i])]
        self.symbols = {self.names[i]: i for i in normal}
        scores = sorted({model.get_score(i) for i in normal}, reverse=True)
        rank_of = {score: rank for rank, score in enumerate(scores)}
        self.pairs = Pairs(self.pair_table({i: rank_of[model.get_score(i)] for i in normal}))
        together = {a + b for name in self.symbols for a, b in zip(name, name[1:], strict=False)}
        self.together = np.array(sorted(ord(a) * WIDTH + ord(b) for a, b in together), np.int64)
        self.together = np.append(self.together, np.iinfo(np.int64).max)
        self.first = np.arange(0x110000, dtype=np.int64) + self.size
        for name, i in self.symbols.items():
            if len(name) == 1:
                self.first[ord(name)] = i
        inner = {b for a, b in together if b == SPACE and a != SPACE}
        feeds = any("\n" in pair for pair in together)
        # Whether pieces hold a space only in front, and no line feed beside others.
        self.words = None if inner or feeds else re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+")
        self.surfaces = [self.surface(i, kinds[i]) for i in ids]
        self.is_byte = np.array([kind[2] for kind in kinds])
        self.remembered, self.known = remembered, {}

    def surface(self, i, kind):
        control, unknown, byte = kind
        if byte:
            return bytes([self.byte_ids.index(i)])
        if control:
            return b""
        return " ⁇ ".encode() if unknown else self.names[i].replace(SPACE, " ").encode()

    def symbol(self, text):
        """The symbol of a part of a piece; None if it can be none."""
        if text in self.symbols:
            return self.symbols[text]
        return self.size + ord(text) if len(text) == 1 else None

    def pair_table(self, ranks):
        table = {}
        for name, merged in self.symbols.items():
            for cut in range(1, len(name)):
                left, right = self.symbol(name[:cut]), self.symbol(name[cut:])
                if left is not None and right is not None:
                    table[left * WIDTH + right] = ranks[merged], merged
        return table

    # Encoding

    def encode(self, texts):
        """Ids of each text (numpy int32), without begin or end."""
        if len(self.known) > self.remembered:
            self.known.clear()
        parts = [list(self.blocks(text)) for text in texts]
        new = set().union(*[words for blocks in parts for words in blocks])
        self.learn(list(new.difference(self.known)))
        found = self.known.__getitem__
        return [
            np.frombuffer(b"".join(map(found, chain.from_iterable(blocks))), np.int32)
            for blocks in parts
        ]

    def blocks(self, text):
        """The words of a text, about ``BLOCK_CHARS`` characters at a time."""
        if not text:
            return
        text = SPACE + text.replace(" ", SPACE)
        if self.words is None:
            yield [text]
            return
        start = 0
        while start < len(text):
            end = min(len(text), start + BLOCK_CHARS)
            # A line feed stands alone, so a block may end after one; else before
            # a space that follows something else.
            if end < len(text):
                end = self.block_end(text, start, end)
            yield self.words.findall(text, start, end)
            start = end

    def block_end(self, text, start, end):
        feed = text.rfind("\n", start, end)
        if feed >= start:
            # Feeds beside each other make no piece either.
            return feed + 1
        at = end
        while True:
            at = text.rfind(SPACE, start + 1, at)
            if at < 0:
                break
            if text[at - 1] != SPACE:
                return at
        later = re.compile(f"\n|[^{SPACE}](?={SPACE})").search(text, end)
        return later.end() if later else len(text)

    def learn(self, words):
        """Remember the ids of words, by merge rounds over all of them."""
        if not words:
            return
        codes = np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32)
        codes = codes.astype(np.int64)
        sizes = np.array([len(word) for word in words])
        owner = np.repeat(np.arange(len(words)), sizes)
        beside = codes[:-1] * WIDTH + codes[1:]
        joined = self.together[np.searchsorted(self.together, beside)] == beside
        span = np.zeros(len(codes), np.int64)
        span[1:] = np.cumsum(~(joined & (owner[1:] == owner[:-1])))
        # The first span of each word, then the first symbol of each.
        first_spans = np.append(span[np.cumsum(sizes) - sizes], span[-1] + 1)
        symbols, span = self.merged(self.first[codes], span)
        starts = np.append(np.flatnonzero(np.diff(span, prepend=-1)), len(span))
        edges = starts[first_spans]
        strange = np.add.reduceat(symbols >= self.size, edges[:-1]) > 0
        data, edges = symbols.astype(np.int32).tobytes(), (4 * edges).tolist()
        self.known.update(
            zip(words, map(data.__getitem__, map(slice, edges[:-1], edges[1:])), strict=True)
        )
        for number in np.flatnonzero(strange):
            ids = np.frombuffer(self.known[words[number]], np.int32)
            self.known[words[number]] = self.fall_back(ids).tobytes()

    def fall_back(self, symbols):
        """Characters that are no pieces become the ids of their bytes."""
        ids = []
        for symbol in symbols.tolist():
            if symbol < self.size:
                ids.append(symbol)
            else:
                ids.extend(self.byte_ids[b] for b in chr(symbol - self.size).encode())
        return np.array(ids, np.int32)

    def merged(self, symbols, span):
        """Symbols and spans after all merges, in the order given."""
        done, done_span = [], []
        last = np.append(span[1:] != span[:-1], True)
        ranks, ids = np.full(len(symbols), NONE, np.int32), np.zeros(len(symbols), np.int32)
        inner = np.flatnonzero(~last)
        ranks[inner], ids[inner] = self.pairs.look_up(symbols[inner], symbols[inner + 1])
        while len(symbols):
            starts = np.flatnonzero(np.diff(span, prepend=-1))
            best = np.minimum.reduceat(ranks, starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            finished = np.repeat(best == NONE, sizes)
            if finished.any():
                done.append(symbols[finished])
                done_span.append(span[finished])
                left = ~finished
                symbols, span, ranks, ids = symbols[left], span[left], ranks[left], ids[left]
                sizes, best = sizes[best != NONE], best[best != NONE]
                if not len(symbols):
                    break
            wanted = np.repeat(best, sizes)
            at = leftmost(np.flatnonzero(ranks == wanted))
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            after, after_span = symbols.copy(), span[keep]
            after[at] = ids[at]
            after, new_ranks, new_ids = after[keep], ranks[keep], ids[keep]
            place = at - np.arange(len(at))
            last = np.append(after_span[1:] != after_span[:-1], True)
            touched = np.zeros(len(after), bool)
            touched[place] = touched[np.maximum(place, 1) - 1] = True
            new_ranks[touched] = NONE
            changed = np.flatnonzero(touched & ~last)
            found, found_ids = self.pairs.look_up(after[changed], after[changed + 1])
            new_ranks[changed], new_ids[changed] = found, found_ids
            # One after the other, a merge would first stand beside an unmerged pair.
            beside = at[:-1][np.diff(at) == 2]
            beside = beside[span[beside] == span[beside + 2]]
            between, _ = self.pairs.look_up(ids[beside].astype(np.int64), symbols[beside + 2])
            rivals = np.union1d(
                after_span[changed[found <= wanted[keep][changed]]],
                span[beside[between <= wanted[beside]]],
            )
            if len(rivals):
                # As they were before this round.
                theirs = np.isin(span, rivals)
                for one in np.split(symbols[theirs], np.flatnonzero(np.diff(span[theirs])) + 1):
                    done.append(self.by_queue(one.tolist()))
                    done_span.append(np.zeros(len(done[-1]), np.int64))
                for number, rival in enumerate(rivals):
                    done_span[number - len(rivals)] += rival
                left = ~np.isin(after_span, rivals)
                after, after_span = after[left], after_span[left]
                new_ranks, new_ids = new_ranks[left], new_ids[left]
            symbols, span, ranks, ids = after, after_span, new_ranks, new_ids
        if not done:
            return symbols, span
        symbols, span = np.concatenate(done), np.concatenate(done_span)
        order = np.argsort(span, kind="stable")
        return symbols[order], span[order]

    def by_queue(self, symbols):
        """Merge the symbols of one span pair by pair, best rank first, then leftmost."""
        table, count = self.pairs.table, len(symbols)
        after, before = [*range(1, count), -1], list(range(-1, count - 1))
        queue = []

        def offer(left):
            right = after[left] if left >= 0 else -1
            if right >= 0:
                found = table.get(symbols[left] * WIDTH + symbols[right])
                if found:
                    heapq.heappush(queue, (found[0], left, symbols[left], symbols[right], found[1]))

        for place in range(count):
            offer(place)
        while queue:
            _, left, one, two, merged = heapq.heappop(queue)
            right = after[left]
            if symbols[left] != one or right < 0 or symbols[right] != two:
                continue
            symbols[left], symbols[right] = merged, -1
            after[left] = after[right]
            if after[left] >= 0:
                before[after[left]] = left
            offer(before[left])
            offer(left)
        return np.array([s for s in symbols if s >= 0], np.int64)

    # Decoding

    def decode(self, ids):
        """The text of ids as the library gives it: bytes that are no UTF-8 become U+FFFD."""
        ids = [i for i in ids if i is not None]
        if ids and not 0 <= min(ids) <= max(ids) < self.size:
            raise ValueError("an id is outside the vocabulary")
        parts = [self.surfaces[i] for i in ids]
        # The space put before a text: that of the first piece that gives any text.
        for place, i in enumerate(ids):
            if self.is_byte[i]:
                break
            if parts[place]:
                if self.names[i].startswith(SPACE):
                    parts[place] = parts[place][1:]
                break
        data = b"".join(parts)
        try:
            return data.decode()
        except UnicodeDecodeError:
            return self.repaired(ids, parts)

    def repaired(self, ids, parts):
        """Join parts where some runs of byte pieces are no UTF-8: one U+FFFD a bad byte."""
        text, run = [], b""
        for i, part in zip(ids, parts, strict=True):
            if self.is_byte[i]:
                run += part
                continue
            text += [one_a_byte(run), part.decode()]
            run = b""
        return "".join([*text, one_a_byte(run)])


def leftmost(places):
    """Of sorted places, those left when each taken place rules out the next number."""
    if not len(places):
        return places
    opens = np.diff(places, prepend=places[0] - 2) != 1
    run_start = places[opens][np.cumsum(opens) - 1]
    return places[(places - run_start) % 2 == 0]


def one_a_byte(data):
    """Decode bytes; each byte that starts no whole character is one U+FFFD."""
    text, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                text.append(data[at : at + size].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            size = 1
            text.append("�")
        at += size
    return "".join(text)


CODERS = {}


def load_coder(path):
    """The coder of a model, one per process, checked against the library on probes."""
    if path not in CODERS:
        import sentencepiece

        coder, model = Coder(path), sentencepiece.SentencePieceProcessor(model_file=path)
        for text, ids in zip(PROBES, coder.encode(PROBES), strict=True):
            ids = ids.tolist()
            if ids != model.encode(text) or coder.decode(ids) != model.decode(ids):
                raise ValueError("the model is of a kind that this coder does not serve")
        CODERS[path] = coder
    return CODERS[path]


def encode_texts(docs, path, keys=("doc_id",), end=True, decoded=False):
    """Ids of every text: keys and ``ids`` (array<int>), with the end id if ``end``.

    With ``decoded`` also the text that the ids decode to.
    """
    import pyarrow as pa

    def encode(batches):
        coder = load_coder(path)
        closing = np.array([coder.end] if end else [], np.int32)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                texts = [t.decode("utf-8", "replace") for t in byte_list(part.column(len(keys)))]
                found = [np.concatenate([ids, closing]) for ids in coder.encode(texts)]
                columns = [part.column(n) for n in range(len(keys))]
                columns.append(list_column(found))
                if decoded:
                    back = [coder.decode(ids.tolist()) for ids in found]
                    columns.append(pa.array(back, pa.string()))
                names = [f"c{n}" for n in range(len(columns))]
                yield pa.RecordBatch.from_arrays(columns, names)

    narrow = docs.select(*keys, "text")
    types = [f"c{n} {f.dataType.simpleString()}" for n, f in enumerate(narrow.schema[:-1])]
    made = ["ids array<int>", *(["decoded string"] if decoded else [])]
    names = [*keys, *[m.split()[0] for m in made]]
    types += [f"c{len(keys) + n} {m.split()[1]}" for n, m in enumerate(made)]
    renamed = narrow.toDF(*[f"c{n}" for n in range(len(narrow.columns))])
    return renamed.mapInArrow(encode, ", ".join(types)).toDF(*names)


def list_column(arrays):
    import pyarrow as pa

    offsets = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))


def decode_ids(encoded, path, keys=("doc_id",)):
    """The text of every list of ids: keys and ``text``."""
    import pyarrow as pa

    def decode(batches):
        coder = load_coder(path)
        for batch in batches:
            lists = batch.column(len(keys)).to_pylist()
            texts = pa.array([coder.decode(ids or []) for ids in lists], pa.string())
            columns = [*[batch.column(n) for n in range(len(keys))], texts]
            yield pa.RecordBatch.from_arrays(columns, [f"c{n}" for n in range(len(columns))])

    narrow = encoded.select(*keys, F.col("ids").cast("array<int>"))
    types = [f"c{n} {f.dataType.simpleString()}" for n, f in enumerate(narrow.schema[:-1])]
    renamed = narrow.toDF(*[f"c{n}" for n in range(len(narrow.columns))])
    return renamed.mapInArrow(decode, ", ".join([*types, f"c{len(keys)} string"])).toDF(*keys, "text")
