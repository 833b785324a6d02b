"""Scoring texts with a weighted backoff automaton of smoothed n-grams.

Every seen n-gram shorter than the order is a state, and every seen n-gram is an
arc out of its context's state. An arc weighs the smoothed probability
(c(hw) + PRIOR * p(w | shorter h)) / (c(h) + PRIOR); a state's failure arc to
its shorter context weighs PRIOR / (c(h) + PRIOR); the empty state gives every
word (c + 1/2) / (N + (V + 1) / 2). So the probabilities after any context sum
to 1, one unknown word included. One walk from left to right carries the state.

No task holds the corpus's n-grams. Documents are dealt to shards by their
places in the table. Each shard counts its n-grams and sends sorted keys and
counts to key ranges; a range adds the counts up and answers every shard in the
order it asked; the shard then builds the part of the automaton that its own
documents walk. A task writes to ``MOST_PARTS`` ranges at most: where there are
more shards, a range adds up only a bundle of them and asks narrower ranges
itself, hop by hop, and the answers come back the same way. So what is exchanged
grows as the input does, times the hops. Everything is one plan, in which each
shuffle of askers is used twice. n-grams are known by 64-bit hashes.

Defined results: a NULL text is empty, one end token; documents without id count
as id ''; repeated rows are documents of their own, dealt apart; a text of any
length is read whole, by one task; without training documents N and V are 0; an
empty table gives an empty result. Other columns are left out.
"""

import math

from pyspark.sql import functions as F

from voxloom.llm.shared import byte_list, whole_words

ORDER, PRIOR = 2, 1000.0
#: Bytes of text per shard and per key range, about, at least and at most, and
#: the fewest of both; bytes of text for each pair of a shard and a range.
LEAST_SHARD, LARGEST_SHARD, FEWEST, PAIR_BYTES = 8 << 20, 32 << 20, 8, 1 << 10
#: Key ranges that one task writes to, at most.
MOST_PARTS = 4096
#: Keys of the end of a text and of what is before its start.
END, BEGIN = 1, 2
MASK = (1 << 64) - 1


def following(contexts, words):
    """Keys of the n-grams that ``words`` make after ``contexts``, both keys themselves."""
    import numpy as np

    mixed = (contexts ^ (contexts >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed + words) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0x94D049BB133111EB)
    return mixed ^ (mixed >> np.uint64(32))


def token_keys(data):
    """Keys of the lower-cased words of a text, closed by the end token."""
    import numpy as np
    from xxhash import xxh64_intdigest

    parts = [
        np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
        for words in whole_words(data.lower())
    ]
    return np.concatenate([*parts, np.array([END], np.uint64)])


class Shard:
    """The n-grams of some texts: per level, sorted distinct keys and where each occurs."""

    def __init__(self, texts, order=ORDER):
        import numpy as np

        tokens = [token_keys(text) for text in texts]
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        words = np.concatenate(tokens) if tokens else np.empty(0, np.uint64)
        self.order, self.keys, self.at, self.first = order, [], [], []
        grams = words
        for level in range(order):
            if level:
                contexts = np.r_[np.uint64(BEGIN), grams[:-1]] if len(grams) else grams
                contexts[self.starts] = BEGIN
                grams = following(contexts, words)
            # What is before the start is a context too: as last "word" of level 1.
            given = grams if level else np.r_[grams, np.full(len(tokens), BEGIN, np.uint64)]
            keys, first, at = np.unique(given, return_index=True, return_inverse=True)
            self.keys.append(keys)
            self.first.append(first)
            self.at.append(at)

    def counts(self, training):
        """How often each key occurs in the training texts, per level."""
        import numpy as np

        weights = np.repeat(training, self.lengths).astype(np.float64)
        result = []
        for level, (keys, at) in enumerate(zip(self.keys, self.at, strict=True)):
            given = weights if level else np.r_[weights, training.astype(np.float64)]
            result.append(np.bincount(at, given, len(keys)).astype(np.int64))
        return result


class Automaton:
    """States, arcs and failure arcs that a shard's texts can meet; weights are log10."""

    def __init__(self, shard, counts, total, distinct, prior=PRIOR):
        import numpy as np

        self.order = shard.order
        self.seen = [c > 0 for c in counts]
        whole = total + 0.5 * (distinct + 1)
        self.unigram = np.log10((counts[0] + 0.5) / whole)
        self.weights, self.falls = [self.unigram], []
        probability = (counts[0] + 0.5) / whole
        begin = np.searchsorted(shard.keys[0], np.uint64(BEGIN))
        self.begin = int(begin)
        for level in range(1, self.order):
            first = shard.first[level]
            opening = np.isin(first, shard.starts)
            # The context of an n-gram is the shorter one that ends a word earlier.
            context = shard.at[level - 1][np.maximum(first - 1, 0)]
            if level == 1:
                context = np.where(opening, begin, context)
                context_count = counts[0][context]
            else:
                started = counts[0][begin]
                context_count = np.where(opening, started, counts[level - 1][context])
            shorter = probability[shard.at[level - 1][first]]
            probability = (counts[level] + prior * shorter) / (context_count + prior)
            with np.errstate(divide="ignore"):
                self.weights.append(np.log10(probability))
            self.falls.append(np.log10(prior / (counts[level - 1] + prior)))

    def walk(self, arcs):
        """log10 probability of a text; ``arcs[n]`` holds the n+1-gram at each position."""
        top = self.order - 1
        seen, weights, falls = self.seen_lists, self.weight_lists, self.fall_lists
        total = 0.0
        level, path = min(1, top), [self.begin] * top
        for position in range(len(arcs[0])):
            while level:
                arc = arcs[level][position]
                if seen[level][arc]:
                    break
                # The failure arc leads to the same words without the first of them.
                total += falls[level - 1][path[level - 1]]
                level -= 1
            total += weights[level][arcs[level][position]]
            path = [arcs[n][position] for n in range(top)]
            level = min(level + 1, top)
            if level == 1 and not seen[0][path[0]]:
                level = 0
        return total

    def prepare(self):
        """Python lists: the walk reads single numbers."""
        self.seen_lists = [s.tolist() for s in self.seen]
        self.weight_lists = [w.tolist() for w in self.weights]
        self.fall_lists = [f.tolist() for f in self.falls]
        return self


def split_keys(keys, groups, low, step, parts):
    """Where each of ``parts`` ranges of ``step`` groups from group ``low`` on begins in sorted keys.

    All keys fall into ``groups`` equal ranges.
    """
    import numpy as np

    upper = (keys >> np.uint64(32)).astype(np.int64)
    return np.searchsorted((upper * groups) >> 32, low + step * np.arange(parts + 1))


def hops_for(shards, most_parts=MOST_PARTS):
    """(hops, parts): the fewest hops of at most ``most_parts`` parts that tell all shards apart."""
    hops, parts = 1, shards
    while parts > most_parts:
        hops += 1
        parts = math.ceil(shards ** (1 / hops))
        parts += parts**hops < shards
    return hops, parts


def write_keys(keys):
    """Sorted keys as differences, byte by byte, so that the shuffle's compression finds zeros."""
    import numpy as np

    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def read_keys(data):
    import numpy as np

    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    steps = np.ascontiguousarray(planes.T).view("<u8").ravel()
    return np.cumsum(steps, dtype=np.uint64)


def write_counts(counts):
    """One byte per count; those from 255 on follow in full."""
    import numpy as np

    large = counts[counts >= 255].astype("<i8")
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + large.tobytes()


def read_counts(data, length):
    import numpy as np

    counts = np.frombuffer(data[:length], np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data[length:], "<i8")
    return counts


def shard_size(size):
    """Bytes of text per shard for ``size`` bytes in all.

    Shards grow with the square root of the input, as far as a task's memory
    lets them, so that what a pair of a shard and a range exchanges stays worth
    a row.
    """
    return min(max(LEAST_SHARD, math.isqrt(PAIR_BYTES * size)), LARGEST_SHARD)


def merged(rows, order):
    """Per level: the rows that ask, where each begins, their distinct keys, and each key's place.

    ``rows`` have ``level``, ``keys`` and ``length``.
    """
    import numpy as np

    result = []
    for level in range(order):
        asked = [row for row in rows if row["level"] == level]
        edges = np.cumsum([0, *[row["length"] for row in asked]])
        keys = [read_keys(row["keys"]) for row in asked]
        distinct, at = np.unique(
            np.concatenate([*keys, np.empty(0, np.uint64)]), return_inverse=True
        )
        result.append((asked, edges, distinct, at))
    return result


def added(asked, distinct, at):
    """Counts of the distinct keys over all rows that ask."""
    import numpy as np

    counts = [read_counts(row["counts"], row["length"]) for row in asked]
    counts = np.concatenate([*counts, np.empty(0, np.int64)])
    return np.bincount(at, counts, len(distinct)).astype(np.int64)


def arrow_table(rows, schema):
    """Rows (tuples) as an Arrow table with the columns of ``schema``."""
    import pyarrow as pa

    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.table({
        name: pa.array(column, kinds[kind])
        for (name, kind), column in zip(schema, columns, strict=True)
    })


#: What goes to the ranges of a bundle, and what comes back to who asked.
ASKING = [
    ("bundle", "int"), ("range", "long"), ("asker", "int"), ("level", "int"),
    ("keys", "binary"), ("counts", "binary"), ("length", "long"),
]
ANSWERS = [
    ("asker", "int"), ("above", "long"), ("level", "int"), ("range", "long"),
    ("counts", "binary"), ("length", "long"), ("known", "long"), ("tokens", "long"),
]


def as_schema(columns):
    return ", ".join(f"`{name}` {kind}" for name, kind in columns)


class Exchange:
    """Adds up the shards' counts over ``hops`` hops, each to ``parts`` narrower ranges."""

    def __init__(self, order, hops, parts):
        self.order, self.hops, self.parts = order, hops, parts

    def questions(self, asker, above, hop, levels):
        """Rows from an asker of range ``above`` to the narrower ranges of its bundle."""
        step = self.parts ** (self.hops - hop - 1)
        rows = []
        for level, (keys, counts) in enumerate(levels):
            low = above * self.parts * step
            edges = split_keys(keys, self.parts**self.hops, low, step, self.parts)
            for part, (begin, end) in enumerate(zip(edges, edges[1:], strict=False)):
                # Every range is asked for words: it tells how many it holds.
                if end > begin or level == 0:
                    rows.append((
                        asker // self.parts, above * self.parts + part, asker, level,
                        write_keys(keys[begin:end]), write_counts(counts[begin:end]),
                        int(end - begin),
                    ))
        return arrow_table(rows, ASKING)

    def replies(self, table, totals_of):
        """Rows back to all who asked; ``totals_of(level, ...)`` gives totals, words and tokens."""
        rows = table.to_pylist()
        made = []
        for level, (asked, edges, distinct, at) in enumerate(merged(rows, self.order)):
            if not asked:
                continue
            totals, known, tokens = totals_of(level, asked, distinct, at)
            for row, begin, end in zip(asked, edges, edges[1:], strict=False):
                made.append((
                    row["asker"], row["range"] // self.parts, level, row["range"],
                    write_counts(totals[at[begin:end]]), row["length"], known, tokens,
                ))
        return arrow_table(made, ANSWERS)

    def pass_on(self, hop):
        """A range of a bundle of askers adds up and asks the next narrower ranges."""

        def run(key, table):
            levels = [
                (distinct, added(asked, distinct, at))
                for asked, _, distinct, at in merged(table.to_pylist(), self.order)
            ]
            return self.questions(key[0].as_py(), key[1].as_py(), hop, levels)

        return run

    def answer(self, table):
        """The narrowest ranges hold the counts of the whole corpus."""

        def totals_of(level, asked, distinct, at):
            totals = added(asked, distinct, at)
            words = (distinct != BEGIN) & (totals > 0)
            if level:
                return totals, 0, 0
            return totals, int(words.sum()), int(totals[words].sum())

        return self.replies(table, totals_of)

    def relay(self, table, answers):
        """Wider ranges hand on what the narrower ones answered."""
        counts, known, tokens = gathered(answers, self.order)
        return self.replies(
            table,
            lambda level, *_: (counts[level], *((0, 0) if level else (known, tokens))),
        )

    def answers(self, asked):
        """Answers to the shards, from their questions."""
        forms = as_schema(ASKING), as_schema(ANSWERS)
        stages = [asked.groupBy("bundle", "range")]
        for hop in range(1, self.hops):
            further = stages[-1].applyInArrow(self.pass_on(hop), forms[0])
            stages.append(further.groupBy("bundle", "range"))
        found = stages.pop().applyInArrow(lambda table: self.answer(table), forms[1])
        for stage in reversed(stages):
            found = stage.cogroup(found.groupBy("asker", "above")).applyInArrow(
                lambda table, answers: self.relay(table, answers), forms[1]
            )
        return found


def gathered(answers, order):
    """Counts per level in order of keys, distinct words and tokens, from all ranges' answers."""
    import numpy as np

    rows = sorted(answers.to_pylist(), key=lambda row: (row["level"], row["range"]))
    counts = [
        np.concatenate([
            *[read_counts(r["counts"], r["length"]) for r in rows if r["level"] == level],
            np.empty(0, np.int64),
        ])
        for level in range(order)
    ]
    return counts, sum(row["known"] for row in rows), sum(row["tokens"] for row in rows)


def score(docs, training, order=ORDER, prior=PRIOR, shard_bytes=None, most_parts=MOST_PARTS):
    """Scores of every text under the model of those for which ``training`` holds.

    ``docs`` has ``doc_id`` and ``text``; ``training`` is a Boolean column over
    them. Gives ``doc_id``, ``training``, ``n_tokens``, ``n_known``,
    ``train_tokens``, ``base_score`` and ``score``. ``shard_bytes`` replaces
    ``shard_size``.
    """
    import numpy as np
    import pyarrow as pa

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(FEWEST, math.ceil(size / (shard_bytes or shard_size(size))))
    exchange = Exchange(order, *hops_for(shards, most_parts))
    place = F.xxhash64(F.monotonically_increasing_id())
    dealt = docs.select(
        "doc_id",
        "text",
        training.alias("training"),
        F.pmod(place, F.lit(shards)).cast("int").alias("shard"),
    )

    def read(table):
        """The shard's texts' flags and n-grams; the order of its rows plays no part."""
        texts = [text for chunk in table.column("text").chunks for text in byte_list(chunk)]
        flags = np.array(table.column("training").to_pylist(), bool)
        return flags, Shard(texts, order)

    def ask(key, table):
        flags, shard = read(table)
        levels = list(zip(shard.keys, shard.counts(flags), strict=True))
        return exchange.questions(key[0].as_py(), 0, 0, levels)

    def walk(key, table, answers):
        names = [
            "doc_id", "training", "n_tokens", "n_known", "train_tokens", "base_score", "score"
        ]
        if not table.num_rows:
            return empty.slice(0, 0)
        flags, shard = read(table)
        counts, known, tokens = gathered(answers, order)
        model = Automaton(shard, counts, tokens, known, prior).prepare()
        words = shard.at[0][: int(shard.lengths.sum())]
        base = np.add.reduceat(model.unigram[words], shard.starts)
        n_known = np.add.reduceat(model.seen[0][words].astype(np.int64), shard.starts)
        scores = [
            model.walk([at[low:high].tolist() for at in shard.at])
            for low, high in zip(shard.starts, shard.ends, strict=True)
        ]
        columns = [
            table.column("doc_id"), pa.array(flags), pa.array(shard.lengths), pa.array(n_known),
            pa.array(np.full(len(base), tokens)), pa.array(base), pa.array(scores, pa.float64()),
        ]
        return pa.Table.from_arrays(columns, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    empty = pa.table({
        "doc_id": pa.array([], pa.int64()), "training": pa.array([], pa.bool_()),
        **{n: pa.array([], pa.int64()) for n in ("n_tokens", "n_known", "train_tokens")},
        **{n: pa.array([], pa.float64()) for n in ("base_score", "score")},
    })
    asked = dealt.groupBy("shard").applyInArrow(ask, as_schema(ASKING))
    return (
        dealt.groupBy("shard")
        .cogroup(exchange.answers(asked).groupBy("asker"))
        .applyInArrow(
            walk,
            f"doc_id {kind}, training boolean, n_tokens long, n_known long, "
            "train_tokens long, base_score double, score double",
        )
    )
