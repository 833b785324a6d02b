"""Language identification by prediction with partial matching.

Each language has a byte context tree of variable order: for every context of up
to ``ORDER`` bytes seen in its training sample, how often each byte followed. A
byte is predicted by the longest context of the tree; a context gives unseen
bytes together the escape probability u / (n + u) of its n uses and u different
followers, shared among them as the next shorter context says, bytes already
seen excluded; below all contexts every byte is as likely. Frozen counts make
that a fixed table of code lengths per context and byte. A text's code length
under a language is the sum over its bytes; the shortest wins.

The trees come from a bounded sample: ``SAMPLE_BYTES`` bytes, from
any place, of ``SAMPLE_TEXTS`` texts of each language, chosen by the hash of their ids among all
that have a text.

Defined results: a text that is NULL or has no letter is ``und`` with score 0,
and so is every text if nothing was learned; ties go to the first language in
order; repeated rows are judged each; texts of any length are read whole; other columns
pass through ``with_language``, whatever their names; an empty table gives an empty result.
"""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.llm.shared import byte_list, first_by_hash, renamed, window_bytes
from voxloom.session import stored

#: The most bytes of context; scoring looks back over three at most.
ORDER = 3
SAMPLE_TEXTS, SAMPLE_BYTES = 300, 1 << 16
UNKNOWN = "und"
BYTES_AT_ONCE = 1 << 18


def follower_counts(texts, order=ORDER):
    """{(context bytes, byte): count} as rows (context, byte, count), contexts of 0 to ``order``."""
    import numpy as np

    rows = []
    for length in range(order + 1):
        keys = []
        for text in texts:
            data = np.frombuffer(text, np.uint8).astype(np.int64)
            if len(data) > length:
                key = np.zeros(len(data) - length, np.int64)
                for at in range(length + 1):
                    key = key * 256 + data[at : len(data) - length + at]
                keys.append(key)
        if keys:
            found, counts = np.unique(np.concatenate(keys), return_counts=True)
            rows += [
                ((key >> 8).to_bytes(length, "big"), key & 255, count)
                for key, count in zip(found.tolist(), counts.tolist(), strict=True)
            ]
    return rows


class ContextTree:
    """One language's code lengths in bits, by context and class of byte.

    Class 0 stands for each byte that no training text of any language holds.
    """

    def __init__(self, rows, classes):
        import numpy as np

        width = int(classes.max()) + 1
        members = np.bincount(classes, minlength=width)
        members[0] = max(members[0], 1)
        followers = {}
        for context, byte, count in rows:
            followers.setdefault(context, []).append((classes[byte], count))
        followers.setdefault(b"", [])
        uniform = np.full(width, 1 / 256)
        tables, self.states = [], {}
        for context in sorted(followers, key=len):
            shorter = tables[self.longest(context[1:])] if context else uniform
            tables.append(self.mixed(followers[context], shorter, members))
            self.states[context] = len(tables) - 1
        with np.errstate(divide="ignore"):
            self.bits = -np.log2(np.array(tables)).astype(np.float32)
        # The state after any three classes, by their numbers.
        self.after = np.zeros((width,) * 3, np.int32)
        for context, state in self.states.items():
            if context:
                tail = tuple(int(classes[byte]) for byte in context)
                self.after[(slice(None),) * (3 - len(tail)) + tail] = state
        self.after = self.after.ravel()

    def longest(self, context):
        while context not in self.states:
            context = context[1:]
        return self.states[context]

    @staticmethod
    def mixed(followers, shorter, members):
        """Probability of each class (of one byte of class 0) after a context."""
        import numpy as np

        if not followers:
            return shorter
        codes = np.array([c for c, _ in followers])
        counts = np.array([n for _, n in followers], float)
        whole = counts.sum() + len(counts)
        left = shorter.copy()
        left[codes] = 0
        mass = float((left * members).sum())
        result = left * (len(counts) / whole / mass) if mass > 0 else left
        if mass <= 0:
            whole = counts.sum()
        result[codes] = counts / whole
        return result


class Identifier:
    """Code lengths of texts under every language's tree.

    ``tables`` holds per language the bits by state and class, and the state
    after any three classes.
    """

    def __init__(self, languages, classes, tables):
        import numpy as np

        self.languages, self.classes, self.tables = languages, classes, tables
        self.small = classes.astype(np.int32)

    @classmethod
    def learned(cls, samples):
        """From {language: follower rows}."""
        import numpy as np

        languages = sorted(samples)
        classes = np.zeros(256, np.int64)
        present = sorted({byte for rows in samples.values() for _, byte, _ in rows})
        for number, byte in enumerate(present, 1):
            classes[byte] = number
        trees = [ContextTree(samples[name], classes) for name in languages]
        return cls(languages, classes, [(tree.bits, tree.after) for tree in trees])

    def parts(self):
        """What the constructor needs, for a broadcast."""
        return self.languages, self.classes, self.tables

    def code_lengths(self, texts):
        """Bits of each text under each language, as a matrix."""
        import numpy as np

        width = int(self.classes.max()) + 1
        # Three bytes of class 0 before every text: no context reaches back over them.
        data = b"".join(b"\0\0\0" + text for text in texts) + b"\0"
        sizes = np.array([len(text) + 3 for text in texts])
        starts = np.cumsum(sizes) - sizes
        codes = self.small[np.frombuffer(data, np.uint8)]
        for shift in range(3):
            codes[starts + shift] = 0
        context = np.zeros(len(codes), np.int32)
        context[3:] = (codes[:-3] * width + codes[1:-2]) * width + codes[2:-1]
        spans = np.stack([starts + 3, starts + sizes], 1).ravel()
        result = np.zeros((len(texts), len(self.tables)))
        for column, (by_state, after) in enumerate(self.tables):
            bits = by_state[after[context], codes]
            sums = np.add.reduceat(bits, spans, dtype=np.float64)[::2]
            result[:, column] = np.where(sizes > 3, sums, 0.0)
        return result

    def predict(self, texts):
        """(language, score) of each text; the score is its share of the likelihoods."""
        import numpy as np

        found = []
        lettered = [any(map(str.isalpha, t.decode("utf-8", "replace"))) for t in texts]
        lengths = self.total_lengths([t.lower() for t in texts])
        for has_letter, bits in zip(lettered, lengths, strict=True):
            if not has_letter or not self.languages:
                found.append((UNKNOWN, 0.0))
                continue
            best = int(np.argmin(bits))
            share = 1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum()
            found.append((self.languages[best], float(share)))
        return found

    def total_lengths(self, texts):
        """``code_lengths`` of any texts, about ``BYTES_AT_ONCE`` bytes at a time."""
        import numpy as np

        result, held, size = np.zeros((len(texts), len(self.tables))), [], 0

        def flush():
            if held:
                at = np.array([i for i, _, _ in held])
                # A part that goes on from another begins with its last three bytes.
                whole = self.code_lengths([text for _, text, _ in held])
                lead = [(n, text[:3]) for n, (_, text, goes_on) in enumerate(held) if goes_on]
                if lead:
                    whole[[n for n, _ in lead]] -= self.code_lengths([text for _, text in lead])
                np.add.at(result, at, whole)
                held.clear()

        for i, text in enumerate(texts):
            for start in range(0, max(len(text), 1), BYTES_AT_ONCE):
                low = max(0, start - 3)
                held.append((i, text[low : start + BYTES_AT_ONCE], start > 0))
                size += len(held[-1][1])
                if size >= BYTES_AT_ONCE:
                    flush()
                    size = 0
        flush()
        return result


def training_sample(docs, training, texts=SAMPLE_TEXTS, most_bytes=SAMPLE_BYTES):
    """A window of at most ``texts`` texts of each language, by the hash of their ids.

    Rows without id, or whose text is NULL or empty, are not learned from and
    take no other's place. Only ids and the chosen ones' texts move.
    """
    known = training & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()
    written = docs.filter(known & (F.octet_length("text") > 0))
    ids = written.select("doc_id", "lang").distinct()
    chosen = stored(first_by_hash(ids, "lang", texts), "sample")
    # At most ``texts`` rows per language.
    found = written.join(F.broadcast(chosen), ["doc_id", "lang"])
    return found.groupBy("doc_id", "lang").agg(F.min(window_bytes("text", most_bytes)).alias("text"))


def learn(docs, training, order=ORDER, texts=SAMPLE_TEXTS, most_bytes=SAMPLE_BYTES):
    """Follower counts per language from the bounded sample: {language: rows}."""
    import pyarrow as pa

    if not 0 <= order <= ORDER:
        raise ValueError(f"order must be from 0 to {ORDER}")

    def count(key, table):
        given = [t for c in table.column("text").chunks for t in byte_list(c)]
        rows = follower_counts([text.lower() for text in given], order)
        contexts, values, counts = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table({
            "lang": pa.array([key[0].as_py()] * len(rows), pa.string()),
            "context": pa.array(contexts, pa.binary()),
            "byte": pa.array(values, pa.int32()),
            "count": pa.array(counts, pa.int64()),
        })

    counted = training_sample(docs, training, texts, most_bytes).groupBy("lang").applyInArrow(
        count, "lang string, context binary, byte int, count long"
    )
    # At most four rows per byte of the sample.
    table = counted.toArrow()
    samples = {}
    for lang, context, byte, number in zip(*[c.to_pylist() for c in table.columns], strict=True):
        samples.setdefault(lang, []).append((context, byte, number))
    return samples


def identify(docs, training, keep=("doc_id",), **given):
    """The columns ``keep`` of ``docs`` with ``__lang_pred`` and ``__score``.

    ``docs`` has ``doc_id``, ``text`` and ``lang``; ``training`` says which rows
    may be learned from. No other column has a part in a prediction.
    """
    import pyarrow as pa

    learned = Identifier.learned(learn(docs, training, **given))
    # Its size is bounded by the sample's.
    shared = docs.sparkSession.sparkContext.broadcast(learned.parts())
    asked = docs.select("text", *[F.col(name).alias(f"__{i}") for i, name in enumerate(keep)])

    def run(batches):
        identifier = Identifier(*shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                names, scores = zip(*identifier.predict(byte_list(part.column(0))), strict=True)
                made = [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], *made], [*keep, "__lang_pred", "__score"]
                )

    fields = [T.StructField(name, docs.schema[name].dataType) for name in keep]
    fields.append(T.StructField("__lang_pred", T.StringType()))
    fields.append(T.StructField("__score", T.DoubleType()))
    return asked.mapInArrow(run, T.StructType(fields))


def with_language(docs, training, **given):
    """The documents whose language can be told, with the columns of ``docs``.

    ``training`` may not use columns whose names begin with two underscores.
    """
    rows, back = renamed(docs)
    found = identify(rows, training, rows.columns, **given)
    return back(found.filter(F.col("__lang_pred") != UNKNOWN))
