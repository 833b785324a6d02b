"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters look at ``WIDTH`` bytes at every position of a text. The text is
covered by overlapping chunks; in each chunk every filter's largest response is
pooled. The largest and the mean over the chunks go through one hidden layer to
one probability.

A filter's weight of a byte at a place is a product of a learned byte embedding
and the filter. For scoring, the weights of two neighbouring places are added up
beforehand for all pairs of bytes, so a window of four bytes takes two look-ups.

Training uses ``SAMPLE_BYTES`` bytes, from any place, of at most ``SAMPLE_TEXTS`` labelled
texts, chosen by the hash of their ids among all that are not NULL.

Defined results: a NULL text counts as empty, and an empty text gets the score
of padding alone; NULL labels are not learned from; without labelled rows of
both kinds the score is the share of label 1, or 0.5; repeated rows are scored
each; an empty table gives an empty result.
"""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.llm.shared import byte_list, first_by_hash, window_bytes
from voxloom.session import stored

WIDTH, FILTERS, EMBEDDED, HIDDEN = 4, 16, 8, 16
#: Positions that are pooled together first; a chunk is some of these blocks in
#: a row, and the next chunk begins before it ends.
BLOCK, CHUNK_BLOCKS, CHUNK_STEP = 64, 8, 7
SAMPLE_TEXTS, SAMPLE_BYTES = 2400, 1 << 14
STEPS, BATCH_TEXTS, RATE, SEED = 900, 32, 0.01, 7
BYTES_AT_ONCE = 1 << 18


def laid_out(texts):
    """Texts as one byte array, each closed by zeros up to whole blocks; blocks per text."""
    import numpy as np

    padded = [t + b"\0" * (WIDTH - 1 + -(len(t) + WIDTH - 1) % BLOCK) for t in texts]
    blocks = np.array([len(t) // BLOCK for t in padded])
    return np.frombuffer(b"".join(padded) + b"\0" * WIDTH, np.uint8), blocks


def chunk_spans(blocks):
    """(first block, end block) of every chunk, and the first chunk of every text."""
    import numpy as np

    chunks = 1 + np.maximum(0, -(-(blocks - CHUNK_BLOCKS) // CHUNK_STEP))
    first_block, first_chunk = np.cumsum(blocks) - blocks, np.cumsum(chunks) - chunks
    owner = np.repeat(np.arange(len(blocks)), chunks)
    low = first_block[owner] + (np.arange(len(owner)) - first_chunk[owner]) * CHUNK_STEP
    high = np.minimum(low + CHUNK_BLOCKS, (first_block + blocks)[owner])
    return low, high, first_chunk, chunks


class Network:
    """Weights, scoring and training."""

    def __init__(self, weights):
        self.weights = weights

    @classmethod
    def initial(cls, seed=SEED):
        import numpy as np

        draw = np.random.default_rng(seed).normal
        return cls({
            "bytes": draw(0, 0.5, (256, EMBEDDED)),
            "filters": draw(0, 0.5, (WIDTH, EMBEDDED, FILTERS)),
            "bias": np.zeros(FILTERS),
            "hidden": draw(0, 0.3, (2 * FILTERS, HIDDEN)),
            "hidden_bias": np.zeros(HIDDEN),
            "out": draw(0, 0.3, HIDDEN),
            "out_bias": np.zeros(1),
        })

    def tables(self):
        """Summed weights of the first and the last two places for all pairs of bytes."""
        import numpy as np

        w = self.weights
        taps = np.einsum("be,wef->wbf", w["bytes"], w["filters"])
        pairs = [
            (taps[i][:, None, :] + taps[i + 1][None, :, :]).reshape(-1, FILTERS) for i in (0, 2)
        ]
        return [np.ascontiguousarray(p, np.float32) for p in pairs]

    @staticmethod
    def responses(data, tables):
        """Filter responses at every position of laid-out bytes."""
        import numpy as np

        pairs = data[:-1].astype(np.int32) * 256 + data[1:]
        n = len(data) - WIDTH
        made = tables[0][pairs[:n]]
        made += tables[1][pairs[2 : n + 2]]
        # The last places of a text's padding would look into the next text.
        return made

    def block_peaks(self, data, blocks, tables, places=False):
        """Largest response per block and filter; with ``places`` also where it is."""
        import numpy as np

        ends = np.zeros(int(blocks.sum()), bool)
        ends[np.cumsum(blocks) - 1] = True
        padding = tables[0][0] + tables[1][0]
        peaks, spots, step = [], [], BYTES_AT_ONCE // BLOCK
        for start in range(0, len(ends), step):
            part = ends[start : start + step]
            low, high = start * BLOCK, (start + len(part)) * BLOCK
            made = self.responses(data[low : high + WIDTH], tables)
            made = made.reshape(len(part), BLOCK, FILTERS)
            made[part, 1 - WIDTH :] = padding
            peaks.append(made.max(axis=1))
            if places:
                at = np.arange(start, start + len(part))[:, None] * BLOCK
                spots.append(made.argmax(axis=1) + at)
        return np.concatenate(peaks), np.concatenate(spots) if places else None

    def pooled(self, peaks, blocks):
        """Chunk peaks, and the largest and mean of them per text."""
        import numpy as np

        low, high, first, chunks = chunk_spans(blocks)
        spans = np.stack([low, high], 1).ravel()
        closed = np.concatenate([peaks, peaks[-1:]])
        chunk = np.maximum.reduceat(closed, spans, axis=0)[::2]
        chunk = np.maximum(chunk + self.weights["bias"], 0)
        top = np.maximum.reduceat(chunk, first, axis=0)
        mean = np.add.reduceat(chunk, first, axis=0) / chunks[:, None]
        return chunk, np.concatenate([top, mean], axis=1)

    def head(self, features):
        import numpy as np

        w = self.weights
        hidden = np.tanh(features @ w["hidden"] + w["hidden_bias"])
        logit = hidden @ w["out"] + w["out_bias"][0]
        return hidden, 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def probabilities(self, texts, tables):
        """The probability of label 1 for each text."""
        if not texts:
            return []
        data, blocks = laid_out(texts)
        peaks, _ = self.block_peaks(data, blocks, tables)
        return self.head(self.pooled(peaks, blocks)[1])[1]

    def gradients(self, texts, labels):
        """Gradients of the mean log loss over a batch."""
        import numpy as np

        w = self.weights
        data, blocks = laid_out(texts)
        peaks, spots = self.block_peaks(data, blocks, self.tables(), places=True)
        chunk, features = self.pooled(peaks, blocks)
        hidden, p = self.head(features)
        d_logit = (p - labels) / len(labels)
        d_hidden = np.outer(d_logit, w["out"]) * (1 - hidden**2)
        found = {
            "out": hidden.T @ d_logit,
            "out_bias": np.array([d_logit.sum()]),
            "hidden": features.T @ d_hidden,
            "hidden_bias": d_hidden.sum(axis=0),
        }
        d_top, d_mean = np.split(d_hidden @ w["hidden"].T, 2, axis=1)
        low, high, first, chunks = chunk_spans(blocks)
        owner = np.repeat(np.arange(len(blocks)), chunks)
        d_chunk = (d_mean / chunks[:, None])[owner]
        # The largest chunk of a text takes the gradient of the maximum.
        top = features[:, :FILTERS][owner]
        is_top = chunk == top
        share = is_top / np.add.reduceat(is_top, first, axis=0, dtype=float)[owner]
        d_chunk = (d_chunk + d_top[owner] * share) * (chunk > 0)
        found["bias"] = d_chunk.sum(axis=0)
        # Within a chunk it goes to the block, and there to the place, of the peak.
        width = np.minimum(np.arange(CHUNK_BLOCKS)[None, :] + low[:, None], (high - 1)[:, None])
        block = width[:, 0][:, None] + peaks[width].argmax(axis=1)
        block = np.minimum(block, (high - 1)[:, None])
        place = np.take_along_axis(spots[block.ravel()].reshape(*block.shape, FILTERS),
                                   np.arange(FILTERS)[None, :, None], 2)[..., 0]
        d_bytes, d_filters = np.zeros_like(w["bytes"]), np.zeros_like(w["filters"])
        column = np.broadcast_to(np.arange(FILTERS), place.shape)
        for tap in range(WIDTH):
            d_tap = np.zeros((256, FILTERS))
            np.add.at(d_tap, (data[place + tap], column), d_chunk)
            d_filters[tap] = w["bytes"].T @ d_tap
            d_bytes += d_tap @ w["filters"][tap].T
        return found | {"bytes": d_bytes, "filters": d_filters}

    def fit(self, texts, labels, steps=STEPS, batch=BATCH_TEXTS, rate=RATE, seed=SEED):
        """Adam over shuffled batches, with a falling rate."""
        import numpy as np

        labels = np.asarray(labels, float)
        order = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step = 0
        while step < steps:
            shuffled = order.permutation(len(texts))
            for start in range(0, len(texts), batch):
                chosen = shuffled[start : start + batch]
                found = self.gradients([texts[i] for i in chosen], labels[chosen])
                now = rate * max(0.0, 1 - step / steps)
                step += 1
                for name, value in found.items():
                    first[name] = 0.9 * first[name] + 0.1 * value
                    second[name] = 0.99 * second[name] + 0.01 * value**2
                    mean = first[name] / (1 - 0.9**step)
                    spread = np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8
                    self.weights[name] = self.weights[name] - now * mean / spread
        return self


    def with_shares(self, sampled, real):
        """The network for data in which label 1 has the share ``real``, not ``sampled``."""
        import numpy as np

        shift = np.log(real / (1 - real)) - np.log(sampled / (1 - sampled))
        return Network(self.weights | {"out_bias": self.weights["out_bias"] + shift})


def labelled(docs, labels, training):
    """``doc_id``, ``__label`` (0 or 1) and ``__has_text`` per row of ``docs`` to be learned from.

    A document labelled several times has its smallest label.
    """
    marked = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(
        F.min("quality").alias("__label")
    )
    given = docs.filter(training).select("doc_id", F.col("text").isNotNull().alias("__has_text"))
    return given.join(marked, "doc_id")


def training_sample(docs, known, texts=SAMPLE_TEXTS, most_bytes=SAMPLE_BYTES):
    """(window of the text, label) of at most ``texts`` of the ``known`` documents with a text.

    Half of them are of each label if there are as many. They are chosen by the
    hash of their ids; only ids and the chosen ones' texts move.
    """
    ids = known.filter("__has_text").select("doc_id", "__label").distinct()
    chosen = stored(first_by_hash(ids, "__label", texts // 2), "sample")
    # At most ``texts`` rows.
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    window = F.min(window_bytes("text", most_bytes))
    return found.groupBy("doc_id", "__label").agg(window.alias("text"))


def learn(docs, labels, training, **given):
    """A trained network, or the share of label 1 where only one label was seen."""
    known = stored(labelled(docs, labels, training), "labelled")
    sample = training_sample(docs, known, **given).toArrow().combine_chunks()
    texts = [t for chunk in sample.column("text").chunks for t in byte_list(chunk)]
    marks = sample.column("__label").to_pylist()
    if len(set(marks)) < 2:
        return sum(marks) / len(marks) if marks else 0.5
    # Rows come in any order; training must not depend on it.
    pairs = sorted(zip(texts, marks, strict=True))
    network = Network.initial().fit([t for t, _ in pairs], [m for _, m in pairs])
    real = known.agg(F.avg("__label")).first()[0]
    return network.with_shares(sum(marks) / len(marks), real)


def score(docs, labels, training, keep=("doc_id",), **given):
    """The columns ``keep`` of ``docs`` with ``__score``, the probability of label 1."""
    import pyarrow as pa

    learned = learn(docs, labels, training, **given)
    asked = docs.select("text", *[F.col(name).alias(f"__{i}") for i, name in enumerate(keep)])
    if not isinstance(learned, Network):
        renamed = [F.col(f"__{i}").alias(name) for i, name in enumerate(keep)]
        return asked.select(*renamed, F.lit(float(learned)).alias("__score"))
    weights = learned.weights

    def run(batches):
        network = Network(weights)
        tables = network.tables()
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                scores = network.probabilities(byte_list(part.column(0)), tables)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.array(scores, pa.float64())], [*keep, "__score"]
                )

    fields = [T.StructField(name, docs.schema[name].dataType) for name in keep]
    fields.append(T.StructField("__score", T.DoubleType()))
    return asked.mapInArrow(run, T.StructType(fields))
