"""SimHash near-duplicates, found by meet-in-the-middle ball hashing.

Two fingerprints at most ``radius`` bits apart have a value in the middle, half
the radius from each. Every distinct fingerprint emits all variants within half
the radius; fingerprints that share a variant collide. Variants are dealt to
groups by the parities of b blocks of their bits. Flipping two bits turns two
parities at most, so the 2,081 variants of a fingerprint (radius 4) fall into
1 + b + b(b - 1)/2 of the 2**b groups. A fingerprint is sent once to each of
these, and the group's task makes just the variants that belong there. That is
the shuffle on variants, combined before it: with as many groups as bound the
variants of one, a fingerprint moves 22 times if there are a hundred thousand of
them, 92 times at ten million and 301 times at twenty billion.

Colliding fingerprints are linked to the first of their variant, not all with
all: what shares a variant is within the radius by the triangle inequality.
Every link is verified by its bit distance.

Defined results: a text without words, or NULL, has fingerprint zero; equal
fingerprints are linked; a row without id counts as the largest id and its
component has a NULL id if no other row is in it; texts of any length are read whole;
other columns pass through ``one_of_each``, whatever their names; an empty table gives
an empty result.
"""

import math
from itertools import combinations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.llm.shared import byte_list, renamed, whole_words
from voxloom.session import stored

SHINGLE_WORDS, RADIUS, SEED = 4, 4, 42
#: Variants that a group has about, and that its task makes at once; the fewest
#: groups and the most blocks.
PER_GROUP, PER_PART, FEWEST_GROUPS, MOST_BLOCKS = 1 << 22, 1 << 22, 64, 24
HASHES_AT_ONCE = 1 << 16
NO_ID = 2**63 - 1


def fingerprint(data, shingle=SHINGLE_WORDS, seed=SEED):
    """Fingerprint of UTF-8 text: a bit is 1 if set in over half the shingles' hashes."""
    import numpy as np
    from xxhash import xxh64_intdigest

    ones, total, held = np.zeros(64, np.int64), 0, []

    def add(hashes):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return bits.sum(axis=0, dtype=np.int64)

    for block in whole_words(data.lower()):
        words = held + block
        if len(words) < shingle:
            held = words
            continue
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
        ends = ends[shingle - 1 :].tolist()
        joined = b" ".join(words)
        for i in range(0, len(starts), HASHES_AT_ONCE):
            edges = zip(starts[i : i + HASHES_AT_ONCE], ends[i : i + HASHES_AT_ONCE], strict=True)
            hashes = np.fromiter(
                (xxh64_intdigest(joined[a:b], seed) for a, b in edges),
                np.uint64,
                min(HASHES_AT_ONCE, len(starts) - i),
            )
            ones += add(hashes)
        total += len(starts)
        held = words[len(words) - shingle + 1 :] if shingle > 1 else []
    if not total and held:
        ones += add(np.array([xxh64_intdigest(b" ".join(held), seed)], np.uint64))
        total = 1
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def with_fingerprints(docs, keep, shingle=SHINGLE_WORDS, seed=SEED):
    """The columns ``keep`` of documents with a ``text``, and ``__fingerprint``, a signed number."""
    import pyarrow as pa

    given = docs.select("text", *[F.col(name).alias(f"__{i}") for i, name in enumerate(keep)])

    def add(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                made = [fingerprint(t, shingle, seed) for t in byte_list(part.column(0))]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.array(made, pa.int64())], [*keep, "__fingerprint"]
                )

    fields = [T.StructField(name, docs.schema[name].dataType) for name in keep]
    fields.append(T.StructField("__fingerprint", T.LongType()))
    return given.mapInArrow(add, T.StructType(fields))


class Variants:
    """All ways to flip at most half the radius of 64 bits, by the group they lead to.

    A group is named by the parities of ``blocks`` blocks of bits, the first the
    lowest; ``more`` blocks that cut across these divide every group further.
    """

    def __init__(self, radius, blocks, more=0):
        import numpy as np

        self.radius, self.inner = radius, radius // 2
        members = [[bit for bit in range(64) if bit % blocks == n] for n in range(blocks)]
        members += [[bit for bit in range(64) if bit // blocks % more == n] for n in range(more)]
        self.masks = [np.uint64(sum(1 << bit for bit in block)) for block in members]
        flips = [bits for n in range((radius + 1) // 2 + 1) for bits in combinations(range(64), n)]
        values = np.array([sum(1 << bit for bit in bits) for bits in flips], np.uint64)
        codes = self.code(values)
        order = np.argsort(codes, kind="stable")
        self.flips = values[order]
        self.is_inner = np.array([len(bits) for bits in flips])[order] <= self.inner
        # The flips from ``edges[n]`` to ``edges[n + 1]`` turn the parities ``reached[n]``.
        self.reached, first = np.unique(codes[order], return_index=True)
        self.edges = np.r_[first, len(flips)]

    def code(self, values):
        """The parities of each value's blocks, as a number; flips combine by exclusive or."""
        import numpy as np

        result = np.zeros(len(values), np.int64)
        for place, mask in enumerate(self.masks):
            result |= (np.bitwise_count(values & mask) & 1).astype(np.int64) << place
        return result

    def spans(self, codes, group):
        """Per entry of ``reached``, where in sorted codes those lie that it turns into ``group``."""
        import numpy as np

        wanted = self.reached ^ group
        return np.searchsorted(codes, wanted), np.searchsorted(codes, wanted, "right")

    def of_group(self, values, order, codes, group):
        """(variants, index of the fingerprint, whether within the inner half) of one group.

        ``order`` sorts the values by their ``codes``, which are given sorted.
        """
        import numpy as np

        parts = [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, bool))]
        for n, (low, high) in enumerate(zip(*self.spans(codes, group), strict=True)):
            if high > low:
                rows, chosen = order[low:high], slice(self.edges[n], self.edges[n + 1])
                made = values[rows][:, None] ^ self.flips[chosen][None, :]
                inner = np.broadcast_to(self.is_inner[chosen], made.shape)
                parts.append((made.ravel(), np.repeat(rows, made.shape[1]), inner.ravel()))
        return tuple(np.concatenate(columns) for columns in zip(*parts, strict=True))


def smallest_linked(left, right, count):
    """For nodes 0 to ``count`` - 1 the smallest node that the links connect them to."""
    import numpy as np

    label = np.arange(count)
    while True:
        before = label.copy()
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        np.minimum.at(label, before[left], low)
        np.minimum.at(label, before[right], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(label, before):
            return label


def links_of_group(values, group, radius, blocks, per_part=PER_PART):
    """Links within a group, as (fingerprint, smaller one) pairs.

    A group of many near values is cut by more parities into parts that are made
    one by one.
    """
    import numpy as np

    values = np.unique(values.view(np.int64)).view(np.uint64)

    def sorted_codes(variants):
        codes = variants.code(values)
        order = np.argsort(codes, kind="stable")
        return order, codes[order]

    variants, more = Variants(radius, blocks), 0
    order, codes = sorted_codes(variants)
    low, high = variants.spans(codes, group)
    total = int(((high - low) * np.diff(variants.edges)).sum())
    while total / 2**more > per_part and more < -(-64 // blocks):
        more += 1
    if more:
        variants = Variants(radius, blocks, more)
        order, codes = sorted_codes(variants)
    parts = [
        links_of_part(values, order, codes, group | part << blocks, variants)
        for part in range(2**more)
    ]
    return tuple(np.concatenate(column) for column in zip(*parts, strict=True))


def links_of_part(values, order, codes, group, variants):
    """A spanning forest of the links within one part of a group."""
    import numpy as np

    made, owner, inner = variants.of_group(values, order, codes, group)
    # A variant's first owner holds it within the inner half, if any does.
    by = np.argsort(made, kind="stable") if inner.all() else np.lexsort((~inner, made))
    made, owner, inner = made[by], owner[by], inner[by]
    starts = np.flatnonzero(np.r_[True, made[1:] != made[:-1]]) if len(made) else []
    if len(starts) == len(made):
        return values[:0], values[:0]
    sizes = np.diff(np.r_[starts, len(made)])
    shared = np.repeat(sizes > 1, sizes)
    first = np.repeat(starts, sizes)[shared]
    head, tail = owner[first], owner[shared]
    near = np.bitwise_count(values[head] ^ values[tail]) <= variants.radius
    near &= inner[first] & (head != tail)
    head, tail = head[near], tail[near]
    nodes, ends = np.unique(np.r_[head, tail], return_inverse=True)
    label = smallest_linked(ends[: len(head)], ends[len(head) :], len(nodes))
    linked = label != np.arange(len(nodes))
    return values[nodes[linked]], values[nodes[label[linked]]]


def near_links(prints, radius=RADIUS, per_group=PER_GROUP):
    """Links that connect all fingerprints at most ``radius`` bits apart.

    ``prints`` is a stored table of distinct ``fingerprint`` values. Gives
    ``node`` and ``root`` pairs; the root is the smaller as a signed number.
    """
    import pyarrow as pa

    variants = sum(math.comb(64, n) for n in range((radius + 1) // 2 + 1))
    wanted = max(FEWEST_GROUPS, prints.count() * variants / per_group)
    blocks = min(math.ceil(math.log2(wanted)), MOST_BLOCKS)

    def deal(batches):
        import numpy as np

        variants = Variants(radius, blocks)
        for batch in batches:
            column = batch.column(0).to_numpy(zero_copy_only=False)
            for start in range(0, len(column), 4096):
                values = column[start : start + 4096]
                codes = variants.code(values.view(np.uint64))
                groups = codes[:, None] ^ variants.reached[None, :]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(groups.ravel(), pa.int64()),
                        pa.array(np.repeat(values, len(variants.reached)), pa.int64()),
                    ],
                    ["group", "fingerprint"],
                )

    def link(key, table):
        import numpy as np

        values = table.column("fingerprint").to_numpy().view(np.uint64)
        nodes, roots = links_of_group(values, key[0].as_py(), radius, blocks)
        return pa.table(
            {"node": pa.array(nodes.view(np.int64)), "root": pa.array(roots.view(np.int64))}
        )

    dealt = prints.select("fingerprint").mapInArrow(deal, "group long, fingerprint long")
    return dealt.groupBy("group").applyInArrow(link, "node long, root long")


def connected(links):
    """For every node of (node, root) links, roots left out, the root of its component.

    Each round points all smaller neighbours of a node at the smallest of them,
    and then every link at the smallest neighbour of its end. It is done when no
    node has two neighbours and no neighbour has one itself.
    """
    while True:
        least = F.min("root").over(Window.partitionBy("node"))
        both = F.array(
            F.struct("node", F.col("least").alias("root")),
            F.struct(F.col("root").alias("node"), F.col("least").alias("root")),
        )
        turned = (
            links.withColumn("least", least)
            .select(F.explode(both).alias("link"))
            .select("link.*")
            .filter("node != root")
            .distinct()
        )
        turned = stored(turned, "links")
        ups = turned.groupBy(F.col("node").alias("end")).agg(F.min("root").alias("up"))
        joined = stored(
            turned.join(stored(ups, "ups"), F.col("root") == F.col("end"), "left")
            .select("node", "root", "up"),
            "joined",
        )
        total, nodes, open_ends = joined.agg(
            F.count("*"), F.countDistinct("node"), F.count("up")
        ).first()
        if total == nodes and not open_ends:
            return turned
        links = joined.select("node", F.coalesce("up", "root").alias("root")).distinct()


def components(prints, radius=RADIUS, per_group=PER_GROUP):
    """Components of stored, distinct (``fingerprint``, ``first_id``) rows.

    Gives ``fingerprint``, ``component`` (a fingerprint of it that stands for
    it) and ``component_id`` (its smallest ``first_id``).
    """
    roots = connected(near_links(prints, radius, per_group))
    ends = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    linked = stored(
        prints.join(stored(ends, "ends"), F.col("fingerprint") == F.col("node")), "linked"
    )
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("least"))
    named = linked.select("node", "root").join(stored(smallest, "smallest"), "root")
    return prints.join(
        stored(named, "named"), F.col("fingerprint") == F.col("node"), "left"
    ).select(
        "fingerprint",
        F.coalesce("root", "fingerprint").alias("component"),
        F.coalesce("least", "first_id").alias("component_id"),
    )


def text_key():
    """Tells a row's text from others of its id."""
    return F.xxhash64("text").alias("__text_key")


def known_id():
    return F.coalesce("doc_id", F.lit(NO_ID)).alias("__id")


def classified(docs, shingle=SHINGLE_WORDS, radius=RADIUS, seed=SEED):
    """``near_duplicates`` with ``__id`` and ``__text_key``, by which a row is found again."""
    keyed = docs.select("doc_id", "text", known_id(), text_key())
    rows = with_fingerprints(keyed, ["doc_id", "__id", "__text_key"], shingle, seed)
    rows = stored(rows, "fingerprints")
    prints = rows.groupBy(F.col("__fingerprint").alias("fingerprint")).agg(
        F.min("__id").alias("first_id")
    )
    found = stored(components(stored(prints, "prints"), radius), "components")
    return rows.join(found, F.col("__fingerprint") == F.col("fingerprint"), "left").select(
        *rows.columns,
        "component",
        F.when(F.col("component_id") != NO_ID, F.col("component_id")).alias("component_id"),
    )


def near_duplicates(docs, **given):
    """``doc_id``, ``__fingerprint``, ``component`` and ``component_id`` of every row."""
    return classified(docs, **given).drop("__id", "__text_key")


def one_of_each(docs, **given):
    """Documents without near-duplicates: of each component the row of the smallest id.

    Returns the columns of ``docs``; rows with equal id and fingerprint count as one.
    """
    row = F.min(F.struct("__id", "__fingerprint", "__text_key")).alias("row")
    docs, back = renamed(docs)
    kept = (
        classified(docs, **given).groupBy("component").agg(row).select("row.__id", "row.__text_key")
    )
    keys = ["__id", "__text_key"]
    return back(
        docs.select("*", known_id(), text_key())
        .join(stored(kept, "kept"), keys, "left_semi")
        .dropDuplicates(keys)
    )
