"""Quality rules on repeated passages, by a suffix array over the words of each text.

The suffixes of many texts are sorted at once by prefix doubling; words of
different texts never compare equal, so repeats stay within a text. The longest
common prefix of neighbours gives the deepest interval that every suffix lies
in: the longest substring that starts there and occurs elsewhere in the text.
Those of at least ``MIN_REPEAT`` words are the maximal repeated substrings;
their spans are united. Prefixes are measured by hashes and then compared in the
order of the text, so they are exact and memory grows with the words of a text.

Base rules are counted beside it. Defined results: a NULL text has no words and
fails the base rules; repeated rows are judged each; an empty table gives an
empty result; texts of any length are read whole; other columns are left out or, in
``clean``, kept, whatever their names.
"""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.llm.shared import byte_list, renamed, whole_words

#: A repeated passage has at least this many words.
MIN_REPEAT = 8
#: A text fails if repeated passages cover more of its words than this, or if
#: the longest one is longer than this many words, however long the text is.
MOST_COVERED, LONGEST_REPEAT = 0.30, 100
#: Base rules: fewest words, and the largest percentage of words in repeated windows.
MIN_WORDS, WINDOW, MOST_WINDOW_PERCENT = 50, 3, 50
#: Words whose suffixes are sorted at once; a longer text is sorted alone.
WORDS_AT_ONCE = 200_000
#: Modulus of the prefix hashes, tries with other bases, and symbols compared at a time.
PRIME, ATTEMPTS, COMPARED_AT_ONCE = 2**31 - 1, 20, 1 << 20

SPACES = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))


def powers_of(base, n):
    """Powers of ``base`` modulo ``PRIME``, from 0 to ``n``."""
    import numpy as np

    found = np.ones(1, np.uint64)
    while len(found) <= n:
        step = np.uint64(pow(base, len(found), PRIME))
        found = np.concatenate([found, found * step % np.uint64(PRIME)])[: n + 1]
    return found


def guessed_prefix(symbols, room, left, right, levels, bases):
    """Length up to ``room`` of the common prefix of suffixes, as two hashes of prefixes see it."""
    import numpy as np

    prime, n = np.uint64(PRIME), len(symbols)
    hashes = []
    for base in bases:
        powers = powers_of(base, n)
        terms = (symbols.astype(np.uint64) + np.uint64(1)) % prime * powers[:n] % prime
        np.cumsum(terms, out=terms)
        terms %= prime
        sums = np.zeros(n + 1, np.uint32)
        sums[1:] = terms
        hashes.append((sums, powers.astype(np.uint32)))
        del powers, terms, sums
    common = np.zeros(len(left), left.dtype)
    for level in range(levels - 1, -1, -1):
        step = 1 << level
        fits = np.flatnonzero(common + step <= room)
        low = np.minimum(left[fits], right[fits]) + common[fits]
        high = np.maximum(left[fits], right[fits]) + common[fits]
        same = np.ones(len(fits), bool)
        for sums, powers in hashes:
            first, second = (
                (sums[at + step].astype(np.uint64) + prime - sums[at]) % prime for at in (low, high)
            )
            same &= first * powers[high - low] % prime == second
        common[fits[same]] += step
    return common


def is_common_prefix(symbols, room, left, right, common):
    """Whether ``common`` is right for every suffix and the one before it in their order.

    If the suffix at p shares h symbols with the one before it, the one at p + 1 shares at
    least h - 1 with its own; only what goes beyond is compared, twice the text at most.
    """
    import numpy as np

    by_place = np.zeros(len(symbols) + 1, common.dtype)
    by_place[right + 1] = common
    sure = np.maximum(by_place[right] - 1, 0)
    if (common < sure).any():
        return False
    goes_on = np.flatnonzero(common < room)
    goes_on_by = common[goes_on]
    if (symbols[left[goes_on] + goes_on_by] == symbols[right[goes_on] + goes_on_by]).any():
        return False
    until = np.cumsum(common - sure, dtype=np.int64)
    for start in range(0, int(until[-1]) if len(until) else 0, COMPARED_AT_ONCE):
        turn = np.arange(start, min(start + COMPARED_AT_ONCE, until[-1]))
        pair = np.searchsorted(until, turn, side="right")
        ahead = common[pair] - (until[pair] - turn)
        if (symbols[left[pair] + ahead] != symbols[right[pair] + ahead]).any():
            return False
    return True


def common_prefix(symbols, ends, left, right, levels):
    """Length of the common prefix of neighbours in the order of suffixes, below 2**levels.

    Exact: guessed by hashes, then compared; a wrong guess is made again by other hashes.
    """
    import numpy as np

    room = (ends[left] - np.maximum(left, right)).astype(left.dtype)
    for attempt in range(ATTEMPTS):
        bases = [pow(7, 100_003 * (2 * attempt + i) + 17, PRIME) for i in (1, 2)]
        common = guessed_prefix(symbols, room, left, right, levels, bases)
        if is_common_prefix(symbols, room, left, right, common):
            return common
    raise ArithmeticError("no pair of hashes told the suffixes apart")


def longest_elsewhere(symbols, ends):
    """For every position, how many symbols from it on occur elsewhere too.

    ``symbols`` are numbers from 0, distinct between texts; ``ends`` holds for every
    position the end of its text. Memory is a fixed number of arrays as long as the input.
    """
    import numpy as np

    n = len(symbols)
    kind = np.int32 if n < 2**31 - 2 else np.int64
    result = np.zeros(n, kind)
    if n < 2:
        return result
    order = np.argsort(symbols, kind="stable").astype(kind)
    index = np.arange(n, dtype=kind)
    new = np.r_[True, np.diff(symbols[order]) != 0]
    rank = np.empty(n, kind)
    rank[order] = np.maximum.accumulate(np.where(new, index, kind(0)))
    active = order[~(new & np.r_[new[1:], True])]
    repeated = np.zeros(n, bool)
    repeated[active] = True
    del order, new
    # ``rank`` orders the suffixes by their first 2**levels symbols.
    levels = 0
    while len(active):
        beyond = active + kind(1 << levels)
        inside = beyond < ends[active]
        second = np.where(inside, rank[np.minimum(beyond, n - 1)] + kind(1), kind(0))
        del beyond, inside
        both = rank[active] * np.int64(n + 2) + second
        by = np.argsort(both, kind="stable").astype(kind)
        del both
        active, second = active[by], second[by]
        del by
        old, place = rank[active], index[: len(active)]
        old_new = np.r_[True, old[1:] != old[:-1]]
        new = old_new | np.r_[True, second[1:] != second[:-1]]
        first_old = np.maximum.accumulate(np.where(old_new, place, kind(0)))
        first_new = np.maximum.accumulate(np.where(new, place, kind(0)))
        rank[active] = old + (first_new - first_old)
        active = active[~(new & np.r_[new[1:], True])]
        levels += 1
    del active
    suffixes = np.empty(n, kind)
    suffixes[rank] = index
    spots = np.flatnonzero(repeated[suffixes])
    left, right = suffixes[spots[:-1]], suffixes[spots[1:]]
    near = (np.diff(spots) == 1) & (symbols[left] == symbols[right])
    left, right = left[near], right[near]
    del rank, suffixes, spots, near, repeated, index
    common = common_prefix(symbols, ends, left, right, levels)
    # Every suffix is at most once the left and once the right one.
    result[left] = common
    result[right] = np.maximum(result[right], common)
    return result


def covered(starts, lengths, n):
    """A flag per position: whether a span covers it."""
    import numpy as np

    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:n]) > 0


def repeated_lines(data):
    """Lines with a word that equal an earlier line."""
    lines = [line for line in data.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def measure(texts, min_repeat=MIN_REPEAT):
    """One dictionary of counts and ``repeat_spans`` ([start, end) in words) per text."""
    import numpy as np

    found = []
    held, known, size = [], {}, 0

    def flush():
        if not held:
            return
        starts = [0, *np.cumsum([len(symbols) for symbols in held]).tolist()]
        n = starts[-1]
        # Texts have numbers of their own.
        largest = max(n, len(held) * (len(known) + 1))
        kind = np.int32 if largest < 2**31 else np.int64
        whole = np.empty(n, kind)
        for row, symbols in enumerate(held):
            whole[starts[row] : starts[row + 1]] = symbols
            whole[starts[row] : starts[row + 1]] += row * (len(known) + 1)
        held.clear()
        known.clear()
        ends = np.repeat(np.array(starts[1:], kind), np.diff(starts))
        longest = longest_elsewhere(whole, ends)
        short = np.flatnonzero(longest >= WINDOW)
        window = covered(short, np.full(len(short), WINDOW), n)
        long = np.flatnonzero(longest >= min_repeat)
        passage = covered(long, longest[long], n)
        for low, high in zip(starts, starts[1:], strict=False):
            part = np.r_[False, passage[low:high], False].astype(np.int8)
            edges = np.flatnonzero(np.diff(part)).reshape(-1, 2)
            found.append({
                "n_words": high - low,
                "n_repeat_words": int(window[low:high].sum()),
                "covered_words": int((edges[:, 1] - edges[:, 0]).sum()),
                "longest_repeat": int(longest[low:high].max(initial=0)),
                "repeat_spans": edges.tolist(),
            })

    for data in texts:
        # A text has a word per two bytes at most.
        if size + len(data) // 2 + 1 > WORDS_AT_ONCE:
            flush()
            size = 0
        parts = [
            np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))
            for words in whole_words(data)
        ]
        held.append(np.concatenate(parts))
        size += len(held[-1])
    flush()
    for row, data in zip(found, texts, strict=True):
        inked = data.translate(None, SPACES)
        row["word_chars"] = len(inked.translate(None, CONTINUATION))
        row["n_symbols"] = len(data) - len(data.translate(None, SYMBOLS))
        row["n_dup_lines"] = repeated_lines(data)
    return found


COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words",
    "longest_repeat",
)


def judge(docs, keep=("doc_id",), min_repeat=MIN_REPEAT, spans=False):
    """Counts and verdicts of every text beside the columns ``keep``.

    With ``spans`` also ``repeat_spans``: the united spans, in words.
    """
    import pyarrow as pa

    given = docs.select("text", *[F.col(name).alias(f"__{i}") for i, name in enumerate(keep)])
    made = [*COUNTS, "repeat_spans"] if spans else list(COUNTS)
    names = [*keep, *[f"__{name}" for name in made]]

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                rows = measure(byte_list(part.column(0)), min_repeat)
                columns = [pa.array([r[name] for r in rows], pa.int64()) for name in COUNTS]
                if spans:
                    kind = pa.list_(pa.list_(pa.int64()))
                    columns.append(pa.array([r["repeat_spans"] for r in rows], kind))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *columns], names)

    fields = [T.StructField(name, docs.schema[name].dataType) for name in keep]
    fields += [T.StructField(f"__{name}", T.LongType()) for name in COUNTS]
    if spans:
        fields.append(T.StructField("__repeat_spans", T.ArrayType(T.ArrayType(T.LongType()))))
    words, windows = F.col("__n_words"), F.col("__n_repeat_words")
    failed = (words < MIN_WORDS) | (100 * windows > MOST_WINDOW_PERCENT * words)
    covering = F.col("__covered_words") > MOST_COVERED * words
    longest = F.col("__longest_repeat")
    return (
        given.mapInArrow(run, T.StructType(fields))
        .withColumn("__base_failed", failed)
        .withColumn("__kept", ~failed & ~covering & (longest <= LONGEST_REPEAT))
    )


def clean(docs):
    """The documents that pass, with the columns of ``docs``."""
    rows, back = renamed(docs)
    return back(judge(rows, rows.columns).filter("__kept"))
