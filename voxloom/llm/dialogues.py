"""Repair of conversation structure by depth-first branch-and-bound.

A repaired conversation has the role initials ``(s?(ua)+)?``. Every row is kept (K),
given the role that fits (R) or deleted (D), and empty messages may be inserted (I)
anywhere; blank and duplicate rows must go. The cheapest edits are wanted, of equally
cheap ones the ASCII-least.

The search keeps an explicit stack and tries edits in ASCII order, so prefixes come up in
ASCII order and the first of equal cost is the least. A prefix is cut if its cost and a
lower bound of what the later rows must cost reach the incumbent, or if an earlier
prefix came as cheaply to the same row and the same last role (the node's dominance
table). When the stack is empty the incumbent is proved.

Rows are range-partitioned by conversation and turn, so a conversation of any length
is spread over tasks. Tasks cut it into runs of ``RUN_ROWS`` distinct rows and search them
in segments of ``SEGMENT_ROWS``: for every last role before, the best edits for every
last role after. These tables join exactly, since edits up to a row are never the
beginning of other edits up to that row; joining the runs of a conversation needs
their costs and their order only, a few numbers a run. A conversation in one run that
is short enough is searched whole.

Defined results: NULL roles and texts count as one space, which makes the row blank or
its role unfit to be kept; so is a role without a first letter. Rows stand by turn,
NULL first, then by role and the SHA-256 of the text; equal rows are copies of which
the later ones are duplicates. Rows of a NULL id are one conversation. Turn gaps
stop at the largest 64-bit number. Only ``conv_id``, ``turn``, ``role`` and ``text``
are read, so other columns may have any name; texts are only hashed and joined, never
gathered; an empty table gives empty results.
"""

import hashlib
from functools import lru_cache

from pyspark.sql import functions as F

from voxloom.session import stored

SEGMENT_ROWS, RUN_ROWS = 64, 8192
#: Distinct rows of runs that a task holds back before it gives them away.
CELLS_AT_ONCE = 16_384
#: Last roles so far: none yet, system, user, assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
#: The role that must come next, and what has been said once it has; None before any.
NEXT_ROLE = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Inserts that complete a conversation.
CLOSING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
LEGAL = {"su", "ua", "au"}
MOST = 2**63 - 1
NON_SPACE = r"[^\x20\x09-\x0D]"


# The search


def after_keeping(state, initial):
    """The last role after a row is kept; None if its role may not stand there."""
    if state == START and initial == "s":
        return SYSTEM
    return NEXT[state] if initial == NEXT_ROLE[state][0] else None


def lower_bounds(items):
    """What items from each place on must cost at least.

    Forced deletions cost their price and truncated rows a deletion. A row of no known
    role costs a new one, and of two neighbours whose roles may not follow each
    other one must change.
    """
    own = [
        DELETE * copies if initial is None
        else DELETE if truncated
        else 0 if initial and initial in "sua" else REROLE
        for initial, truncated, copies in items
    ]
    bounds = [0] * (len(items) + 1)
    for place in reversed(range(len(items))):
        bounds[place] = own[place] + bounds[place + 1]
        if place + 1 < len(items) and not own[place] and not own[place + 1]:
            if items[place][0] + items[place + 1][0] not in LEGAL:
                bounds[place] = max(bounds[place], REROLE + bounds[place + 2])
    return bounds


def greedy_cost(items):
    """Cost of giving each row the role that fits: a first incumbent."""
    state, cost = START, 0
    for initial, truncated, copies in items:
        if initial is None:
            cost += DELETE * copies
        elif truncated:
            cost += DELETE
        else:
            kept = after_keeping(state, initial)
            cost += 0 if kept is not None else REROLE
            state = NEXT[state] if kept is None else kept
    return cost + INSERT * len(CLOSING[state])


@lru_cache(maxsize=100_000)
def search(items, entry, final):
    """Best (cost, audit) for every last role after ``items``, from ``entry`` on.

    Items are (role initial, truncated, copies); the initial None marks rows that
    must go. With ``final`` the conversation ends there: the closing inserts count
    and the one result stands under START.
    """
    end, bounds = len(items), lower_bounds(items)
    best, cheapest = {}, {}
    if final:
        limit = greedy_cost(items) + 1 if entry == START else MOST
        wanted = 1
    else:
        limit, wanted = MOST, len(reachable(items, entry))
    path = bytearray()
    stack = [(0, entry, 0, 0, b"")]
    while stack:
        place, state, cost, depth, edit = stack.pop()
        if cost + bounds[place] >= limit or cheapest.get((place, state), MOST) <= cost:
            continue
        cheapest[place, state] = cost
        del path[depth:]
        path += edit
        if place == end:
            closing = CLOSING[state] if final else ""
            key, whole = START if final else state, cost + INSERT * len(closing)
            if key not in best or whole < best[key][0]:
                best[key] = whole, path.decode() + closing
                if len(best) == wanted:
                    limit = min(limit, max(c for c, _ in best.values()))
            continue
        initial, truncated, copies = items[place]
        depth = len(path)
        # The stack gives back the last first: D, I, K, R.
        if initial is not None:
            extra = cost + (TRUNCATED if truncated else 0)
            stack.append((place + 1, NEXT[state], extra + REROLE, depth, b"R"))
            kept = after_keeping(state, initial)
            if kept is not None:
                stack.append((place + 1, kept, extra, depth, b"K"))
        stack.append((place, NEXT[state], cost + INSERT, depth, b"I"))
        stack.append((place + 1, state, cost + DELETE * copies, depth, b"D" * copies))
    return best


def reachable(items, entry):
    """Last roles that edits of ``items`` can lead to."""
    states = {USER, ASSISTANT, entry}
    if entry == START and any(item[0] == "s" for item in items):
        states.add(SYSTEM)
    return states


def joined(tables):
    """One table of (entry, exit) to (cost, audit) for segments in a row."""
    whole = {(entry, entry): (0, "") for entry in STATES}
    for table in tables:
        longer = {}
        for entry in STATES:
            for middle in STATES:
                if (entry, middle) not in whole:
                    continue
                cost, audit = whole[entry, middle]
                for leave in STATES:
                    if (middle, leave) in table:
                        more, rest = table[middle, leave]
                        found = cost + more, audit + rest
                        if (entry, leave) not in longer or found < longer[entry, leave]:
                            longer[entry, leave] = found
        whole = longer
    return whole


def run_table(items):
    """Best (cost, audit) of a run for every role before and after it."""
    tables = []
    for start in range(0, len(items), SEGMENT_ROWS):
        part = tuple(items[start : start + SEGMENT_ROWS])
        tables.append(
            {(entry, leave): found for entry in STATES
             for leave, found in search(part, entry, False).items()}
        )
    return joined(tables)


def whole_run(items):
    """(cost, audit) of a conversation that lies in one run."""
    if len(items) <= SEGMENT_ROWS:
        return search(tuple(items), START, True)[START]
    table = run_table(items)
    return min(
        (table[START, leave][0] + INSERT * len(CLOSING[leave]),
         table[START, leave][1] + CLOSING[leave])
        for leave in STATES if (START, leave) in table
    )


def chosen_path(costs, ranks):
    """(cost, entry of each run and the last exit) of the best way through runs in a row.

    ``costs`` and ``ranks`` hold a run's table at 4 * entry + exit; a cost of -1 is no way.
    Ranks put the audits of one run and entry in ASCII order.
    """
    # Cost and ASCII place of the best prefix for each last role.
    prefixes, back = {START: (0, 0)}, []
    for run_costs, run_ranks in zip(costs, ranks, strict=True):
        best = {}
        for entry, (cost, place) in prefixes.items():
            for leave in STATES:
                more = run_costs[4 * entry + leave]
                if more >= 0:
                    found = cost + more, (place, run_ranks[4 * entry + leave]), entry
                    if leave not in best or found < best[leave]:
                        best[leave] = found
        order = sorted({found[1] for found in best.values()})
        prefixes = {leave: (found[0], order.index(found[1])) for leave, found in best.items()}
        back.append({leave: found[2] for leave, found in best.items()})
    cost, _, last = min(
        (cost + INSERT * len(CLOSING[leave]), place, leave)
        for leave, (cost, place) in prefixes.items()
    )
    way = [last]
    for entries in reversed(back):
        way.append(entries[way[-1]])
    return cost, way[::-1]


# Rows


def row_key(text):
    return F.unhex(F.sha2(text, 256))


def plain_rows(rows):
    """``conv_id``, ``turn``, and ``role`` and ``text`` without NULLs."""
    return rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    )


def distinct_rows(rows):
    """Distinct rows with their copies, what is wrong with them, and whether one may stay."""
    last = F.regexp_extract("text", rf"(?s)({NON_SPACE})[\x20\x09-\x0D]*\z", 1)
    cells = (
        plain_rows(rows)
        .withColumn("key", row_key(F.col("text")))
        .withColumn("last", last)
        .groupBy("conv_id", "turn", "role", "key")
        .agg(F.count("*").alias("copies"), F.first("last").alias("last"))
    )
    cells = stored(cells, "dialogues")
    # Only texts of one role that come back in another turn.
    again = (
        cells.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("key").alias("k"))
        .agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("turns"))
        .filter("turns > 1")
    )
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (
        F.col("key") == F.col("k")
    )
    first = F.col("first").isNull() | F.col("first.turn").eqNullSafe(F.col("turn"))
    blank = F.col("last") == ""
    return cells.join(again, same, "left").select(
        "conv_id", "turn", "role", "key", "copies", blank.alias("blank"),
        (~blank & first).alias("free"),
        (~blank & ~F.col("last").isin(".", "!", "?")).alias("truncated"),
    )


RUN = (
    "part int, piece int, edge boolean, "
    "cells array<struct<turn: bigint, role: string, key: binary, copies: bigint, free: boolean>>, "
    "costs array<bigint>, ranks array<int>, audits array<string>, rows bigint, blank bigint, "
    "duplicate bigint, truncated bigint, illegal bigint, initial string, final string, "
    "least bigint, most bigint, turns bigint"
)
FAULTS = ["blank", "duplicate", "truncated", "illegal"]


def summary(cells):
    """Counts of a run, and what joining it to its neighbours needs."""
    found = dict.fromkeys(["rows", *FAULTS, "turns"], 0) | {"least": None, "most": None}
    before = None
    for cell in cells:
        copies, initial = cell["copies"], cell["role"][:1]
        found["rows"] += copies
        found["illegal"] += copies - 1
        if before is not None and before + initial not in LEGAL:
            found["illegal"] += 1
        before = initial
        if cell["blank"]:
            found["blank"] += copies
        else:
            found["duplicate"] += copies - cell["free"]
            found["truncated"] += cell["free"] and cell["truncated"]
        if cell["turn"] is not None:
            if found["most"] != cell["turn"]:
                found["turns"] += 1
            found["most"] = cell["turn"]
            found["least"] = cell["turn"] if found["least"] is None else found["least"]
    return found | {"initial": cells[0]["role"][:1], "final": before}


def search_items(cells):
    """What the search sees of distinct rows: one that may stay, then those that must go."""
    items = []
    for cell in cells:
        rest = cell["copies"] - cell["free"]
        if cell["free"]:
            items.append((cell["role"][:1], cell["truncated"], 1))
        if rest:
            items.append((None, False, rest))
    return items


def solve(cells, edge):
    """A run's cells and what its search found."""
    narrow = [{n: c[n] for n in ("turn", "role", "key", "copies", "free")} for c in cells]
    return {"edge": edge, "cells": narrow} | solve_items(search_items(cells), edge)


def solve_items(items, edge):
    """Tables of a run whose conversation may go on elsewhere, else its solution at 0."""
    costs, ranks, audits = [-1] * 16, [0] * 16, [None] * 16
    if edge:
        table = run_table(items)
        for (entry, leave), (cost, audit) in table.items():
            costs[4 * entry + leave], audits[4 * entry + leave] = cost, audit
        for entry in STATES:
            order = sorted({a for a in audits[4 * entry : 4 * entry + 4] if a is not None})
            for at in range(4 * entry, 4 * entry + 4):
                ranks[at] = order.index(audits[at]) if audits[at] is not None else 0
    else:
        costs[0], audits[0] = whole_run(items)
    return {"costs": costs, "ranks": ranks, "audits": audits}


def find_runs(rows):
    """The runs of all conversations, each searched, stored."""
    import pyarrow as pa

    cells = distinct_rows(rows)
    kind = cells.schema["conv_id"].dataType.simpleString()
    schema, arrow = f"conv_id {kind}, {RUN}", run_arrow_schema(arrow_type(cells))

    def cut(batches):
        """(cells, whether their conversation may go on elsewhere) of every run of a task."""
        gathered, first, cut_before = [], True, False
        for batch in batches:
            for cell in batch.to_pylist():
                if gathered and cell["conv_id"] != gathered[-1]["conv_id"]:
                    # A task's first conversation may begin in the task before.
                    yield gathered, first or cut_before
                    gathered, first, cut_before = [], False, False
                elif len(gathered) >= RUN_ROWS:
                    yield gathered, True
                    gathered, cut_before = [], True
                gathered.append(cell)
        if gathered:
            yield gathered, True

    def walk(batches):
        out, held = [], 0
        for piece, (gathered, edge) in enumerate(cut(batches)):
            head = {"conv_id": gathered[0]["conv_id"], "part": gathered[0]["part"], "piece": piece}
            out.append(head | solve(gathered, edge) | summary(gathered))
            held += len(gathered)
            if held >= CELLS_AT_ONCE:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    placed = (
        stored(cells, "dialogues")
        .repartitionByRange("conv_id", "turn", "role", "key")
        .sortWithinPartitions("conv_id", "turn", "role", "key")
        .withColumn("part", F.spark_partition_id())
    )
    return stored(placed.mapInArrow(walk, schema), "dialogues")


def arrow_type(frame, column="conv_id"):
    """The Arrow type of a column."""
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(frame.schema[column].dataType)


def run_arrow_schema(conv_type):
    import pyarrow as pa

    cell = pa.struct([
        ("turn", pa.int64()), ("role", pa.string()), ("key", pa.binary()),
        ("copies", pa.int64()), ("free", pa.bool_()),
    ])
    return pa.schema([
        ("conv_id", conv_type), ("part", pa.int32()), ("piece", pa.int32()), ("edge", pa.bool_()),
        ("cells", pa.list_(cell)), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32())),
        ("audits", pa.list_(pa.string())),
        *[(n, pa.int64()) for n in ["rows", *FAULTS]],
        ("initial", pa.string()), ("final", pa.string()),
        *[(n, pa.int64()) for n in ["least", "most", "turns"]],
    ])


REPORT = ["gaps", *FAULTS, "cost"]


def gap_count(least, most, turns):
    return 0 if least is None else min(most - least + 1 - turns, MOST)


def join_runs(runs):
    """For conversations that may lie in several runs: each run's entry and exit, and the report.

    The report stands beside the last run.
    """
    import pyarrow as pa

    names = [
        "part", "piece", "costs", "ranks", *FAULTS, "initial", "final", "least", "most", "turns"
    ]
    kind = runs.schema["conv_id"].dataType.simpleString()
    schema = (
        f"conv_id {kind}, part int, piece int, entry int, exit int, last boolean, "
        + ", ".join(f"{n} long" for n in REPORT)
    )
    arrow = pa.schema([
        ("conv_id", arrow_type(runs)), ("part", pa.int32()), ("piece", pa.int32()),
        ("entry", pa.int32()), ("exit", pa.int32()), ("last", pa.bool_()),
        *[(n, pa.int64()) for n in REPORT],
    ])

    def join(table):
        rows = table.sort_by([("part", "ascending"), ("piece", "ascending")])
        conv = rows.column("conv_id")[0].as_py()
        each = rows.select(names).to_pylist()
        cost, way = chosen_path([r["costs"] for r in each], [r["ranks"] for r in each])
        found = {n: sum(r[n] for r in each) for n in FAULTS}
        least = most = before = None
        turns = 0
        for r in each:
            if before is not None and before + r["initial"] not in LEGAL:
                found["illegal"] += 1
            before = r["final"]
            if r["least"] is not None:
                turns += r["turns"] - (r["least"] == most)
                least, most = r["least"] if least is None else least, r["most"]
        report = {"gaps": gap_count(least, most, turns), "cost": cost} | found
        made = [
            {"conv_id": conv, "part": r["part"], "piece": r["piece"], "entry": way[n],
             "exit": way[n + 1], "last": n == len(each) - 1}
            | (report if n == len(each) - 1 else dict.fromkeys(REPORT))
            for n, r in enumerate(each)
        ]
        return pa.Table.from_pylist(made, arrow)

    several = runs.filter("edge").select("conv_id", *names)
    return several.groupBy("conv_id").applyInArrow(join, schema)


def solved_runs(runs):
    """Every run with the role before it, its audit, and beside a last run the report."""
    found = stored(join_runs(runs), "dialogues").withColumnsRenamed(
        {"part": "of_part", "piece": "of_piece", **{n: f"joined_{n}" for n in REPORT}}
    )
    closing = F.element_at(F.array(*[F.lit(CLOSING[s]) for s in STATES]), F.col("exit") + 1)
    gaps = F.when(F.col("least").isNull(), 0).otherwise(whole_gaps())
    own = {"gaps": gaps, "cost": F.col("costs")[0], **{n: F.col(n) for n in FAULTS}}
    whole = runs.filter(~F.col("edge")).select(
        "conv_id", "part", "piece", "cells", F.lit(START).alias("entry"),
        F.col("audits")[0].alias("audit"), F.lit(True).alias("last"),
        *[own[n].cast("long").alias(n) for n in REPORT],
    )
    at = 4 * F.col("entry") + F.col("exit")
    ending = F.when(F.col("last"), closing).otherwise("")
    pieces = runs.filter("edge").join(
        found.drop("conv_id"),
        (F.col("part") == F.col("of_part")) & (F.col("piece") == F.col("of_piece")),
    ).select(
        "conv_id", "part", "piece", "cells", "entry",
        F.concat(F.get("audits", at), ending).alias("audit"), "last",
        *[F.col(f"joined_{n}").alias(n) for n in REPORT],
    )
    return whole.unionByName(pieces)


def whole_gaps():
    wide = F.col("most").cast("decimal(38,0)") - F.col("least") + 1 - F.col("turns")
    return F.least(wide, F.lit(MOST).cast("decimal(38,0)"))


def repair(rows):
    """The solved runs of all conversations, stored: input of ``reports`` and ``messages``."""
    return stored(solved_runs(find_runs(rows)), "dialogues")


def reports(solved):
    """A row per conversation: gaps, counts of faults, cost, and the audit."""
    whole = solved.groupBy("conv_id").agg(
        *[F.sum(n).alias(n) for n in REPORT],
        F.sort_array(F.collect_list(F.struct("part", "piece", "audit"))).alias("audits"),
    )
    return whole.select("conv_id", *REPORT, F.array_join("audits.audit", "").alias("audit"))


def messages(solved):
    """Messages of the repaired conversations in order, without their texts.

    ``part``, ``piece`` and ``place`` order the messages of a conversation; ``edit`` is
    K, R or I and ``role`` the role after it; ``turn``, ``old_role`` and ``key`` find
    the row it came from, and are NULL where it was inserted.
    """
    import pyarrow as pa

    kind = solved.schema["conv_id"].dataType.simpleString()
    schema = (
        f"conv_id {kind}, part int, piece int, place int, edit string, role string, "
        "turn bigint, old_role string, key binary"
    )
    arrow = pa.schema([
        ("conv_id", arrow_type(solved)), ("part", pa.int32()), ("piece", pa.int32()),
        ("place", pa.int32()), ("edit", pa.string()), ("role", pa.string()),
        ("turn", pa.int64()), ("old_role", pa.string()), ("key", pa.binary()),
    ])

    def unfold(batches):
        for batch in batches:
            made = [
                (run["conv_id"], run["part"], run["piece"], place, *message)
                for run in batch.to_pylist()
                for place, message in enumerate(run_messages(run))
            ]
            columns = list(zip(*made, strict=True)) or [[]] * len(arrow)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    narrow = solved.select("conv_id", "part", "piece", "cells", "entry", "audit")
    return narrow.mapInArrow(unfold, schema)


def run_messages(run):
    """(edit, role, turn, old role, key) of every message that a run's audit leaves."""
    state, at, audit = run["entry"], 0, run["audit"]

    def inserted():
        nonlocal state, at
        while at < len(audit) and audit[at] == "I":
            yield "I", NEXT_ROLE[state], None, None, None
            state, at = NEXT[state], at + 1

    for cell in run["cells"]:
        if cell["free"]:
            yield from inserted()
            edit, at = audit[at], at + 1
            source = cell["turn"], cell["role"], cell["key"]
            if edit == "K":
                yield "K", cell["role"], *source
                state = after_keeping(state, cell["role"][:1])
            elif edit == "R":
                yield "R", NEXT_ROLE[state], *source
                state = NEXT[state]
        rest = cell["copies"] - cell["free"]
        if rest:
            yield from inserted()
            at += rest
    yield from inserted()


def repaired_rows(rows, solved):
    """The repaired conversations: ``conv_id``, order, ``edit``, ``role`` and ``text``."""
    order = ["conv_id", "part", "piece", "place"]
    found = stored(messages(solved), "dialogues")
    texts = (
        plain_rows(rows)
        .withColumn("key", row_key(F.col("text")))
        .groupBy(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("role").alias("r"),
                 F.col("key").alias("k"))
        .agg(F.first("text").alias("text"))
    )
    same = (
        F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t"))
        & (F.col("old_role") == F.col("r")) & (F.col("key") == F.col("k"))
    )
    kept = found.filter(F.col("key").isNotNull()).join(texts, same)
    added = found.filter(F.col("key").isNull()).withColumn("text", F.lit(""))
    columns = [*order, "edit", "role", "text"]
    return kept.select(*columns).unionByName(added.select(*columns))


def text_hashes(repaired):
    """SHA-256 of each repaired conversation's ``role:text`` lines: ``conv_id``, ``sha256``.

    A hash is made in order, so a conversation's messages pass through one task, a batch
    at a time.
    """
    import pyarrow as pa

    kind = repaired.schema["conv_id"].dataType.simpleString()
    arrow = pa.schema([("conv_id", arrow_type(repaired)), ("sha256", pa.string())])

    def rows(made):
        columns = zip(*made, strict=True)
        arrays = [pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, schema=arrow)

    def digest(batches):
        current, running = None, None
        for batch in batches:
            made = []
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if running is None or conv != current:
                    if running is not None:
                        made.append((current, running.hexdigest()))
                    current, running = conv, hashlib.sha256()
                else:
                    running.update(b"\n")
                running.update(f"{role}:{text}".encode())
            if made:
                yield rows(made)
        if running is not None:
            yield rows([(current, running.hexdigest())])

    return (
        repaired.repartition("conv_id")
        .sortWithinPartitions("conv_id", "part", "piece", "place")
        .select("conv_id", "role", "text")
        .mapInArrow(digest, f"conv_id {kind}, sha256 string")
    )
