import hashlib
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxloom.llm import dialogues, queries

FITS = re.compile(r"(s?(ua)+)?")
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SCHEMA = "conv_id long, turn long, role string, text string"


def every_repair(items):
    """(cost, audit) of every way to edit items with at most two inserts in a place."""
    found = []

    def go(place, initials, cost, audit, inserts):
        if place == len(items) and FITS.fullmatch(initials):
            found.append((cost, audit))
        if inserts < 2:
            for role in "ua":
                go(place, initials + role, cost + 5, audit + "I", inserts + 1)
        if place == len(items):
            return
        initial, truncated, copies = items[place]
        go(place + 1, initials, cost + 2 * copies, audit + "D" * copies, 0)
        if initial is not None:
            extra = cost + 5 * truncated
            go(place + 1, initials + (initial or "-"), extra, audit + "K", 0)
            for role in "ua":
                go(place + 1, initials + role, extra + 1, audit + "R", 0)

    go(0, "", 0, "", 0)
    return found


ITEM = st.one_of(
    st.tuples(st.sampled_from(["s", "u", "a", "a", "u", "t", ""]), st.booleans(), st.just(1)),
    st.tuples(st.none(), st.just(False), st.integers(1, 3)),
)


@settings(max_examples=60, deadline=None)
@given(st.lists(ITEM, max_size=3))
def test_search_equals_trying_everything(items):
    assert dialogues.search(tuple(items), 0, True)[0] == min(every_repair(items))


def by_suffixes(items):
    """The best repair by the best ends of every place and last role."""

    @lru_cache(maxsize=None)
    def best(place, state, inserted):
        found = []
        if place == len(items) and state in "-a":
            found.append((0, ""))
        role = "a" if state == "u" else "u"
        if inserted < 2:
            cost, audit = best(place, role, inserted + 1)
            found.append((cost + 5, "I" + audit))
        if place < len(items):
            initial, truncated, copies = items[place]
            cost, audit = best(place + 1, state, 0)
            found.append((cost + 2 * copies, "D" * copies + audit))
            if initial is not None:
                cost, audit = best(place + 1, role, 0)
                found.append((cost + 1 + 5 * truncated, "R" + audit))
                if initial == role or (initial == "s" and state == "-"):
                    cost, audit = best(place + 1, initial, 0)
                    found.append((cost + 5 * truncated, "K" + audit))
        return min(found, default=(10**9, ""))

    return best(0, "-", 0)


@settings(max_examples=150, deadline=None)
@given(st.lists(ITEM, max_size=40), st.sampled_from([1, 2, 3, 7, 64]), st.integers(1, 9))
def test_segments_and_runs_join_exactly(items, segment, run):
    before = dialogues.SEGMENT_ROWS
    dialogues.SEGMENT_ROWS = segment
    try:
        want = by_suffixes(items)
        assert dialogues.whole_run(items) == want
        runs = [items[start : start + run] for start in range(0, len(items), run)]
        solved = [dialogues.solve_items(part, True) for part in runs]
        cost, way = dialogues.chosen_path([s["costs"] for s in solved], [s["ranks"] for s in solved])
        audit = "".join(
            s["audits"][4 * a + b] for s, a, b in zip(solved, way, way[1:], strict=False)
        ) + dialogues.CLOSING[way[-1]]
        assert (cost, audit) == want
    finally:
        dialogues.SEGMENT_ROWS = before


@settings(max_examples=100, deadline=None)
@given(st.lists(ITEM, max_size=30))
def test_bounds_are_bounds(items):
    bounds = dialogues.lower_bounds(items)
    for place in range(len(items) + 1):
        least = min(
            cost for entry in dialogues.STATES
            for cost, _ in dialogues.search(tuple(items[place:]), entry, False).values()
        )
        assert bounds[place] <= least


def test_long_conversations_are_searched_quickly():
    items = [("ua"[n % 2], False, 1) for n in range(20_000)]
    items[5000:5003] = [("s", True, 1), (None, False, 3), ("t", False, 1)]
    assert dialogues.whole_run(items) == by_parts(items)


def by_parts(items):
    # Far from the change nothing but keeping is cheapest.
    cost, audit = by_suffixes(items[4990:5014])
    return cost, "K" * 4990 + audit + "K" * (len(items) - 5014)


def damaged(rows):
    """The rows after damage, one conversation a list, in the order of turns."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        kept = groups[conv]
        role, text = role if role is not None else " ", text if text is not None else " "
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        if fault == 0:
            continue
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fault, text)
        kept += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)

    def order(row):
        return row[0] is not None, row[0] or 0, row[1], hashlib.sha256(row[2].encode()).digest()

    return {conv: sorted(kept, key=order) for conv, kept in groups.items()}


def expected(rows):
    for conv, kept in damaged(rows).items():
        turns = [row[0] for row in kept if row[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, items, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in kept:
            bare = text.strip(SPACES)
            fault = (
                "blank" if not bare
                else "duplicate" if (role, text) in seen
                else "truncated" if bare[-1] not in ".!?" else None
            )
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            gone = fault in ("blank", "duplicate")
            items.append((None if gone else role[:1], fault == "truncated", 1))
        initials = [role[:1] for _, role, _ in kept]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit = by_suffixes(items)
        state, lines, left = "-", [], iter(kept)
        for edit in audit:
            _, role, text = next(left) if edit != "I" else (None, None, "")
            if edit == "D":
                continue
            if edit != "K":
                role = "assistant" if state == "u" else "user"
            state = role[0]
            lines.append(f"{role}:{text}")
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        yield conv, gaps, *faults.values(), illegal, cost, audit, digest


COLUMNS = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def rows_of(frame):
    return sorted((tuple(row) for row in frame.select(*COLUMNS).collect()), key=str)


@pytest.mark.parametrize("run, segment, parts", [(8192, 64, 4), (3, 2, 7)])
def test_query_over_given_conversations(spark, monkeypatch, run, segment, parts):
    monkeypatch.setattr(dialogues, "RUN_ROWS", run)
    monkeypatch.setattr(dialogues, "SEGMENT_ROWS", segment)
    monkeypatch.setattr(dialogues, "CELLS_AT_ONCE", 10)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sf_dir = "/root/testdata/sf0.01"
        got = rows_of(queries.op12_conversations(spark, sf_dir))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    names = ["conv_id", "turn", "role", "text"]
    assert got == sorted(expected([tuple(r) for r in given.select(*names).collect()]), key=str)


ODD = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Hello"),
    (1, 2, "assistant", "Hello"), (1, 5, "user", "Hi!"), (1, None, None, "x."), (1, None, "user", None),
    (None, 1, "user", "a."), (None, 2, "assistant", "b."), (None, None, None, None),
    (2, 7, "", "x."), (2, 8, "tool", "y."), (2, 9, "User", "z."), (3, None, "user", " \t\n"),
    (4, -(2**63), "user", "a."), (4, 2**63 - 1, "assistant", "é 　"),
    *[(5, n % 3, "user", f"Same {n % 2}.") for n in range(200)],
    *[(6, n, ["user", "assistant"][n % 2], "long " * 20_000 + f"{n}.") for n in range(4)],
    *[(conv, 0, "user", "Hi.") for conv in range(100, 160)],
]


def odd_table(spark, tmp_path, rows, extra=True):
    names = ["rows", "key", "part", "copies", "c"]
    frame = spark.createDataFrame(
        [(*row, *names) for row in rows], SCHEMA + "".join(f", {n} string" for n in names)
    )
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    return str(tmp_path)


def test_odd_rows(spark, tmp_path):
    given = ODD[:14] + ODD[16:]
    got = rows_of(queries.op12_conversations(spark, odd_table(spark, tmp_path, given)))
    assert got == sorted(expected(given), key=str)


def test_turns_far_apart(spark):
    rows = spark.createDataFrame(ODD[14:16], SCHEMA)
    report = dialogues.reports(dialogues.repair(rows)).collect()
    assert [(r.conv_id, r.gaps) for r in report] == [(4, 2**63 - 1)]


def test_nothing_left_and_empty_tables(spark, tmp_path):
    dropped = [(c, t, "user", "x.") for c in range(60) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    assert dropped
    got = rows_of(queries.op12_conversations(spark, odd_table(spark, tmp_path / "a", dropped)))
    nothing = hashlib.sha256(b"").hexdigest()
    assert got == sorted({(c, 0, 0, 0, 0, 0, 0, "", nothing) for c, *_ in dropped}, key=str)
    assert rows_of(queries.op12_conversations(spark, odd_table(spark, tmp_path / "b", []))) == []


def test_repaired_messages(spark):
    rows = spark.createDataFrame(
        [(1, 0, "assistant", "Hi."), (1, 1, "user", "What"), (1, 2, "assistant", "So."), (1, 3, "user", "Bye.")],
        SCHEMA,
    )
    solved = dialogues.repair(rows)
    order = ["conv_id", "part", "piece", "place"]
    made = dialogues.repaired_rows(rows, solved).orderBy(*order).collect()
    audit = dialogues.reports(solved).first().audit
    assert audit == by_suffixes([("a", 0, 1), ("u", 1, 1), ("a", 0, 1), ("u", 0, 1)])[1]
    assert "".join(row.edit for row in made) == audit.replace("D", "")
    assert FITS.fullmatch("".join(row.role[0] for row in made))
    texts = {0: "Hi.", 1: "What", 2: "So.", 3: "Bye."}
    kept = [texts[n] for n, e in enumerate(audit.replace("I", "")) if e != "D"]
    assert [row.text for row in made if row.edit != "I"] == kept
