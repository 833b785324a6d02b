"""What stands beside a table: taken ids, finished batches, a change under way.

A ledger is a folder of small numbered JSON files, each the whole state. A change
writes the next number, which only one writer can do; who comes second reads the
new state and tries again. Old numbers are removed, so the folder stays small
however long a table lives. Finished batches are one marker file a name, found
by its path and never listed.

Moving a file into place must be atomic, as it is on HDFS; on a store that
cannot do so, let one writer at a time change a table.
"""

import json
import uuid
from urllib.parse import quote

from pyspark.sql import functions as F

from voxloom.session import file_system, path_exists

#: State files that are kept for readers that still hold an older listing.
KEPT = 8
ATTEMPTS = 100


class Conflict(RuntimeError):
    """Somebody else made the next change first."""


def ledger_path(table_path):
    return f"{table_path.rstrip('/')}.ledger"


def versions(spark, path):
    """The numbers of the state files, ascending."""
    system, folder = file_system(spark, path)
    if not system.exists(folder):
        return []
    names = [status.getPath().getName() for status in system.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def state_file(path, version):
    return f"{path}/{version:012d}.json"


def read_json(spark, path):
    system, file = file_system(spark, path)
    stream = system.open(file)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def write_new(spark, path, value):
    """Write a JSON file that must not be there yet, whole or not at all."""
    folder = path.rsplit("/", 1)[0]
    system, unfinished = file_system(spark, f"{folder}/.{uuid.uuid4().hex}")
    system.mkdirs(unfinished.getParent())
    stream = system.create(unfinished, True)
    stream.write(json.dumps(value, sort_keys=True).encode())
    stream.close()
    _, target = file_system(spark, path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
    kinds = getattr(hadoop, "Options$Rename")
    # Without an option a rename never replaces a file.
    options = spark.sparkContext._gateway.new_array(kinds, 0)
    try:
        files.rename(system.makeQualified(unfinished), system.makeQualified(target), options)
    except Exception as error:
        system.delete(unfinished, False)
        if system.exists(target):
            raise Conflict(path) from error
        raise


def read_state(spark, path):
    """(number, state) of a ledger; (0, {}) of one that is not there yet."""
    numbers = versions(spark, path)
    if not numbers:
        return 0, {}
    return numbers[-1], read_json(spark, state_file(path, numbers[-1]))


def change_state(spark, path, change):
    """Replace the state by ``change(state)`` and give it back; None leaves it as it is."""
    for _ in range(ATTEMPTS):
        number, state = read_state(spark, path)
        changed = change(json.loads(json.dumps(state)))
        if changed is None:
            return state
        try:
            write_new(spark, state_file(path, number + 1), changed)
        except Conflict:
            continue
        system, _ = file_system(spark, path)
        for old in versions(spark, path):
            if old <= number + 1 - KEPT:
                system.delete(file_system(spark, state_file(path, old))[1], False)
        return changed
    raise Conflict(f"{path}: {ATTEMPTS} attempts met other writers")


def claim_ids(spark, path, owner, batch, count, after=lambda: 0):
    """The first of ``count`` ids that no other batch gets.

    An ``owner`` (a stream's run, say) claims for its batches in ascending order; its
    newest batch gets the same ids again when it asks again. ``after`` tells the
    largest id of rows from before there was a ledger; it is asked once.
    """

    def change(state):
        claims = state.setdefault("claims", {})
        held = claims.get(owner)
        if held and held["batch"] == batch and held["count"] == count:
            return None
        if held and held["batch"] >= batch:
            raise ValueError(f"batch {batch} of {owner} has changed since it got its ids")
        first = state["next"] if "next" in state else after() + 1
        claims[owner] = {"batch": batch, "first": first, "count": count}
        state["next"] = first + count
        return state

    return change_state(spark, path, change)["claims"][owner]["first"]


def release_claim(spark, path, owner):
    """Forget the claim of an owner that asks no more; its ids stay taken."""

    def change(state):
        return state if state.get("claims", {}).pop(owner, None) else None

    change_state(spark, path, change)


def folder_name(name):
    """A batch name as part of a path."""
    return quote(name, safe="")


def marker(table_path, name):
    return f"{ledger_path(table_path)}/done/{folder_name(name)}.json"


def finished_batch(spark, table_path, name):
    """What was noted of a finished batch; None if it is not finished."""
    path = marker(table_path, name)
    return read_json(spark, path) if path_exists(spark, path) else None


def finish_batch(spark, table_path, name, **notes):
    """Note that a batch is in the table; the first note stands."""
    try:
        write_new(spark, marker(table_path, name), notes)
    except Conflict:
        pass
    return finished_batch(spark, table_path, name)


def largest_id(table):
    """The largest id of a table, 0 if there is none."""
    return table.agg(F.max("id")).first()[0] or 0
