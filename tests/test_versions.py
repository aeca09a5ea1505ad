"""Tables, datasets and logs that change in one step, whatever breaks off and whoever else writes."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest

from ledgerloom.plans import curate
from ledgerloom.sources import logs
from ledgerloom.sources.contracts import AUDIT, CURATED
from ledgerloom.sources.files import Files
from ledgerloom.sources.logs import JsonLog
from ledgerloom.sources.versions import Versions


def run_of(spark, n: int) -> dict:
    """Three tables of ``n`` rows that all carry ``n``."""
    frames = {}
    for name, columns in CURATED.items():
        frames[name] = spark.range(n).selectExpr(*[
            f"CAST({'current_date()' if t == 'date' else n} AS {t}) AS {c}" for c, t in columns.items()])
    return frames


def seen(spark, folder: str) -> set[int]:
    """How many rows the tables hold; one number if they are of one run."""
    return {df.count() for df in curate.read_curated(spark, folder).values()}


class Crash(Exception):
    pass


def crash_on(monkeypatch, owner, name: str, call: int, after: bool = False) -> None:
    """Break off at the given call of a method, before or after it has done its work."""
    real, calls = getattr(owner, name), [0]

    def broken(*args, **kw):
        calls[0] += 1
        if calls[0] == call and not after:
            raise Crash
        out = real(*args, **kw)
        if calls[0] == call:
            raise Crash
        return out

    monkeypatch.setattr(owner, name, broken)


@pytest.mark.parametrize("owner,name,call,after,sees", [
    (curate, "typed", 1, False, 2), (curate, "typed", 2, False, 2), (curate, "typed", 3, False, 2),
    (Versions, "commit", 1, False, 2), (Files, "write_marker", 1, True, 2), (Files, "put_new", 1, False, 2),
    (Files, "put_new", 1, True, 3), (Versions, "commit", 1, True, 3), (Versions, "vacuum", 1, False, 3),
    (Files, "remove", 2, False, 3), (Files, "remove", 3, False, 3),
])
def test_three_tables_are_always_of_one_run(spark, folder, monkeypatch, owner, name, call, after, sees):
    out = f"{folder.root}/out"
    curate.load_curated(run_of(spark, 1), out)
    curate.load_curated(run_of(spark, 2), out)
    third = run_of(spark, 3)
    crash_on(monkeypatch, owner, name, call, after)
    try:
        curate.load_curated(third, out)
    except Crash:
        pass
    monkeypatch.undo()
    assert seen(spark, out) == {sees}
    curate.load_curated(run_of(spark, 4), out)
    assert seen(spark, out) == {4}


def test_a_reader_keeps_the_run_it_began_with(spark, folder):
    out = f"{folder.root}/out"
    curate.load_curated(run_of(spark, 1), out)
    mine = curate.read_curated(spark, out)
    curate.load_curated(run_of(spark, 2), out)
    assert {df.count() for df in mine.values()} == {1} and seen(spark, out) == {2}
    curate.load_curated(run_of(spark, 3), out)
    assert len(Files(spark).names(f"{out}/versions")) == 2


def test_nothing_curated_yet(spark, folder):
    with pytest.raises(FileNotFoundError):
        curate.read_curated(spark, folder.root)


def test_one_name_has_one_writer(spark, folder):
    files, path = Files(spark), f"{folder.root}/names/x"
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: files.put_new(path, f"writer {k}"), range(16)))
    assert won.count(True) == 1 and files.read_marker(path) == f"writer {won.index(True)}"
    assert files.names(f"{folder.root}/names") == ["x"]


def test_commits_of_many_writers_are_all_numbered(spark, folder):
    versions = Versions(Files(spark), f"{folder.root}/v")
    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(lambda k: versions.commit(f"v{k}"), range(24)))
    assert sorted(numbers) == list(range(1, 25)) and versions.current()["number"] == 24


# Logs


def log_of(spark, folder, every=8, **more) -> JsonLog:
    return JsonLog(spark, f"{folder.root}/log", AUDIT, every=every, **more)


def actions(log) -> list[str]:
    return [r.action for r in log.frame().orderBy("seq").collect()]


def test_entries_in_order_over_snapshot_and_tail(spark, folder):
    log = log_of(spark, folder, grace=0)
    for k in range(30):
        log.append(action=f"a{k}", username="ann")
    assert actions(log) == [f"a{k}" for k in range(30)]
    state = log.state()
    assert state.upto >= 24 and len(state.entries) < 8
    assert len(log.files.names(f"{log.path}/entries")) <= 24  # a reader meets no file per entry of the past
    log.append_rows(spark.createDataFrame([(5, None, "bob", "bulk", None, None)], AUDIT))
    log.append_many([{"action": "x"}, {"action": "y"}])
    assert actions(log) == ["bulk", *[f"a{k}" for k in range(30)], "x", "y"]
    for k in range(300):
        log.append_many([{"action": f"b{k}"}])
    assert actions(log)[-302:] == ["x", "y", *[f"b{k}" for k in range(300)]] and len(actions(log)) == 333
    assert len(log.files.names(f"{log.path}/rows")) <= 2 * logs.FOLDERS
    assert rows_of(log.newest(2)) == ["b299", "b298"]


def rows_of(df) -> list[str]:
    return [r.action for r in df.collect()]


def test_two_writers_lose_no_entry(spark, folder):
    log_of(spark, folder).append(action="first")

    def write(name: str) -> None:
        log = log_of(spark, folder, every=4)
        for k in range(12):
            log.append(action=f"{name}{k}")

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, "abcd"))
    log = log_of(spark, folder)
    assert sorted(actions(log)) == sorted(["first", *[f"{n}{k}" for n in "abcd" for k in range(12)]])
    for name in "abcd":
        assert [a for a in actions(log) if a.startswith(name) and a != "first"] == [f"{name}{k}" for k in range(12)]
    seqs = [r.seq for r in log.frame().collect()]
    assert len(set(seqs)) >= len(seqs) - 4 * 12  # order is by commit; writers may share a stamp


def test_a_number_that_a_snapshot_holds_is_not_used_again(spark, folder):
    log = log_of(spark, folder, every=2, grace=0)
    for k in range(7):
        log.append(action=f"a{k}")
    slow = log_of(spark, folder, every=100)
    real, calls = slow._snapshot, [0]

    def stale():
        """What a writer saw before the others went on: no snapshot yet."""
        calls[0] += 1
        return (0, []) if calls[0] == 1 else real()

    slow._snapshot, slow._numbers = stale, (lambda kind, real=slow._numbers: [] if calls[0] <= 1 and kind == "entries" else real(kind))
    slow.append(action="late")
    assert actions(log_of(spark, folder)) == [*[f"a{k}" for k in range(7)], "late"]


@pytest.mark.parametrize("method,call,after", [("put_new", 1, False), ("put_new", 1, True), ("put_new", 2, False), ("put_new", 2, True), ("remove", 1, False), ("remove", 3, False)])
def test_broken_snapshots_hide_nothing(spark, folder, monkeypatch, method, call, after):
    log = log_of(spark, folder, every=100, grace=0)
    for k in range(5):
        log.append(action=f"a{k}")
        if k % 2:
            log.snapshot()
    for k in range(5, 9):
        log.append(action=f"a{k}")
    crash_on(monkeypatch, Files, method, call, after)
    try:
        log.snapshot()
        log.append(action="more")
    except Crash:
        pass
    monkeypatch.undo()
    assert actions(log)[:9] == [f"a{k}" for k in range(9)]
    log.append(action="end")
    log.snapshot()
    log.snapshot()
    assert actions(log)[:9] == [f"a{k}" for k in range(9)] and actions(log)[-1] == "end"


def test_rewriting_keeps_what_is_appended_meanwhile(spark, folder):
    log, other = log_of(spark, folder), log_of(spark, folder)
    for k in range(4):
        log.append(action=f"a{k}")
    times = []

    def change(rows):
        if not times:
            other.append(action="meanwhile")
        times.append(1)
        return rows.filter("action <> 'a1'")

    log.rewrite(change)
    assert actions(log) == ["a0", "a2", "a3", "meanwhile"] and len(times) == 2
    log.append(action="after")
    assert actions(other) == ["a0", "a2", "a3", "meanwhile", "after"]


def test_a_reader_under_way_finds_its_files(spark, folder):
    log = log_of(spark, folder, every=4)
    for k in range(6):
        log.append(action=f"a{k}")
    mine = log.frame()
    for k in range(6, 29):
        log.append(action=f"a{k}")
    assert sorted(rows_of(mine)) == [f"a{k}" for k in range(6)]
    assert log.files.names(f"{log.path}/entries")[0].endswith("01.json")
