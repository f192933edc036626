import uuid

import pytest
from helpers import rows

from logquarry.sources import ledger as L
from logquarry.sources.store import LogStore

LINE = "2031-03-04 10:00:0{} [INFO] night_job (load.py:{}): step {}\n"


@pytest.fixture
def store(spark, tmp_path):
    return LogStore(spark, str(tmp_path / "store"), "logs_" + uuid.uuid4().hex)


@pytest.fixture
def folder(tmp_path):
    folder = tmp_path / "in put"
    folder.mkdir()
    (folder / "a 1.log").write_text("".join(LINE.format(i, i, i) for i in range(3)) + "more of it\n")
    (folder / "b[x].log").write_text(LINE.format(5, 50, 5))
    return folder


def lines(store):
    return sorted(rows(store.df(), "_rowid", "line_number"))


ALL = [(0, 0), (1, 1), (2, 2), (3, 50)]


def test_a_second_load_adds_nothing(store, folder):
    assert (L.reload_logs(store, str(folder)), L.reload_logs(store, str(folder))) == (4, 0)
    assert lines(store) == ALL
    (folder / "c.log").write_text(LINE.format(7, 70, 7))
    (folder / "empty.log").write_text("")
    assert (L.reload_logs(store, str(folder)), L.reload_logs(store, str(folder))) == (1, 0)
    assert lines(store) == [*ALL, (4, 70)]


def test_a_touched_file_is_known_by_its_lines(store, folder):
    L.reload_logs(store, str(folder))
    text = (folder / "b[x].log").read_text()
    (folder / "b[x].log").unlink()
    (folder / "b[x].log").write_text(text)
    assert L.reload_logs(store, str(folder)) == 0 and lines(store) == ALL


def test_a_changed_file_is_refused(store, folder):
    L.reload_logs(store, str(folder))
    (folder / "b[x].log").write_text(LINE.format(6, 60, 6) * 2)
    with pytest.raises(ValueError, match="other contents"):
        L.reload_logs(store, str(folder))
    assert lines(store) == ALL


@pytest.mark.parametrize("stored", [True, False])
def test_a_load_that_broke_off_is_undone(store, folder, monkeypatch, stored):
    L.reload_logs(store, str(folder / "a 1.log"))
    insert = LogStore.insert

    def lost(self, *args, **options):
        if stored:
            insert(self, *args, **options)
        raise OSError("lost driver")

    monkeypatch.setattr(LogStore, "insert", lost)
    with pytest.raises(OSError):
        L.reload_logs(store, str(folder))
    monkeypatch.undo()
    assert L.reload_logs(store, str(folder)) == 1 and lines(store) == ALL


def test_an_overwrite_empties_the_ledger(spark, store, folder):
    L.reload_logs(store, str(folder))
    store.insert(store.df().limit(0).drop("event_date", "_rowid"), mode="overwrite")
    assert L.reload_logs(store, str(folder)) == 4


def test_opening_during_an_overwrite(spark, store, folder, monkeypatch):
    """Another store opened when the new rows are staged sees the old ones, and the writer goes on."""
    L.reload_logs(store, str(folder))
    commit, seen = LogStore._commit, []

    def opened(self, *args):
        monkeypatch.undo()
        seen.append(lines(LogStore(spark, store.path.rsplit("/", 1)[0], store.table)))
        commit(self, *args)

    monkeypatch.setattr(LogStore, "_commit", opened)
    new = spark.createDataFrame([("2031-03-04 10:00:00", 9)], "timestamp string, line_number long")
    store.insert(new, mode="overwrite")
    assert seen == [ALL] and lines(LogStore(spark, store.path.rsplit("/", 1)[0], store.table)) == [(0, 9)]


def test_an_overwrite_that_broke_off_keeps_rows_and_ledger(spark, store, folder, monkeypatch):
    L.reload_logs(store, str(folder))
    monkeypatch.setattr(LogStore, "_create", lambda *a: (_ for _ in ()).throw(OSError("lost driver")))
    with pytest.raises(OSError):
        store.insert(spark.createDataFrame([("2031-03-04 10:00:00", 9)], "timestamp string, line_number long"), mode="overwrite")
    monkeypatch.undo()
    assert lines(LogStore(spark, store.path.rsplit("/", 1)[0], store.table)) == ALL
    assert L.reload_logs(store, str(folder)) == 0 and lines(store) == ALL
