"""Versions are claimed: two writers never share one, and a failed write never counts."""

import pytest

from marlstone import staging
from marlstone.operators import knowledge


def frame(spark, *ids):
    return spark.createDataFrame([(i, f"t{i}") for i in ids], "id int, text string")


def ids(spark, path, version):
    return sorted(r.id for r in knowledge.load_snapshot(spark, path, version).collect())


def test_writers_take_numbers_of_their_own(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "kb")
    assert knowledge.snapshot_info(spark, path).count() == 0
    assert knowledge.save_snapshot(frame(spark, 1), path).first().version == 1
    real, stale = knowledge.next_version, [1]  # the second writer looked before the first one was done
    monkeypatch.setattr(knowledge, "next_version", lambda *a: stale.pop() if stale else real(*a))
    assert knowledge.save_snapshot(frame(spark, 2, 3), path).first().version == 2
    assert ids(spark, path, 1) == [1] and ids(spark, path, 2) == [2, 3] and not stale
    with pytest.raises(ValueError, match="already"):
        knowledge.save_snapshot(frame(spark, 9), path, 2)
    assert ids(spark, path, 2) == [2, 3]
    info = {r.version: r for r in knowledge.snapshot_info(spark, path).collect()}
    assert [(v, r.n_docs, r.is_current) for v, r in sorted(info.items())] == [(1, 1, False), (2, 2, True)]
    assert all(r.bytes > 0 and r.n_files > 0 and r.modified for r in info.values())


def test_failed_write_does_not_count(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "kb")
    knowledge.save_snapshot(frame(spark, 1), path)
    real = staging.rename_if_absent
    monkeypatch.setattr(knowledge, "rename_if_absent", lambda s, old, new: 1 / 0 if "/manifest/" in new else real(s, old, new))
    with pytest.raises(ZeroDivisionError):
        knowledge.save_snapshot(frame(spark, 2), path)
    monkeypatch.undo()
    assert knowledge.versions(spark, path) == [1] and knowledge.current_version(spark, path) == 1
    assert knowledge.save_snapshot(frame(spark, 3), path).first().version == 3  # 2 was taken
    knowledge.save_snapshot(frame(spark, 2), path, 2)  # and can be made good by its number
    assert [ids(spark, path, v) for v in knowledge.versions(spark, path)] == [[1], [2], [3]]


def test_empty_snapshot(spark, tmp_path):
    knowledge.save_snapshot(frame(spark), str(tmp_path))
    assert knowledge.load_snapshot(spark, str(tmp_path), 1).count() == 0
