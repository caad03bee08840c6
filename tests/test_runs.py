"""Results of recognition runs over a tree of folders."""

import os

from pulsegrid.sources import recognition


def test_nearest_run_and_mixed_endings(spark, tmp_path):
    def put(name, age, data=b"x"):
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(data)
        os.utime(at, (1_700_000_000 - age, 1_700_000_000 - age))

    for name, age in {
        "a/run.log": 0, "a/old.mxl": 50, "a/deep/new.mxl": 5, "a/newest.xml": 1, "a/book.omr": 9, "a/deep/er/book2.OMR": 3, "a/x-annotations-1.zip": 4, "a/plain.zip": 1,
        "a/inner/run.LOG": 0, "a/inner/score.musicxml": 70, "a/inner/sub/score.xml": 2, "a/inner/sub/book.omr": 8,
        "b/c/run.log": 0, "b/c/one.mxl": 7, "b/c/two.mxl": 7, "b/stray.xml": 6, "top.omr": 2, "none/run.log": 1,
    }.items():
        put(name, age)
    root = str(tmp_path)
    got = {(r.run.split(root, 1)[1], r.kind): r.path.split(root, 1)[1] for r in recognition.run_results(spark, root).collect()}
    assert got == {
        ("/a", "export"): "/a/deep/new.mxl", ("/a", "project"): "/a/deep/er/book2.OMR", ("/a", "annotations"): "/a/x-annotations-1.zip",
        ("/a/inner", "export"): "/a/inner/score.musicxml", ("/a/inner", "project"): "/a/inner/sub/book.omr",
        ("/b/c", "export"): "/b/c/one.mxl", ("", "export"): "/b/stray.xml", ("", "project"): "/top.omr",
    }


def test_tree_without_runs_is_one(spark, tmp_path):
    for name in ("p/q/s.xml", "p/s.musicxml", "z.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    assert [(r.kind, r.path.rsplit("/", 1)[1]) for r in recognition.run_results(spark, str(tmp_path)).collect()] == [("export", "s.musicxml")]
