"""Counts kept up from changes equal counts learned anew, and only changed files are read."""

import random

from codewarden.operators import learn
from codewarden.sources import storage
from codewarden.sources.file_table import FileTable
from codewarden.sources.learned_counts import LearnedCounts

FOLDERS = ["src", "src/ui", "lib", "test"]


def code(draw, k):
    lines = [draw.choice(["const fooBar = 1", "let foo_bar = 2", "function doIt() {}", "import x from './y'", "import z from 'lodash'",
                          "// note", "/** doc */", "export default q", "export const MAX_N = 3"]) for _ in range(draw.randrange(8))]
    return (f"{draw.choice(FOLDERS)}/f{k}{draw.choice(['', '.test', '.spec'])}.js", "\n".join(lines))


def rows_of(df):
    return sorted(tuple(r) for r in df.select("section", "field", "key", "n").collect())


def test_changes_are_counted_in_and_out(spark, tmp_path, monkeypatch):
    draw = random.Random(9)
    files = dict(code(draw, k) for k in range(400))
    frame = lambda rows: spark.createDataFrame(list(rows), "path string, content string")
    table = FileTable.create(frame(files.items()), str(tmp_path / "files"), 128)
    state = LearnedCounts(str(tmp_path / "counts"))
    state.add(frame(files.items()), 0)
    read = []
    plain = FileTable._read
    monkeypatch.setattr(FileTable, "_read", lambda self, s, f: read.append(f) or plain(self, s, f))
    for version in (1, 2, 3):
        paths = draw.sample(sorted(files), 3)
        changed = [(paths[0], code(draw, 0)[1]), (paths[1], None), code(draw, 1000 + version), (paths[2], "let snake_case = 1")]
        for _ in range(2):
            # a repeated update changes nothing
            state.follow(table, frame(changed), version)
        files.update(changed)
        files = {p: c for p, c in files.items() if c is not None}
        assert rows_of(state.counts(spark)) == rows_of(learn.pattern_counts(frame(files.items())))
        if version == 2:
            state.compact(spark)
            assert storage.children(spark, state.root) == ["upto=2"]
    assert read and all(len(f) <= 4 for f in read)
    assert state.profile(spark).first() == learn.learn(frame(files.items())).first()
    assert sorted((r.path, r.content) for r in table.all(spark).collect()) == sorted(files.items())


def test_nothing_learned_yet(spark, tmp_path):
    state = LearnedCounts(str(tmp_path / "none"))
    state.compact(spark)
    assert state.counts(spark).collect() == []
    assert state.profile(spark).first().confidence == "low"
