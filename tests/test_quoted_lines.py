"""Records over several lines, against the plain reader, with blocks cut anywhere."""

import csv
import random

import pytest

from pitwise.sources import lines

WORDS = ["a", "", " b ", "c,d", 'say ""x""', "line\nbreak", "\r\nedge\n", '""', "k", "Köln", ",", "\xa0nb "]


def _plain(text):
    """Rows as a reader of a whole file would give them, empty ones left out."""
    rows = list(csv.reader(text.splitlines()))
    head = [n.strip() for n in rows[0]]
    out = []
    for row in rows[1:]:
        if any(v.strip() for v in row):
            row = [v.strip() for v in row] + [""] * len(head)
            out.append({n: v for n, v in zip(head, row) if n})
    return out


def _got(spark, root):
    _, rows = lines.scan_files(spark, str(root))
    found = {}
    for r in rows.select("path", "fields").collect():
        found.setdefault(r["path"].rsplit("/", 1)[1], []).append(dict(r["fields"]))
    return found


def _same(spark, root, files):
    got = _got(spark, root)
    for name, text in files.items():
        want = _plain(text)
        key = lambda row: sorted(row.items())
        assert sorted(got.get(name, []), key=key) == sorted(want, key=key), name


def _field(rng):
    word = rng.choice(WORDS)
    if '"' in word or "," in word or "\n" in word:
        return f'"{word}"' + rng.choice(["", "", "", " tail"])
    return rng.choice([word, f'"{word}"', word + ' 5" pipe' if rng.random() < 0.1 else word])


@pytest.mark.parametrize("block", [64, 200, 10_000])
def test_quoted_line_ends_with_blocks_cut_anywhere(spark, tmp_path, block):
    rng = random.Random(block)
    files = {}
    for k in range(12):
        body = [",".join(_field(rng) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 60))]
        head = "Name,Team,,Note" if k % 3 else '"Na\nme","Team, two",Note'
        files[f"f{k}.csv"] = head + "\n" + rng.choice(["\n", "\r\n"]).join(body) + rng.choice(["", "\n"])
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.openCostInBytes", "16")
    try:
        _same(spark, tmp_path, files)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_break_at_every_offset(spark, tmp_path):
    text = 'one,"two, ""three"" four",five\n'
    files = {}
    for k in range(len(text)):
        row = text[:k] + '"x\ny"' + text[k:]
        files[f"f{k}.csv"] = "A,B,C\n1,2,3\n" + row + "4,5,6\n"
    for name, body in files.items():
        (tmp_path / name).write_bytes(body.encode())
    _same(spark, tmp_path, files)


def test_an_endless_quote_refuses_its_file_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lines, "RECORD_LIMIT", 500)
    (tmp_path / "good.csv").write_text('A,B\n1,"x\ny"\n')
    (tmp_path / "bad.csv").write_text('A,B\n1,"x\n' + "more,and more\n" * 200)
    (tmp_path / "head.csv").write_text('A,"B\n' + "more,and more\n" * 200)
    (tmp_path / "short.csv").write_text('A,B\n1,"left open\nhere')
    files, rows = lines.scan_files(spark, str(tmp_path))
    why = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in lines.unusable(files).collect()}
    assert why == {"bad.csv": lines.OPEN_QUOTE, "head.csv": lines.OPEN_QUOTE}
    got = sorted(dict(r["fields"])["B"] for r in rows.collect())
    assert got == ["left openhere", "xy"]


def test_fields_are_worked_out_once_under_filters(spark, tmp_path, capsys):
    (tmp_path / "a.csv").write_text('Div,Name\nE0," x, y "\nE1,z\n,w\n')
    _, rows = lines.scan_files(spark, str(tmp_path))
    kept = rows.filter(lines.field("Div").isin("", "E0") & (lines.field("Name") != "q"))
    assert sorted(r["fields"]["Name"] for r in kept.collect()) == ["w", "x, y"]
    capsys.readouterr()
    kept.explain(extended=True)
    plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert plan.count("map_from_entries(") == 1
