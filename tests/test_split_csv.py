"""CSV read by splits equals the file read whole, wherever the cuts fall."""

import random

import pytest

from papyrine.functions import csv_text
from papyrine.functions.errors import TextError
from papyrine.sources import split_csv


def written(rng, rows):
    out = []
    for _ in range(rows):
        fields = [rng.choice(["", "a", "b c", "é", 'q"u', "x,y", "line\nbreak", "two\n\nbreaks", '"\n"', "z" * rng.randrange(60), "\r\n"]) for _ in range(rng.randrange(1, 5))]
        out.append(",".join('"' + f.replace('"', '""') + '"' if rng.random() < 0.3 or any(c in f for c in ',"\r\n') else f for f in fields) + rng.choice(["\n", "\n", "\r\n"]))
    return "".join(out)


@pytest.fixture
def small_splits(spark):
    """A session whose splits are of a few hundred bytes."""
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", "300")
    own.conf.set("spark.sql.files.openCostInBytes", "1")
    own.conf.set("spark.sql.shuffle.partitions", "3")
    return own


def rows_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.file.rpartition("/")[2], {})[r.row_idx] = r.fields
    return {f: [rows[i] for i in sorted(rows)] for f, rows in out.items()}, {f: sorted(rows) for f, rows in out.items()}


def test_many_splits_of_several_files(small_splits, tmp_path):
    rng = random.Random(11)
    texts = {f"{i}.csv": written(rng, 120) for i in range(3)}
    texts["long.csv"] = 'a,"' + "one very long field\n" * 200 + '",b\nc,d'
    texts["bom.csv"] = "﻿x,y\n1,2\n"
    texts["open_end.csv"] = 'k\n"last ""one"""'
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    lines = small_splits.read.option("lineSep", "\n").text(str(tmp_path))
    assert lines.rdd.getNumPartitions() > 20
    got, numbers = rows_of(split_csv.read_split_csv(small_splits, str(tmp_path)))
    for name, text in texts.items():
        assert got[name] == csv_text.parse(text), name
        assert numbers[name] == list(range(len(got[name])))


def test_a_large_part_of_a_file_may_be_one_record(small_splits, tmp_path):
    text = "h\n" + '"' + 'x,""y""\n' * 400 + '"\n' + "t\n"
    (tmp_path / "a.csv").write_text(text)
    assert rows_of(split_csv.read_split_csv(small_splits, str(tmp_path)))[0]["a.csv"] == csv_text.parse(text)


def test_refused(small_splits, tmp_path):
    (tmp_path / "a.csv").write_text('a,"b\nc\n')
    with pytest.raises(Exception, match="quote|unterminated|closed"):
        split_csv.read_split_csv(small_splits, str(tmp_path)).collect()
    with pytest.raises(ValueError):
        split_csv.read_split_csv(small_splits, str(tmp_path), csv_text.Dialect(escape="\\"))
    with pytest.raises(TextError):
        csv_text.parse('a,"b\nc\n')
