"""CSV files with quoted line breaks: many tasks read what one task reads."""
import csv
import os

import pytest

from stanceflow.sources.csvlines import csv_records, read_split_csv
from stanceflow.sources.readers import read_labelled_csv


@pytest.fixture()
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def written(path, rows, encoding="utf-8", end="\n"):
    with open(path, "w", encoding=encoding, newline="") as f:
        csv.writer(f, lineterminator=end).writerows(rows)
    return path


def one_task(spark, path, encoding="UTF-8"):
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True) \
        .option("encoding", encoding).csv(path)


HEAD = [("Tweet", "Target", "Stance", "Id")]
ROWS = [(f"plain text {i}", "t", "FAVOR", i) for i in range(50)] + [
    (f'two\nlines, "quoted" {i}', "a\n\nb", "NONE", i) for i in range(200)] + [
    ("long " + "line\n" * 900, "x" * 3000, 'say ""hi""\n"', 1), ("", "empty, text", "", 2), ('"', '""', "\n", 3)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_many_tasks_equal_one(spark, tmp_dir, small_splits, end):
    path = written(f"{tmp_dir}/a.csv", HEAD + ROWS, end=end)
    assert csv_records(spark, path).select("block").distinct().count() > 4
    got, want = read_split_csv(spark, path, "UTF-8"), one_task(spark, path)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert got.count() == len(ROWS)


def test_several_files_with_headers_and_blank_lines(spark, tmp_dir, small_splits):
    os.mkdir(f"{tmp_dir}/d")
    for i in range(3):
        written(f"{tmp_dir}/d/{i}.csv", HEAD + [(f"{i} {a}", *r) for a, *r in ROWS[40:120]])
    with open(f"{tmp_dir}/d/2.csv", "a") as f:
        f.write("\n\nlast,t,s,9")
    got, want = read_split_csv(spark, f"{tmp_dir}/d", "UTF-8"), one_task(spark, f"{tmp_dir}/d")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_latin_bytes_and_labelled_reader(spark, tmp_dir, small_splits):
    rows = [("caf\u00e9 \u00fc\n\u00a3 line", "t\u00e9", "FAVOR", 4)] * 100
    path = written(f"{tmp_dir}/l.csv", HEAD + rows, "iso-8859-1")
    got = read_labelled_csv(spark, path, multiline="split")
    want = read_labelled_csv(spark, path, multiline=True)
    assert got.schema == want.schema
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert got.first()["text"] == "caf\u00e9 \u00fc\n\u00a3 line"


def test_empty_file_header_alone_and_open_quote(spark, tmp_dir):
    assert read_split_csv(spark, written(f"{tmp_dir}/h.csv", HEAD), "UTF-8").collect() == []
    with open(f"{tmp_dir}/bad.csv", "w") as f:
        f.write('a,b\n1,"open\n2,x\n')
    with pytest.raises(Exception, match="a quote is not closed"):
        read_split_csv(spark, f"{tmp_dir}/bad.csv", "UTF-8").collect()
