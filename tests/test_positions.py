"""Positions of whole groups of files."""

from strataline.sources import positions


def test_one_bad_file_leaves_its_group_out_and_is_named(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    put = {
        "a.csv": "y,x,counted\n1,2,True\n3,4,False\n,6,True\n", "sub/b.csv": "﻿x,y\r\n7,8\r\n", "c.csv": "x,counted\n1,1\n", "d.csv": "x,y,counted\n1,2,0\n",
        "e.csv": "x,y,z\n5,nan,9\n6,word\n", "f.csv": "", "g.txt": "x,y\n1,1\n",
    }
    for name, text in put.items():
        (tmp_path / name).write_text(text, newline="")
    listing = [("one", "a.csv"), ("one", "sub/b.csv"), ("two", "a.csv"), ("two", "c.csv"), ("three", "d.csv"), ("four", "e.csv"), ("four", "e.csv"), ("five", "none.csv"), ("five", "a.csv"), ("six", None), ("seven", "f.csv"), ("eight", "g.txt"), (None, "a.csv"), ("nine", "a.csv")]
    df = spark.createDataFrame(listing, "group string, item string")
    found, bad = positions.counted_positions(df, positions.read_tables(spark, str(tmp_path)), ["x", "y"])
    a = [("a.csv", 2.0, 1.0), ("a.csv", 6.0, None)]
    want = [("one", *r) for r in [*a, ("sub/b.csv", 7.0, 8.0)]] + [("four", "e.csv", 5.0, None), ("four", "e.csv", 6.0, None)] + [("nine", *r) for r in a] + [(None, *r) for r in a]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert {tuple(r) for r in bad.collect()} == {("two", "c.csv", "no column y"), ("three", "d.csv", "no counted position"), ("five", "none.csv", "missing"), ("six", None, "no item"), ("seven", "f.csv", "missing"), ("eight", "g.txt", "missing")}


def test_empty_tables_give_no_rows(spark):
    none = spark.createDataFrame([], "group string, item string")
    good, bad = positions.complete_groups(none, spark.createDataFrame([("a", None)], "item string, reason string"))
    assert good.count() == 0 and bad.count() == 0
