"""Exchange files: read in ranges at every split, written in ranges as one file."""

import csv
import io
import random

import pytest

from tabulith.sources import csv_records as cr
from tabulith.sources import long_csv

NAMES = list(long_csv.COLUMNS)


def rows_of(spark, path, split):
    """(file, values) in order, read in ranges of ``split`` bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = long_csv.read_long_csv(spark, str(path)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    return [(r._seq.file.rsplit("/", 1)[1], tuple(x or "" for x in r[1:])) for r in sorted(got, key=lambda r: tuple(r._seq))]


def written(rows, names=NAMES, eol="\n", head=True):
    out = io.StringIO()
    w = csv.writer(out, lineterminator=eol)
    if head:
        w.writerow(names)
    w.writerows(rows)
    return out.getvalue()


VALUES = ["", "a", "x,y", 'say "no"', "two\nlines", '"', '\n\n"",\n', "é\r\nz", ",", " b ", "12,5", '""\n""']


def some(n, seed, width=12):
    rnd = random.Random(seed)
    return [tuple(rnd.choice(VALUES) if rnd.random() < 0.5 else f"v{i}" for _ in range(width)) for i in range(n)]


def test_every_split(spark, tmp_path):
    """Ranges of any size, down to a few bytes, give the rows of a reader that takes the file whole."""
    rows = some(6, 1)
    (tmp_path / "a.csv").write_bytes(("﻿" + written(rows)).encode())
    want = [("a.csv", r) for r in rows]
    size = (tmp_path / "a.csv").stat().st_size
    for split in [*range(17, 60, 7), size // 3, size // 2, size - 1, size + 1]:
        assert rows_of(spark, tmp_path, split) == want, split


def test_many_files_by_name(spark, tmp_path):
    """Columns go by name, lines may end in carriage returns, and a file without a header is a part."""
    one, two, three = some(40, 2), some(30, 3), some(20, 4)
    (tmp_path / "a.csv").write_bytes(("﻿" + written(one, eol="\r\n")).encode())
    turned = [*NAMES[::-1], "extra"]
    (tmp_path / "b.csv").write_bytes(written([(*r[::-1], "z") for r in two], turned).encode())
    (tmp_path / "c.csv").write_bytes(written(three, head=False).encode() + b"\n\n")
    got = rows_of(spark, tmp_path, 300)
    assert got == [("a.csv", r) for r in one] + [("b.csv", r) for r in two] + [("c.csv", r) for r in three]


def test_long_record_over_many_ranges_is_one(spark, tmp_path):
    rows = [("1", "t", "long\n" * 3000 + '"quoted"\n' * 300, *["x"] * 9), ("2", "u", "short", *["y"] * 9)]
    (tmp_path / "a.csv").write_bytes(written(rows).encode())
    assert rows_of(spark, tmp_path, 1000) == [("a.csv", r) for r in rows]


@pytest.mark.parametrize(
    ("line", "outside", "inside"),
    [("a,b", False, True), ('"a,b', True, False), ('a"b', False, False), ('"a"b"c,d', False, False), ('""', False, True), ('"a""', True, False), ('",', True, False), ('","', False, True), ('","",', True, False), ("", False, True)],
)
def test_one_line(line, outside, inside):
    assert (cr.opens(line, False), cr.opens(line, True)) == (outside, inside)


def test_plain_quotes_inside_values(spark, tmp_path):
    """A quote within an unquoted value is text and opens nothing."""
    body = ",".join(NAMES) + '\n1,5" pipe,T,,,,,,,,,\n2,"x"y,T,,,,,,,,,\n3,"a\nb",T,,,,,,,,,\n'
    (tmp_path / "a.csv").write_text(body)
    assert [r[1][:2] for r in rows_of(spark, tmp_path, 60)] == [("1", '5" pipe'), ("2", '"x"y'), ("3", "a\nb")]


def test_ordered_parts_are_one_file(spark, tmp_path):
    """Parts in the order of their names are what one task writes, with one header and one byte order mark."""
    rows = [(f"c{i % 3}", f"{i % 7}.1", *r[2:]) for i, r in enumerate(some(400, 5))]
    df = spark.createDataFrame(rows, [long_csv.COLUMNS[c] for c in NAMES]).repartition(4)
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        long_csv.write_long_csv(df, str(tmp_path / "many"), bom=True)
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        long_csv.write_long_csv(df, str(tmp_path / "one"), bom=True)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", old)
    parts = sorted(p for p in (tmp_path / "many").iterdir() if p.suffix == ".csv")
    whole = b"".join(p.read_bytes() for p in parts)
    (single,) = [p for p in (tmp_path / "one").iterdir() if p.suffix == ".csv"]
    assert len(parts) > 2 and whole == single.read_bytes()
    assert whole.startswith("﻿bab,nomor_tabel,".encode()) and whole.count("bab,".encode()) == 1 and whole.count("﻿".encode()) == 1
    keys = [(r[1], r[4], r[3], r[7]) for r in csv.reader(io.StringIO(whole.decode("utf-8-sig"), newline=""))][1:]
    assert keys == sorted(keys) and len(keys) == len(rows)
    back = long_csv.read_long_csv(spark, str(tmp_path / "many")).collect()
    assert sorted(tuple(x or "" for x in r[1:]) for r in back) == sorted(rows)
