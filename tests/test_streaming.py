from tabulith.plans import ingest
from tabulith.sources.long_csv import COLUMNS
from tabulith.streaming import load as sl

HEAD = ",".join(COLUMNS)


def test_files_are_merged_once(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.csv").write_text(f"{HEAD}\nBab,1.1.1,T,Salopa,,Luas,ha,2024,1,1,ada,BPS\nBab,1.1.1,T,Cipatujah,,Luas,ha,2024,2,2,ada,BPS\n")

    def run():
        q = sl.stream_long_rows(spark, str(source), str(target), "P", 2024).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return q.lastProgress["batchId"] if q.lastProgress else None

    run()
    (source / "b.csv").write_text(f"{HEAD}\nBab,1.1.1,T,Salopa,,Luas,ha,2024,9,9,ada,BPS\n")
    run()
    star = sl.read_star(spark, str(target), 1)
    assert {(f.region, int(f.value_num)) for f in star["fact"].collect()} == {("Salopa", 9), ("Cipatujah", 2)}
    assert set(star) == set(ingest.SCHEMAS)


def test_other_buckets_stay(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()

    def add(name, tables, value):
        (source / name).write_text("\n".join([HEAD, *[f"Bab,{t},T,Salopa,,Luas,ha,2024,{value},{value},ada,BPS" for t in tables]]) + "\n")
        q = sl.stream_long_rows(spark, str(source), str(target), "P", 2024).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(180)

    add("a.csv", [f"1.{k}" for k in range(1, 30)], 1)
    add("b.csv", ["1.7"], 5)
    folders = sl._folders(spark, str(target), 1)
    touched = {k for k, f in folders.items() if f.startswith("v1/fact/")}
    assert len(touched) == 1 and len({k for k in folders if k[0] == "fact"}) > 10
    assert {f.table_no: int(f.value_num) for f in sl.read_star(spark, str(target), 1)["fact"].collect()} == {f"1.{k}": 5 if k == 7 else 1 for k in range(1, 30)}
    assert sl.read_star(spark, str(target), 0)["fact"].where("value_num = 5").count() == 0
