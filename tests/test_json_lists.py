"""Large JSON list files: any cut of a file gives the records that a parser gives."""
import json
import os
import random

import pytest

from relmon.sources.json_lists import read_json_lists


def value(rnd, depth=0):
    kind = rnd.randrange(9) if depth < 4 else rnd.randrange(5)
    if kind < 5:
        return [None, -1.5, "plain", 'br{ace}s ] [ , "quoted" and \\ back\\\\slash\\"', "é\U0001f600\n\t}"][kind]
    if kind < 8:
        return {rnd.choice(["a", "b}", '"c"', "d\\"]): value(rnd, depth + 1) for _ in range(rnd.randrange(4))}
    return [value(rnd, depth + 1) for _ in range(rnd.randrange(4))]


def some(seed, n):
    rnd = random.Random(seed)
    return [{"id": i, "v": value(rnd), "w": value(rnd)} for i in range(n)]


def write(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
        f.write(text)


@pytest.fixture()
def splits(spark):
    """Byte ranges of so many bytes."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {k: spark.conf.get(k, None) for k in keys}

    def to(n):
        spark.conf.set(keys[0], str(n))
        spark.conf.set(keys[1], "0")
        spark.conf.set(keys[2], "1")
    yield to
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def read(spark, folder):
    rows = read_json_lists(spark, folder).orderBy("source_file", "record_index").collect()
    return [(os.path.basename(r.source_file), r.record_index, r.raw, r.parse_error) for r in rows]


@pytest.mark.parametrize("size", [60, 900, 1 << 27])
def test_every_cut_gives_the_records(spark, tmpdir_path, splits, size):
    splits(size)
    n = 40 if size < 100 else 120
    write(tmpdir_path, "a.json", json.dumps(some(1, n)))
    write(tmpdir_path, "b.json", " \n" + json.dumps(some(2, n), indent=2, ensure_ascii=False) + "\n\n")
    write(tmpdir_path, "c.json", "[\n" + " ,\n".join(json.dumps(x) for x in some(3, n)) + "\n]")
    got = read(spark, tmpdir_path)
    for name, seed in (("a.json", 1), ("b.json", 2), ("c.json", 3)):
        own = [g for g in got if g[0] == name]
        assert [g[1] for g in own] == list(range(n)) and not any(g[3] for g in own)
        assert [json.loads(g[2]) for g in own] == some(seed, n)


def test_objects_lines_and_empty_files(spark, tmpdir_path, splits):
    splits(50)
    write(tmpdir_path, "a.json", json.dumps(some(4, 1)[0]))
    write(tmpdir_path, "b.json", "\n".join(json.dumps(x) for x in some(5, 9)))
    write(tmpdir_path, "c.json", "")
    write(tmpdir_path, "d.json", " [ ] \n")
    write(tmpdir_path, "e.json", json.dumps(some(6, 5))[:-20])              # cut within the last record
    write(tmpdir_path, "f.json", '[1, "x", {"id": 1}, {"id": 2}]')         # elements that are no objects
    write(tmpdir_path, "g.txt", "[{}]")
    got = read(spark, tmpdir_path)
    by = {n: [(i, raw, bad) for f, i, raw, bad in got if f == n] for n in ("a.json", "b.json", "c.json", "d.json", "e.json", "f.json", "g.txt")}
    assert [json.loads(r) for _, r, _ in by["a.json"]] == some(4, 1)
    assert [json.loads(r) for _, r, _ in by["b.json"]] == some(5, 9)
    assert by["c.json"] == by["d.json"] == by["g.txt"] == []
    assert [bad for _, _, bad in by["e.json"]] == [False] * 4 + [True]
    assert [bad for _, _, bad in by["f.json"]] == [True, False] and json.loads(by["f.json"][1][1]) == {"id": 2}
    assert read_json_lists(spark, tmpdir_path + "/none").collect() == []
    plan = read_json_lists(spark, tmpdir_path)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_one_file_is_read_by_many_tasks(spark, tmpdir_path, splits):
    splits(2000)
    write(tmpdir_path, "a.json", json.dumps(some(7, 300)))
    from pyspark.sql import functions as F
    seg = spark.read.option("lineSep", "}").text(tmpdir_path)
    assert seg.select(F.spark_partition_id().alias("p")).distinct().count() > 10
    assert len(read(spark, tmpdir_path)) == 300
