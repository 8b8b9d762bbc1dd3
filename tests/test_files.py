"""Documents written and read again, also by tasks that fail once; digests of large files; arrays cut anywhere."""

from __future__ import annotations

import collections
import hashlib
import json
import os
import random
import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowbench.sources import arrays, files, readers, writers
from tests.test_matching import edges, nodes

NODE = ["dataset", "sample_id", "pos", "node_id", "x", "y", "w", "h", "label"]
EDGE = ["dataset", "sample_id", "pos", "source", "target", "direction"]


def rows(df, columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_graphs_come_back(spark, tmp_path):
    ids = ["a", "b c", "é+%20", "0001", "x.y"]
    n = nodes(spark, [(s, i, (k, 2, 3.5 if i == "1" else 4, 1e17)) for k, s in enumerate(ids) for i in ("1", 'q"\\u')]).withColumn("label", F.when(F.col("node_id") == "1", 'a "b"\n'))
    e = edges(spark, [(s, "1", 'q"\\u') for s in ids[1:]]).withColumn("direction", F.when(F.col("sample_id") == "0001", "back"))
    n, e = (t.withColumn("dataset", F.when(F.col("sample_id") == "a", "d1").otherwise("d 2")) for t in (n, e))
    n = n.withColumn("pos", F.when(F.col("node_id") == "1", 0).otherwise(1))
    e = e.withColumn("pos", F.lit(0))
    for ends in (("source", "target"), ("from", "to")):
        path = f"{tmp_path}/{ends[0]}"
        writers.write_graphs(n, e, path, ends)
        found = readers.read_graphs(spark, path)
        assert rows(found[0], NODE) == rows(n, NODE) and rows(found[1], EDGE) == rows(e, EDGE)
        assert sorted(p.name for p in Path(path, "d 2/graphs").iterdir()) == sorted(f"{i}.json" for i in ids[1:])
        one = readers.read_graphs(spark, f"{path}/d1/graphs", "d1")[0]
        assert one.count() == 2 and not Path(path, files.STAGING).exists()


def test_metadata_results_and_manifests_come_back(spark, tmp_path):
    samples = spark.createDataFrame([("d1", "test", "1"), ("d1", "test", "2"), ("d1", "train", "3"), ("d2", "all", "1")], "dataset string, split string, sample_id string")
    writers.write_dataset_meta(samples, f"{tmp_path}/meta")
    meta, splits = readers.read_dataset_meta(spark, f"{tmp_path}/meta")
    assert rows(meta, ["dataset", "name", "schema_version"]) == [("d1", "d1", "1.0"), ("d2", "d2", "1.0")]
    assert rows(splits, ["dataset", "split", "sample_id"]) == rows(samples, ["dataset", "split", "sample_id"])
    runs = spark.createDataFrame([("d", "test", p, 3, 0.5, None) for p in ("a|b", "a-b", "hf://x@1", "long" * 60)], "dataset string, split string, predictor string, num_samples int, node_f1 double, edge_f1 double")
    writers.write_results(runs, {"git_sha": F.lit("s")}, f"{tmp_path}/results")
    found, skipped = readers.read_results(spark, f"{tmp_path}/results")
    assert sorted((r.predictor, r.num_samples, r.metrics["node_f1"], r.run["git_sha"]) for r in found.collect()) == sorted((r.predictor, 3, 0.5, "s") for r in runs.collect()) and skipped.isEmpty()
    content = spark.createDataFrame([("d1", "u1", "p1", b"abc"), ("d1", "u2", "p2", b""), ("d2", "u1", "p1", b"x" * 99)], "dataset string, url string, local_path string, content binary")
    writers.write_manifest(content, "set", "1", f"{tmp_path}/manifests")
    found = readers.read_manifests(spark, f"{tmp_path}/manifests")
    assert rows(found, ["url", "sha256", "bytes", "local_path"]) == sorted(((r.url, hashlib.sha256(r.content).hexdigest(), len(r.content), r.local_path) for r in content.collect()), key=repr)


def test_names_that_no_reader_finds(spark, tmp_path):
    for name in ("../x", "/x", "a//b", ".hidden", "a/_b", "a:b", "", None):
        with pytest.raises(ValueError, match="name"):
            files.checked(name)
    given = spark.createDataFrame([("a/b", "x"), ("a/b", "y")], "path string, value string").coalesce(1)
    with pytest.raises(Exception, match="two documents"):
        files.write_documents(given, str(tmp_path / "t"))
    files.write_documents(given.limit(1), str(tmp_path / "t"))
    with pytest.raises(Exception, match="already"):
        files.write_documents(given.limit(1), str(tmp_path / "t"))
    files.write_documents(given.limit(1), str(tmp_path / "t"), "overwrite")
    assert [p.relative_to(tmp_path).as_posix() for p in tmp_path.rglob("*") if p.is_file()] == ["t/a/b"]
    files.write_documents(given.limit(0), str(tmp_path / "none"))


def test_attempts_that_do_not_count_leave_nothing(tmp_path):
    batch = pa.RecordBatch.from_pydict({"path": ["a.json", "b.json"], "value": ["1", None]})

    def broken():
        yield batch
        raise OSError("lost")

    writer = files.DocumentWriter(str(tmp_path), False)
    with pytest.raises(OSError, match="lost"):
        writer.write(broken())
    first, second = writer.write(iter([batch])), writer.write(iter([batch]))  # a speculative pair: one counts
    assert first.folder != second.folder and not list(tmp_path.glob("*.json"))
    writer.commit([second, None])
    assert sorted((p.relative_to(tmp_path).as_posix(), p.read_text()) for p in tmp_path.rglob("*") if p.is_file()) == [("a.json", "1"), ("b.json", "")]
    other = files.DocumentWriter(str(tmp_path), False)
    other.abort([other.write(iter([pa.RecordBatch.from_pydict({"path": ["c.json"], "value": ["1"]})]))])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.json", "b.json"]


RETRY = """
import sys
from pathlib import Path
from pyspark.sql import SparkSession
from flowbench.sources import files, readers, writers
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
root = sys.argv[1]

def once(batches):
    for batch in batches:
        yield batch
        mark = Path(root, "failed")
        if batch.num_rows and not mark.exists():
            mark.touch()
            raise OSError("this task fails once")

spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
n = spark.range(100).selectExpr("'d' dataset", "string(id) sample_id", "0 pos", "'n' node_id", "1d x", "2d y", "double(id) w", "4d h").repartition(3)
n = n.mapInArrow(once, n.schema)
writers.write_graphs(n, n.selectExpr("dataset", "sample_id", "pos", "node_id source", "node_id target").limit(0), f"{root}/out")
found = readers.read_graphs(spark, f"{root}/out")[0].collect()
assert Path(root, "failed").exists() and sorted(int(r.w) for r in found) == list(range(100)) == sorted(int(r.sample_id) for r in found)
assert len([p for p in Path(root, "out").rglob("*") if p.is_file() and not p.name.endswith(".crc")]) == 100
"""


def test_a_task_that_fails_once(tmp_path):
    done = subprocess.run([sys.executable, "-c", RETRY, str(tmp_path)], capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": ":".join(sys.path[:1] + [os.environ["PYTHONPATH"]])})
    assert done.returncode == 0, done.stderr[-3000:]


def odd_lists():
    rng = random.Random(6)
    word = lambda: rng.choice(["a,b", '"', "\\", "\\\\", "[{", "}]", "é🙂\u2028", "", " x "])

    def value(deep=0):
        kind = rng.randrange(6 if deep < 3 else 4)
        if kind < 4:
            return [None, rng.random(), word(), 12][kind]
        return [value(deep + 1) for _ in range(rng.randrange(4))] if kind == 4 else {word(): value(deep + 1) for _ in range(rng.randrange(3))}

    for k in range(30):
        rows = [value() for _ in range(rng.choice([0, 1, 2, 5, 40]))]
        yield f"{k}.json", rows, json.dumps(rows, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]), separators=rng.choice([None, (",", ":")]))


@pytest.mark.parametrize("size", [5, 64, 1009, 1 << 20])
def test_arrays_cut_anywhere(spark, tmp_path, size):
    want = {}
    for name, rows, text in odd_lists():
        if len(text) > 40 * size:
            continue
        (tmp_path / name).write_text(f"\n {text}\t ", encoding="utf-8")
        want[name] = rows
    for k, text in enumerate(['{"a":[1,2]}', "[1,2", "[1,2]]", '["a,]', "", "12", "[1],[2", '{"a":1},[2]']):
        (tmp_path / f"no-{k}.json").write_text(text)
    (tmp_path / "mark.json").write_text('\ufeff[ 1 , {"a" : [ ] } ]', encoding="utf-8")
    want["mark.json"] = [1, {"a": []}]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        found = collections.defaultdict(dict)
        for r in arrays.read_array_records(spark, str(tmp_path)).collect():
            found[r.path.rsplit("/", 1)[1]][r.rec_pos] = json.loads(r.record)
        some = readers.read_split_records(spark, str(tmp_path), 2).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {n: [v[k] for k in range(len(v))] for n, v in found.items()} == {n: rows for n, rows in want.items() if rows}
    assert sorted((r.path.rsplit("/", 1)[1], r.rec_pos) for r in some) == sorted((n, k) for n, rows in want.items() for k in range(min(2, len(rows))))


def test_digests_of_files_over_2_gb(spark, tmp_path):
    big, size = tmp_path / "big file.bin", (2 << 30) + 12345
    with big.open("wb") as f:
        f.write(b"start")
        f.truncate(size)
    want = hashlib.sha256(b"start")
    for k in range(5, size, 1 << 24):
        want.update(bytes(min(1 << 24, size - k)))
    (tmp_path / "small").write_bytes(b"abc")
    paths = [str(big), f"file:{tmp_path}/small", str(tmp_path / "none"), None]
    table = spark.createDataFrame([("d", f"u{k}", f"p{k}", p) for k, p in enumerate(paths)], "dataset string, url string, local_path string, path string")
    found = {r.path: (r.sha256, r.bytes) for r in files.hash_files(table).collect()}
    assert found == {paths[0]: (want.hexdigest(), size), paths[1]: (hashlib.sha256(b"abc").hexdigest(), 3), paths[2]: (None, None)}
    writers.write_manifest(table, "set", "1", f"{tmp_path}/m")
    assert sorted(r.bytes for r in readers.read_manifests(spark, f"{tmp_path}/m").collect()) == [3, size]
