"""Known answers of the other operators."""

from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from flowbench.functions import text
from flowbench.functions.canonical import canonical_json
from flowbench.operators import contours, convert, generate, graphs, manifest, predictors, samples, training, validate
from flowbench.operators.evaluate import run_benchmark
from flowbench.operators.pairs import FEATURES, pair_features
from flowbench.operators.results import LEADERBOARD, leaderboard
from flowbench.sources import readers, writers
from tests.test_matching import edges, nodes


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.o for r in df.select("k", expression(F.col("v")).alias("o")).orderBy("k").collect()]


def test_identifiers(spark):
    given = ["Step_1_Load_Data", "Step 2 - Train Model", "1Bad", " ", None, "a#b  c"]
    assert column(spark, given, lambda c: text.to_identifier(c, F.lit("node_7"))) == ["Step_1_Load_Data", "Step_2_Train_Model", "_1Bad", "node_7", "node_7", "ab_c"]


def test_white_space_of_every_kind_goes(spark):
    given = ["\t Start", "\n\x1c1Bad\u00a0", "\u3000 \x85", "a\tb "]
    assert column(spark, given, lambda c: text.to_identifier(c, F.lit("node_7"))) == ["Start", "_1Bad", "node_7", "ab"]


def test_bytes(spark):
    assert column(spark, [0, 1023, 1024, 1536, 1 << 50, -1, None], text.format_bytes, "long") == ["0 B", "1023 B", "1.00 KiB", "1.50 KiB", "1.00 PiB", "unknown size", "unknown size"]


def test_mermaid_does_not_overlap(spark):
    found = column(spark, ["entity0 --> entity1 --> entity2 ==> entity3", "entity07-->entity8", ""], text.parse_mermaid_edges)
    assert [[(p.u, p.v) for p in x] for x in found] == [[(0, 1), (2, 3)], [(7, 8)], []]


def test_canonical(spark):
    given = ['{"b":1,"a":[{"id":2},{"id":"10","x":[3,1]}]}', "nope", None]
    assert column(spark, given, canonical_json) == ['{"a":[{"id":"10","x":[3,1]},{"id":2}],"b":1}', None, None]


def test_canonical_lists_of_free_form(spark):
    given = ['[{"id":"z"},{"node_id":"a"}]', '[{"k":"a b"},{"k":"a"}]', '[{"x":2},{"label":"q","x":1},{"id":null}]', "[]", '[1,{"b":1,"a":[{"id":2},{"id":1}]}]', '[{"id":{"b":1,"a":2}},{"id":"a"}]']
    assert column(spark, given, canonical_json) == [
        '[{"node_id":"a"},{"id":"z"}]', '[{"k":"a"},{"k":"a b"}]', '[{"id":null},{"label":"q","x":1},{"x":2}]', "[]", '[1,{"a":[{"id":1},{"id":2}],"b":1}]', '[{"id":"a"},{"id":{"a":2,"b":1}}]',
    ]


def test_heuristic(spark):
    n = nodes(spark, [("s", "n1", (0, 0, 10, 10)), ("s", "n2", (0, 20, 10, 10)), ("s", "n3", (0, 40, 10, 10))])
    assert {(r.source, r.target) for r in predictors.predict_heuristic(n)[1].collect()} == {("n1", "n3")}


def test_pair_features(spark):
    n = nodes(spark, [("s", "u", (10, 10, 40, 20)), ("s", "v", (100, 10, 40, 20)), ("s", "w", (10, 100, 40, 20))])
    size = spark.createDataFrame([("d", "s", 400, 300)], "dataset string, sample_id string, width int, height int")
    rows = {(r.src, r.dst): r for r in pair_features(n, size).collect()}
    assert len(rows) == 6 and rows["u", "v"].is_right_of == 1 and rows["u", "v"].is_left_of == 0 and rows["u", "w"].is_below == 1 and rows["u", "w"].is_above == 0
    assert rows["u", "v"].dx_norm == pytest.approx(90 / 400) and rows["u", "v"].is_nearest_right_neighbor == 1 and rows["w", "v"].rank_by_distance_norm == 1


def test_naive_and_python_predictor(spark):
    size = spark.createDataFrame([("d", "s", 400, 300), ("d", "t", 100, 40)], "dataset string, sample_id string, width int, height int")
    assert sorted((r.x, r.y) for r in predictors.predict_naive(size)[0].collect()) == [(0, 0), (140, 122)]
    own = predictors.python_predictor(lambda s: {"nodes": [{"id": 1, "bbox": [0, 0, s["width"], 1]}], "edges": [{"source": 1, "target": 1}]}, size, "mine")
    assert sorted(r.w for r in own[0].collect()) == [100, 400] and own[1].count() == 2
    with pytest.raises(ValueError, match="heuristic"):
        predictors.get_predictor("none")


def test_python_predictor_runs_once_a_sample(spark):
    size = spark.createDataFrame([("d", str(k), 10) for k in range(40)], "dataset string, sample_id string, width int")
    calls = spark.sparkContext.accumulator(0)

    def own(sample):
        calls.add(1)
        return {"nodes": [{"id": 1, "bbox": [0, 0, 1, 1]}], "edges": []}

    n, e = predictors.python_predictor(own, size, "mine")
    assert n.count() == 40 and e.count() == 0 and n.columns == predictors.NODES and e.columns == predictors.EDGES and calls.value == 40
    spark.catalog.clearCache()


def test_a_predictor_that_fails_at_one_sample(spark):
    n = nodes(spark, [(s, i, box) for s in "abc" for i, box in (("1", (50, 50, 50, 50)), ("2", (200, 50, 50, 50)))])
    e = edges(spark, [(s, "1", "2") for s in "abc"])
    table = spark.createDataFrame([("d", s, "test") for s in "abcz"], "dataset string, sample_id string, split string")

    def own(sample):
        if sample["sample_id"] == "b":
            raise KeyError("b")
        time.sleep(0.02)
        found = [] if sample["nodes"] is None else sample["nodes"]
        return {"nodes": [{"id": x["node_id"], "bbox": [x["x"], x["y"], x["w"], x["h"]]} for x in found], "edges": [{"source": 1, "target": 2}] * bool(len(found))}

    graphs = n.groupBy("dataset", "sample_id").agg(F.collect_list(F.struct("node_id", "x", "y", "w", "h")).alias("nodes"))
    found, steps, runs = predictors.python_runs(own, graphs, "mine")
    assert found.count() == 4 and steps.count() == 2
    assert sorted((r.sample_id, r.error, r.runtime_s >= 0.02) for r in runs.collect()) == [("a", None, True), ("b", "KeyError: 'b'", False), ("c", None, True)]
    with pytest.raises(RuntimeError, match="d/b"):
        predictors.python_predictor(own, graphs, "mine")
    assert predictors.python_runs(lambda s: {"nodes": [{"id": 1, "bbox": [1]}], "edges": []}, graphs, "short")[2].where("error IS NOT NULL").count() == 3
    rows = {r.predictor: r for r in run_benchmark(table, n, e, ["oracle"], 0.2, functions={"mine": own, "naught": lambda s: {"nodes": [], "edges": []}}).collect()}
    assert rows["mine"].num_samples == 4 and rows["mine"].edge_f1 == 0.5 and 0.01 < rows["mine"].runtime_mean_s < 5 and rows["oracle"].runtime_mean_s is None and rows["naught"].runtime_mean_s < rows["mine"].runtime_mean_s


def test_benchmark_by_name(spark):
    n = nodes(spark, [(s, i, box) for s in "abc" for i, box in (("1", (50, 50, 50, 50)), ("2", (200, 50, 50, 50)))])
    e = edges(spark, [(s, "1", "2") for s in "abc"])
    table = spark.createDataFrame([("d", "a", "test"), ("d", "b", "test"), ("d", "c", "train")], "dataset string, sample_id string, split string")
    model = predictors.Model((0.0,) * len(FEATURES))
    rows = {r.predictor: r for r in run_benchmark(table, n, e, ["oracle", "naive", "heuristic", "learned"], 0.2, model=model).collect()}
    assert {r.num_samples for r in rows.values()} == {2} and {r.split for r in rows.values()} == {"test"}
    assert rows["oracle"].exact_match_rate == 1 and rows["naive"].edge_f1 == 0 and rows["heuristic"].edge_f1 == 1
    assert [(r.split, r.num_samples) for r in run_benchmark(table, n, e, ["oracle"], 0.2, split="train").collect()] == [("train", 1)]
    assert run_benchmark(table, n, e, ["oracle"], 0.2, limit=1).first().num_samples == 1
    with pytest.raises(ValueError, match="model"):
        run_benchmark(table, n, e, ["learned"])


def test_order_layers_cycles(spark):
    n = nodes(spark, [("a", str(i), (0, 0, 1, 1)) for i in range(4)] + [("c", "0", (0, 0, 1, 1)), ("c", "1", (0, 0, 1, 1))])
    e = edges(spark, [("a", "0", "1"), ("a", "0", "2"), ("a", "1", "3"), ("a", "2", "3"), ("c", "0", "1"), ("c", "1", "0"), ("c", "1", "9")])
    rows = graphs.topo(n, e).collect()
    assert [r.node_id for r in sorted((r for r in rows if r.sample_id == "a"), key=lambda r: r.ord)] == [0, 1, 2, 3]
    assert {(r.node_id, r.layer, r.x) for r in rows if r.sample_id == "a"} == {(0, 0, 0.0), (1, 1, -0.5), (2, 1, 0.5), (3, 2, 0.0)}
    assert [(r.node_id, r.is_dag) for r in sorted((r for r in rows if r.sample_id == "c"), key=lambda r: r.ord)] == [(0, False), (1, False), (9, False)]


def test_program_runs(spark):
    n, e = nodes(spark, [("s", "0", (0, 0, 1, 1)), ("s", "1", (0, 0, 1, 1))]), edges(spark, [("s", "0", "1")])
    labels = spark.createDataFrame([("d", "s", 0, "Load it")], "dataset string, sample_id string, node_id int, label string")
    code = graphs.program_text(n, e, labels).first().program
    names = {}
    exec(compile(code, "p", "exec"), names)
    assert "Load_it" in names and "node_1" in names and "main" in names


def test_labels_of_the_first_source_count_whole(spark):
    schema = "dataset string, sample_id string, node_id int, label string"
    first = spark.createDataFrame([("d", "a", None, None), ("d", "b", 1, "x")], schema)
    second = spark.createDataFrame([("d", s, i, "y") for s in "abc" for i in (1, 2)], schema)
    assert sorted((r.sample_id, r.node_id, r.source) for r in graphs.resolve_labels({"one": first, "two": second}).collect()) == [("b", 1, "one"), ("c", 1, "two"), ("c", 2, "two")]


def test_graph_files(spark, tmp_path):
    (tmp_path / "0001.json").write_text('{"nodes":[{"id":"A","bbox":[10,10,80,40]},{"id":"B","bbox":[1,2]}],"edges":[{"source":"A","target":"B"},{"u":1,"v":2},{"source":"A"}]}')
    n, e = readers.read_graphs(spark, str(tmp_path), "d")
    assert [(r.sample_id, r.node_id, r.x, r.w) for r in n.orderBy("pos").collect()] == [("0001", "A", 10, 80), ("0001", "B", 0, 0)]
    assert [(r.source, r.target) for r in e.orderBy("pos").collect()] == [("A", "B"), ("1", "2"), (None, None)]


def test_files_and_metadata(spark, tmp_path):
    root = tmp_path / "set"
    (root / "images").mkdir(parents=True)
    (root / "dataset.json").write_text('{"schema_version":"1.0","name":"n","version":"0.1","splits":{"b":["2","1"],"a":["2"],"x":1},"more":{"k":[1]}}')
    for name in ("1.PNG", "2.jpeg", "3.txt"):
        (root / "images" / name).write_bytes(b"abc")
    assert sorted((r.sample_id, r.suffix, r.length) for r in readers.list_files(spark, str(root / "images")).collect()) == [("1", "png", 3), ("2", "jpeg", 3)]
    meta, splits = readers.read_dataset_meta(spark, str(root))
    assert meta.first().extra == {"more": '{"k":[1]}'} and meta.first().dataset == "set"
    assert [(r.split, r.split_ord, r.ord, r.sample_id) for r in splits.orderBy("split_ord", "ord").collect()] == [("b", 0, 0, "2"), ("b", 0, 1, "1"), ("a", 1, 0, "2")]


def test_labels_with_byte_order_mark(spark, tmp_path):
    (tmp_path / "l.json").write_text('﻿{"0":"Start","1":"Left","x":"no"}', encoding="utf-8")
    assert sorted((r.node_id, r.label) for r in readers.read_labels(spark, str(tmp_path)).collect()) == [(0, "Start"), (1, "Left")]


def test_model_round_trip(spark, tmp_path):
    model = predictors.Model(tuple(k / 10 for k in range(len(FEATURES))), 0.5, 0.4, 3)
    writers.write_model(spark, model, str(tmp_path / "m"))
    assert readers.read_model(spark, str(tmp_path / "m")) == model
    with pytest.raises(ValueError):
        predictors.Model((1.0,))


def test_model_without_its_type(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"feature_names": ["a"], "coef": [1.0], "intercept": 0.0}')
    with pytest.raises(ValueError, match="model_type"):
        readers.read_model(spark, str(tmp_path / "m.json"))


def test_results_and_leaderboard(spark, tmp_path):
    run = spark.createDataFrame([("d", "test", p, 1, *m) for p, m in (("naive", (0.0, 0.0, 0.2, 0.0, 2.0, 1.0)), ("oracle", (1.0, 1.0, 1.0, 1.0, 0.0, 0.0)), ("none", (None, None, None, None, None, None)), ("heuristic", (0.5, 0.6, 0.8, 0.5, 1.0, 0.5)))],
                                "dataset string, split string, predictor string, num_samples int, exact_match_rate double, edge_f1 double, node_f1 double, direction_accuracy double, node_count_error double, edge_count_error double")
    writers.write_results(run, {"git_sha": F.lit(None), "timestamp_utc": F.lit("t")}, str(tmp_path / "r"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "r")).collect()]
    rows = spark.createDataFrame([(str(k), v) for k, v in enumerate([*lines, "{", '{"dataset":"a"}', lines[0].replace('"1.1"', '"1"'), lines[0].replace('{"schema', '{"z":1,"schema')])], "path string, value string")
    parsed = readers.parse_results(rows)
    assert sorted(r.problem for r in parsed.where("problem is not null").collect()) == ["missing keys", "no object", "schema version", "unknown keys"]
    board = leaderboard(parsed.where("problem is null"))
    assert [r.predictor for r in board.collect()] == ["oracle", "heuristic", "naive", "none"]
    writers.write_leaderboard(board, str(tmp_path / "csv"))
    text_ = next((tmp_path / "csv").glob("*.csv")).read_text().splitlines()
    assert text_[0] == ",".join(LEADERBOARD) and len(text_) == 5 and text_[4].count(",") == 16


def test_broken_graphs(spark):
    given = ["{not-json", '{"foo": 1}', '{"nodes": [{}], "edges": []}', '{"nodes":[{"id":"n1"}],"edges":[{"source":"n1"}]}', "[]", '{"nodes":[{"id":1}],"edges":[]}', '{"nodes":[],"edges":[]}', None]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(given)], "k int, value string")
    found = sorted((r.k, r.code, r.item_pos) for r in validate.validate_graphs(rows, ["k"]).collect())
    assert found == [(0, "invalid_json", -1), (1, "edges_missing", -1), (1, "nodes_missing", -1), (2, "nodes_id", 0), (3, "edges_target", 0), (4, "not_object", -1), (5, "nodes_id", 0), (7, "invalid_json", -1)]
    with pytest.raises(ValueError):
        validate.raise_on_invalid(validate.validate_graphs(rows, ["k"]))


def test_raw_types(spark):
    box = '"bbox":[1,2,3,4]'
    given = ["x", "[]", "{}", f'{{"nodes":[{{"id":1,{box}}}],"edges":[]}}', f'{{"nodes":[3,{{{box}}},{{"id":1}},{{"id":"1",{box}}},{{"id":1.0,{box}}},{{"id":true,{box}}},{{"id":null,{box}}},{{"id":5,{box}}},{{"id":5,{box}}}],"edges":[]}}',
             '{"nodes":[{"id":1,"bbox":3},{"id":2,"bbox":[1,2,3]},{"id":3,"bbox":[1,2,3,4.0]},{"id":4,"bbox":[1,2,0,4]},{"id":5,"bbox":[1,2,3,"4"]}],"edges":{}}',
             f'{{"nodes":[{{"id":1,{box}}},{{"id":2,{box}}}],"edges":[7,{{"from":1}},{{"from":1,"to":"2"}},{{"from":1,"to":9}},{{"from":2,"to":2}},{{"from":1,"to":2}}]}}']
    rows = spark.createDataFrame(list(enumerate(given)), "k int, value string")
    found = sorted((r.k, r.item_pos, r.code) for r in validate.validate_graphs_typed(rows, ["k"]).collect())
    assert found == [(0, -1, "not_object"), (1, -1, "not_object"), (2, -1, "edges_missing"), (2, -1, "nodes_missing"), (4, 0, "node_not_object"), (4, 1, "node_id_missing"), (4, 2, "node_bbox_missing"),
                     (4, 3, "node_id_type"), (4, 4, "node_id_type"), (4, 5, "node_id_type"), (4, 6, "node_id_type"), (4, 8, "duplicate_id"), (5, -1, "edges_missing"), (5, 0, "node_bbox_shape"),
                     (5, 1, "node_bbox_shape"), (5, 2, "node_bbox_type"), (5, 3, "node_bbox_size"), (5, 4, "node_bbox_type"), (6, 0, "edge_not_object"), (6, 1, "edge_end_missing"), (6, 2, "edge_end_type"), (6, 3, "unknown_node"), (6, 4, "self_loop")]


def test_samples(spark):
    key = "dataset string, sample_id string"
    images = spark.createDataFrame([("d", "1", "a"), ("d", "2", "b"), ("d", "3", "c")], f"{key}, path string")
    docs = spark.createDataFrame([("d", "1", "x"), ("d", "2", "y"), ("d", "9", "z")], f"{key}, path string")
    splits = spark.createDataFrame([("d", "1", "train", 0), ("d", "1", "test", 1), ("d", "7", "test", 1)], f"{key}, split string, split_ord int")
    found = samples.resolve_samples(images, docs, splits)
    assert sorted((r.sample_id, r.split) for r in found.collect()) == [("1", "test"), ("2", "all")]
    assert sorted((r.sample_id, r.code) for r in samples.validate_pairs(images, docs).collect()) == [("3", "missing_graph"), ("9", "missing_image")]
    assert sorted((r.sample_id, r.code) for r in samples.validate_splits(splits, found).collect()) == [("1", "several_splits"), ("7", "unknown_sample")]
    assert [r.sample_id for r in samples.select_split(found).collect()] == ["1"]


def test_conversion(spark):
    record = '{"file":"0.jpeg","mermaid":"%s","meta":{"text":{"0":{"x0":10,"y0":"20","x1":30.5,"y1":50,"mermaid_entity_i":0},"1":{"x0":60,"y0":20,"x1":90,"y1":50,"mermaid_entity_i":1}},"links":{"1":{"start_text_i":"1","end_text_i":"0"}}}}'
    given = [record % "entity0 --> entity1", record % "flowchart", record % "entity0 --> entity5", record % "", "{}"]
    rows = spark.createDataFrame([(str(k), v) for k, v in enumerate(given)], "dataset string, record string")
    n, e, skipped = convert.convert_flowcharts(rows, ["dataset"])
    assert [(r.node_id, r.x, r.y, r.w, r.h) for r in n.where("dataset = 0").orderBy("pos").collect()] == [("0", 10, 20, 20, 30), ("1", 60, 20, 30, 30)]
    assert sorted((r.dataset, r.source, r.target) for r in e.collect()) == [("0", "0", "1"), ("1", "1", "0")]
    assert sorted((r.dataset, r.problem) for r in skipped.collect()) == [("2", "dangling_edge"), ("3", "source_missing"), ("4", "file_missing")]
    with pytest.raises(ValueError):
        convert.convert_flowcharts(rows, ["dataset"], strict=True)


def test_conversion_of_a_split_and_the_last_entry(spark):
    def record(k):
        boxes = {str(j): {"x0": j, "y0": 0, "x1": j + 5, "y1": 5, "mermaid_entity_i": j % 2} for j in range(k + 2)}
        return json.dumps({"file": f"{k}.png", "mermaid": "entity0 --> entity1", "meta": {"text": boxes, "links": {}}})

    rows = spark.createDataFrame([("d", "train" if k % 2 else "test", k, record(k)) for k in range(6)], "dataset string, split string, rec_pos int, record string")
    n, e, bad = convert.convert_flowcharts(rows, ["dataset"], split="test", limit=2)
    assert sorted({r.sample_id for r in n.collect()}) == ["0", "2"] and e.count() == 2 and bad.count() == 0
    assert {(r.sample_id, r.node_id): r.x for r in n.collect()} == {("0", "0"): 0, ("0", "1"): 1, ("2", "0"): 2, ("2", "1"): 3}


def test_unsupervised_records(spark):
    rows = lambda *texts: spark.createDataFrame([("d", k, t) for k, t in enumerate(texts)], "dataset string, rec_pos int, record string")
    with pytest.raises(ValueError, match="no graphs"):
        validate.check_sciflowchart(rows('{"caption": "x"}', "{}"), ["dataset"])
    with pytest.raises(ValueError, match="not supported"):
        validate.check_sciflowchart(rows('{"caption": "x"}', '{"mermaid": "graph TD"}'), ["dataset"])
    with pytest.raises(ValueError, match="empty_box"):
        validate.raise_on_invalid(spark.createDataFrame([("d", "s", "empty_box")], "dataset string, sample_id string, code string"))


def test_snapshot_splits_are_pooled(spark):
    """Membership of all subsets together; names of fields and broken documents name nothing; escapes are read."""
    images = spark.createDataFrame([("s", b, f"raw/{i}.png") for b in "AB" for i in range(1, 5)], "dataset string, subset string, path string")

    def found(*documents):
        table = spark.createDataFrame([("s", b, split, v) for b, split, v in documents], "dataset string, subset string, split string, value string")
        out = {}
        for r in manifest.assign_snapshot_splits(images, table).collect():
            out.setdefault(r.split, set()).add(r.sample_id)
        return out

    both = lambda *ids: {f"{b}:{i}" for b in "AB" for i in ids}
    assert found() == {"test": both(1, 2, 3, 4)} == found(("A", "test", "[\"1\",")) == found(("A", "all", '["1"]'))
    assert found(("A", "test", '["1.png"]'), ("B", "train", '["2", "3"]')) == {"test": both(1), "train": both(2, 3)}
    assert found(("A", "train", '{"4": "3.png", "x": [{"y": "x/\\u0031.PNG"}]}')) == {"train": both(1, 3), "test": both(2, 4)}
    assert found(("A", "train", '["1"]'), ("A", "test", '["1"]')) == {"train": both(1), "test": both(1)}


def test_contour_limits(spark):
    schema = "dataset string, sample_id string, pos int, area double, n_vertices int, n_points int, x int, y int, w int, h int"
    c = spark.createDataFrame([("d", "s", k, *r) for k, r in enumerate([(799.0, 4, 9, 0, 0, 40, 40), (800.0, 4, 10, 0, 0, 40, 40), (800.0, 3, 10, 0, 0, 40, 40), (900.0, 4, 10, 0, 0, 19, 40), (900.0, 4, 10, 0, 0, 100, 40), (900.0, 4, 10, 0, 0, 101, 40)])], schema)
    assert sorted(r.pos for r in contours.filter_rect_contours(c).collect()) == [1, 4]
    a = spark.createDataFrame([("d", "s", k, x, 0, p, 0, 0, 1, 1) for k, (x, p) in enumerate([(79.0, 10), (80.0, 10), (80.0, 9), (20000.0, 10), (20001.0, 10)])], schema)
    assert sorted(r.pos for r in contours.filter_arrow_contours(a).collect()) == [1, 3]
    b = spark.createDataFrame([("d", "s", k, 1.0, 4, 1, x, 0, 10, 10) for k, x in enumerate((0, 1, 2, 30))], schema)
    assert sorted(r.pos for r in contours.dedupe_bboxes(b).collect()) == [0, 2, 3]


def test_generators_are_stable_and_inside(spark):
    ids = generate.numbers(spark, 40)
    for make, canvas in ((generate.generate_synthflow, (640, 360)), (generate.generate_realworld_like, (760, 460))):
        s, n, e = make(ids, 3)
        again = make(generate.numbers(spark, 40, 3), 3)[1]
        assert sorted(map(tuple, n.collect())) == sorted(map(tuple, again.collect())) and s.count() == 40
        assert n.where(f"x < 10 or y < 10 or x + w > {canvas[0] - 10} or y + h > {canvas[1] - 10}").count() == 0
        assert samples.dangling_edges(e, n).count() == 0
    assert generate.generate_synthetic_basic(ids)[0].select("sample_id").distinct().count() == 40
    assert {r.sample_id for r in generate.generate_synthetic_legacy(generate.numbers(spark, 2))[0].collect()} == {"000_chain", "001_branch"}
    with pytest.raises(ValueError):
        generate.numbers(spark, 0)


def test_learning_orders_predictors(spark):
    _, n, e = generate.generate_realworld_like(generate.numbers(spark, 60), 1)
    table = n.select("dataset", "sample_id").distinct().withColumn("split", F.lit("train"))
    rows = training.training_pairs(n, e, table)
    model = training.train_edge_model(rows)
    fit = training.evaluate_fit(rows, model).first()
    assert fit.f1 > 0.7 and fit.tp + fit.fp + fit.tn + fit.fn == rows.count()
    from flowbench.operators.evaluate import evaluate
    from flowbench.operators.pairs import image_extent

    found = {r.predictor: r for r in evaluate(table, n, e, {"oracle": predictors.predict_oracle(n, e), "heuristic": predictors.predict_heuristic(n), "naive": predictors.predict_naive(image_extent(n)), "learned": predictors.predict_learned(n, model)}).collect()}
    assert found["oracle"].exact_match_rate == 1 > found["heuristic"].exact_match_rate
    assert found["heuristic"].edge_f1 > found["naive"].edge_f1 == 0 and found["learned"].edge_f1 > 0.5
    with pytest.raises(Exception, match="both classes"):
        training.class_weights(rows.where("label = 1")).collect()


def test_integrity(spark):
    want = spark.createDataFrame([("d", "a", "1"), ("d", "b", None), ("d", "c", "2"), ("d", "e", "3")], "dataset string, url string, sha256 string")
    have = spark.createDataFrame([("d", "a", "1"), ("d", "b", "9"), ("d", "c", "9")], "dataset string, url string, sha256 string")
    assert sorted((r.url, r.status) for r in manifest.verify_manifest(want, have).collect()) == [("a", "ok"), ("b", "ok"), ("c", "sha_mismatch"), ("e", "missing")]
    files = spark.createDataFrame([("d", 100), ("d", 924), ("e", None)], "dataset string, length long")
    assert sorted((r.dataset, r.n_files, r.bytes) for r in manifest.snapshot_totals(files).collect()) == [("d", 2, 1024), ("e", 1, None)]


def test_manifests_parse(spark):
    rows = spark.createDataFrame([(1, '{"schema_version":999,"name":"n","version":"1","artifacts":[{"url":"u","sha256":"s","bytes":3,"local_path":"p"}]}'), (2, "{}")], "k int, value string")
    assert sorted((r.k, r.code) for r in validate.validate_manifest(rows, ["k"]).collect()) == [(1, "schema_version"), (2, "missing_key")]
    assert [tuple(r) for r in readers.parse_manifests(rows, ["k"]).collect()] == [(1, "n", "1", "u", "s", 3, "p")]
