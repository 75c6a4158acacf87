"""Rules and quirks that the queries don't reach, against rows written by hand."""

import json
import math

import pytest
from pyspark.sql import functions as F

from keyloom.functions import geometry as g
from keyloom.functions import text as t
from keyloom.operators import assembly, codec, documents, graph, keyframes, metrics, pixels, views
from keyloom.operators.rank import global_rank
from keyloom.streaming import log_tail


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_views_of_labels(spark):
    for label, want in ((None, "text"), (" Text_To_Drawing ", "text"), ("text-image2drawing", "image"), ("IMAGE", "image"), ("video-to-drawing", "video"), ("text-to-speech", "text-to-speech"), ("video2x", "video2x"), ("mixed", "mixed"), ("Other_Kind", "other-kind")):
        assert one(spark, views.normalize_task(F.lit(label).cast("string"))) == want
    schema = "idx int, detail string, image string, video string, target string, task_type string"
    rows = [(0, "d", "i", "v", "t", "mixed"), (1, "d", "i", "v", "t", None), (2, "", "i", "v", "t", "mixed"), (3, "d", "i", "v", None, "mixed"), (4, "d", None, None, "", "video"), (5, "d", "i", "v", "", "unknown")]
    got = sorted((r.idx, r.view) for r in views.explode_views(spark.createDataFrame(rows, schema), "idx").collect())
    assert got == [(0, "image"), (0, "text"), (0, "video"), (1, "text"), (2, "video"), (5, "image"), (5, "text"), (5, "video")]


def test_resampling_laws(spark):
    v = spark.createDataFrame([(i, "text") for i in range(7)] + [(i, "image") for i in range(3)], "idx long, view string")
    drawn = {(r.view, r.idx): r.reps for r in views.ratio_resample(v, "idx", {"text": 1, "image": 3, "video": 1}).collect()}
    assert sum(n for (w, _), n in drawn.items() if w == "text") == 2 and sum(n for (w, _), n in drawn.items() if w == "image") == 6
    assert set(drawn) == {("text", 0), ("text", 1), ("image", 0), ("image", 1), ("image", 2)}
    with pytest.raises(ValueError):
        views.ratio_resample(v, "idx", {"text": -1.0})
    assert one(spark, views.parse_ratios(F.lit("text=1, Image =1.2"))) == {"text": 1.0, "image": 1.2}


def test_global_rank_with_crowded_values(spark):
    rows = [(i * i * i, i % 2) for i in range(500)]
    got = {r.v: r["rank"] for r in global_rank(spark.createDataFrame(rows, "v long, k int"), "v", ("k",)).collect()}
    assert got == {i * i * i: i // 2 for i in range(500)}
    assert global_rank(spark.createDataFrame([], "v long"), "v").count() == 0


def test_next_valid_goes_around(spark):
    ok = {5, 40}
    got = {r.i: r.chosen for r in views.next_valid(spark.createDataFrame([(i, i in ok) for i in range(50)], "i long, ok boolean"), "i", "ok", run=20).collect()}
    want = {i: next((j % 50 for j in range(i, i + 16) if j % 50 in ok), None) for i in range(50)}
    assert got == want


def test_budget_edges(spark):
    def run(c, x, media, limit=512):
        out = assembly.budgets(F.lit(c), F.lit(x), F.lit(media), limit)
        return spark.range(1).select(*[v.alias(k) for k, v in out.items()]).first().asDict()

    assert run(1000, 1000, False) == {"target_length": 256, "condition_length": 256, "truncated_target": True, "truncated_condition": True, "overflow": False}
    assert run(600, 5, True)["overflow"] and run(600, 5, True)["target_length"] == 1
    assert run(3, 4, False) == {"target_length": 4, "condition_length": 3, "truncated_target": False, "truncated_condition": False, "overflow": False}
    assert assembly.reserve(10_000) == 1024 and assembly.reserve(100) == 256


def test_best_of_n_ties_and_survivors(spark):
    rows = [(1, 1, True, False, 50, 1, True), (1, 0, True, False, 50, 1, True), (2, 0, True, True, 9, 1, True), (3, 0, False, False, 10, 0, True), (4, 0, True, True, 99, 9, False)]
    got = {r.p: (r.c, r.survivors) for r in metrics.best_of_n(spark.createDataFrame(rows, "p int, c int, valid boolean, eos boolean, tokens int, layers int, decoded boolean"), "p", ["c"]).collect()}
    assert got == {1: (0, 2), 3: (0, 1)}


def test_keyframe_values(spark):
    kf = spark.createDataFrame([("p", 10, 1.0, 0), ("p", 20, 3.0, 1), ("p", 20, 9.0, 2), ("q", 5, 7.0, 0)], "prop string, t long, v double, seq int")
    seg = keyframes.merge(kf, "prop", "t", "v", "seq")
    asked = spark.createDataFrame([("p", 0), ("p", 10), ("p", 15), ("p", 20), ("p", 99), ("q", 0), ("q", 9), ("r", 1)], "prop string, t long")
    got = {(r.prop, r.t): r.value for r in keyframes.value_at(seg, asked, "prop", "t").collect()}
    assert got == {("p", 0): 1.0, ("p", 10): 1.0, ("p", 15): 2.0, ("p", 20): 3.0, ("p", 99): 3.0, ("q", 0): 7.0, ("q", 9): 7.0, ("r", 1): None}
    assert {r.start for r in keyframes.upsert(kf, "prop", "t", "v", "seq").where("prop = 'p' and t = 20").collect()} == {9.0}
    eased = seg.selectExpr("*", "0.42 as x1", "0.0 as y1", "if(prop = 'p', 0.58, null) as x2", "1.0 as y2")
    at = {(r.prop, r.t): r.value for r in keyframes.value_at(eased, asked, "prop", "t", ["x1", "y1", "x2", "y2"]).collect()}
    assert math.isclose(at["p", 15], 2.0, abs_tol=1e-5) and at["p", 10] == 1.0


def test_easing_against_the_curve(spark):
    for x1, y1, x2, y2 in ((0.42, 0.0, 0.58, 1.0), (0.1, 0.9, 0.2, 1.0), (0.9, 0.1, 0.1, 0.9)):
        for u in (0.1, 0.37, 0.8):
            x = 3 * (1 - u) ** 2 * u * x1 + 3 * (1 - u) * u * u * x2 + u**3
            y = 3 * (1 - u) ** 2 * u * y1 + 3 * (1 - u) * u * u * y2 + u**3
            assert math.isclose(one(spark, g.ease(F.lit(x1), F.lit(y1), F.lit(x2), F.lit(y2), F.lit(x))), y, abs_tol=1e-5)
    assert one(spark, g.ease(F.lit(0.3), F.lit(0.3), F.lit(0.6), F.lit(0.6), F.lit(0.25))) == 0.25


def test_text_functions(spark):
    assert one(spark, t.sanitize_filename(F.lit(' a<b>:  "c"\n__'))) == "a_b_c" and one(spark, t.sanitize_filename(F.lit("??"))) == "unnamed"
    assert one(spark, F.length(t.sanitize_filename(F.lit("x" * 500)))) == 180
    assert one(spark, t.simplify_description(F.lit("the VIDEO shows  a cat. In this image, b"))) == "A cat. In , b"
    assert one(spark, t.clock_to_seconds(F.lit("01:02:03.5"))) == 3723.5 and one(spark, t.clock_to_seconds(F.lit("500ms"))) is None
    assert one(spark, t.attributes(F.lit('(layer a=1 nm="x y" k=[1, 2])'))) == {"a": "1", "nm": "x y", "k": "[1, 2]"}
    assert one(spark, t.dash_pairs(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)))) == [[1.0, 2.0], [3.0, 1.0], [2.0, 3.0]]


def test_codec_round_trip_and_shift(spark):
    rows = [(1, 0, "fill", {"R": 1.0, "G": 2.5, "B": 3.5}), (1, 1, "point", {"X": 10.0, "Y": -4.0}), (1, 2, "nonsense", {"X": 1.0}), (2, 0, "/group", {})]
    df = spark.createDataFrame(rows, "doc_id long, pos int, command string, params map<string, double>")
    back = sorted((r.doc_id, r.at, r.command, r.params) for r in codec.decode(codec.encode(df, 200_000), 200_000).collect())
    assert back == [(1, 0, "fill", {"R": 1.0, "G": 2.0, "B": 4.0}), (1, 4, "point", {"X": 10.0, "Y": -4.0}), (2, 0, "/group", {})]
    assert codec.layout(codec.FIRST)["shift"] == 0 and codec.layout(codec.FIRST + 7)["eos"] == codec.EOS + 7
    o = codec.offsets()
    assert (o["TIME"], o["SPACE"], o["IX"], o["NUMBER"], o["WIDTH_VALUE"]) == (155000, 159100, 166019, 173186, 181300)
    lone = spark.createDataFrame([(1, [5, 5, codec.COMMAND + 200_000 - codec.FIRST + 5, 9, 9])], "doc_id long, tokens array<bigint>")
    assert [(r.command, r.params) for r in codec.decode(lone, 200_000).collect()] == [("/position", {})]


def test_repair_rules():
    doc = {
        "ip": 0.5, "op": 1.5, "w": 600, "layers": [
            {"ty": 4, "ind": 1, "ip": 9, "op": 3, "st": 2.5, "parent": 7, "ct": 1, "shapes": [{"ty": "gr", "it": []}]},
            {"ty": 4, "ind": 2, "parent": 1, "shapes": [3, {"ty": "gr", "it": [{"ty": "rc"}]}], "ks": {"p": {"a": 1, "k": [{"t": 2.5, "s": [900, 10]}]}}},
        ],
        "assets": [{"id": "a", "layers": [{"ty": 4}, {"ty": 3, "parent": 2}, {"ty": 3, "ind": 5, "parent": 5}]}, {"id": "b"}],
    }
    out = documents.repair(json.loads(json.dumps(doc)))
    assert (out["ip"], out["op"], out["fr"], out["w"], out["h"]) == (0, 2, 8, 992, 576)
    (layer,) = out["layers"]
    assert layer["parent"] == 1 and layer["shapes"][0]["it"][-1]["ty"] == "tr" and layer["ks"]["p"]["k"][0]["t"] == 2
    assert [x.get("parent") for x in out["assets"][0]["layers"]] == [2, None] and out["assets"][1] == {"id": "b"}
    assert documents.repair({"layers": [{"ty": 1, "ip": -3, "op": 99}]})["layers"][0] | {"ty": 1} == {"ty": 1, "ip": 0, "op": 16, "st": 0}


def test_bad_documents_are_rows(spark):
    docs = spark.createDataFrame([(1, "{"), (2, "[1]"), (3, None), (4, '{"layers": []}')], "id long, text string")
    got = {r.key: (r.text is not None, r.error) for r in documents.repaired(docs, "id", "text").collect()}
    assert got[4] == (True, None) and all(e for k, (_, e) in got.items() if k < 4)
    rules = sorted((r.id, r.rule) for r in documents.violations(docs, "id", "text", least="Error").collect())
    assert (1, "json") in rules


def test_rounding_and_walk():
    assert documents.rounded({"a": 1.23456, "b": 2.0, "nm": "x", "c": [None, 0.5]}, 3, ("nm",)) == {"a": 1.235, "b": 2, "c": [0.5]}
    deep = 1
    for _ in range(3000):
        deep = [deep]
    assert sum(1 for _ in documents.walk_json(deep)) == 3001
    assert [p for p, *_ in documents.walk_json({"a": [True, None]})] == ["$", "$.a", "$.a[0]", "$.a[1]"]


def test_graph_and_pixels(spark):
    layers = spark.createDataFrame([("d", 1, None, 1), ("d", 2, 1, 1), ("d", 3, 2, 1), ("d", 4, 9, 1)], "doc string, ind int, parent int, v int")
    assert {r.ind: r.depth for r in graph.ancestor_sums(layers, "v").collect()} == {1: 1, 2: 2, 3: 3, 4: 1}
    assert {r.ind for r in graph.delete_with_children(layers, layers.where("ind = 2").select("doc", "ind")).collect()} == {1, 4}
    px = spark.createDataFrame([(x, y, "a") for x in range(3) for y in range(2)] + [(5, 0, "a"), (3, 1, "b")], "x int, y int, color string")
    rect = sorted((r.x, r.y, r.width, r.height, r.color) for r in pixels.rectangles(pixels.runs(px, []), []).collect())
    assert rect == [(0, 0, 3, 2, "a"), (3, 1, 1, 1, "b"), (5, 0, 1, 1, "a")]
    centres = pixels.palette(spark.createDataFrame([([0.0, 0.0],), ([0.0, 0.1],), ([1.0, 1.0],)], "c array<double>"), "c", 2)
    assert [round(x, 2) for x in centres[0]] == [0.0, 0.05] and centres[1] == [1.0, 1.0]


def test_streams(spark, tmp_path):
    rows = [{"ts": f"2026-01-01T00:{m:02d}:00Z", "event": "eval_step", "run": "r", "step": m, "loss": 10.0 - min(m, 5)} for m in range(12)]
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text("\n".join(json.dumps(r) for r in rows[:6]) + "\nbroken\n")
    (src / "b.json").write_text("\n".join(json.dumps(r) for r in rows[6:]))
    stream = log_tail.follow(spark, str(src), "ts timestamp, event string, run string, step long, loss double", files=1)

    def drain(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    assert sum(r.n for r in drain(log_tail.windowed_losses(stream, "ts", "loss"), "losses", "complete")) == 12
    assert [r.n for r in drain(log_tail.sessions(stream, "ts", "run"), "stretches", "complete")] == [12]
    got = {r.step: (r.best, r.waited, r.stopped) for r in drain(log_tail.patience(stream, "run", "step", "loss", 3), "waits", "append")}
    batch = metrics.early_stopping(spark.createDataFrame([(r["run"], r["step"], r["loss"]) for r in rows], "run string, step long, loss double"), "run", "step", "loss", 3)
    assert got == {r.step: (r.best, r.waited, r.stopped) for r in batch.collect()} and len(got) == 12
