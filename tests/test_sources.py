"""Scans, splits, prompts, logs, drawings in files, sinks."""

import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from keyloom.operators import documents
from keyloom.sources import corpus, drawings, sinks


def test_recursive_scan_and_lookup(spark, tmp_path):
    for k, name in enumerate(["a", "b/c", "b/d"]):
        spark.createDataFrame([(10 * k + i, k) for i in range(4)], "id long, extra int" if k else "id long, other int").coalesce(1).write.parquet(f"{tmp_path}/{name}")
    rows = corpus.scan_parquet(spark, str(tmp_path))
    assert rows.count() == 12 and set(rows.columns) == {"id", "extra", "other"}
    files = sorted({r.file_name for r in rows.select("_metadata.file_name").collect()})
    wanted = spark.createDataFrame([(f, 1) for f in files] + [("none", 0)], "file_name string, row_index long")
    assert sorted(r.id for r in corpus.lookup_rows(rows, wanted).collect()) == [1, 11, 21]
    with pytest.raises(ValueError):
        corpus.read_files(spark, [])


def test_split_files():
    files = [f"f{k}" for k in range(100)]
    train, held = corpus.split_files(files[::-1])
    assert len(train) == 98 and len(held) == 2 and sorted(train + held) == sorted(files) and corpus.split_files(files) == (train, held)
    assert corpus.split_files(["x"]) == (["x"], []) and [len(x) for x in corpus.split_files(["x", "y"])] == [1, 1]


def test_prompts_ids_and_log(spark, tmp_path):
    (tmp_path / "prompts.txt").write_text("  a cat \n\n \t\ndog\n")
    assert [r.prompt for r in corpus.read_prompts(spark, f"{tmp_path}/prompts.txt").orderBy("line").collect()] == ["a cat", "dog"]
    for name, text in (("list.json", "[3, 1, 3]"), ("object.json", '{"valid_indices": [3, 1, 3]}')):
        (tmp_path / name).write_text(text)
        assert [r.id for r in corpus.read_valid_ids(spark, f"{tmp_path}/{name}").orderBy("position").collect()] == [3, 1, 3]
    (tmp_path / "log.jsonl").write_text('{"event": "eval_step", "eval_loss": 0.5}\n\n{broken\n{"event": "run_started", "task_histogram": {"text": 2}}\n')
    assert sorted(r.event for r in corpus.read_event_log(spark, f"{tmp_path}/log.jsonl").collect()) == ["eval_step", "run_started"]


DRAWING = {"fr": 24, "layers": [{"ty": 4, "shapes": [{"ty": "el"}]}]}


def test_drawings_of_all_formats(spark, tmp_path):
    text = json.dumps(DRAWING)
    (tmp_path / "a.json").write_text(text)
    (tmp_path / "b.json").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "c.json").write_bytes(b"\x1f\x8bbroken")
    rows = {r.path.split("/")[-1]: r for r in drawings.read_drawings(spark, str(tmp_path), "json").collect()}
    assert rows["a.json"].text == rows["b.json"].text == text and rows["c.json"].text is None and rows["c.json"].error
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("manifest.json", json.dumps({"animations": [{"id": "two"}, {"id": "one"}, {"id": "gone"}]}))
        for i in ("one", "two"):
            z.writestr(f"animations/{i}.json", text)
    (tmp_path / "e.zip").write_bytes(b"no zip")
    got = drawings.read_drawings(spark, str(tmp_path), "bundle").collect()
    assert [r.name for r in got if r.error is None] == ["two", "one"] and len(got) == 3
    drawings.register("plain", "*.txt", lambda data: [("x", data.decode())])
    (tmp_path / "f.txt").write_text("{}")
    assert drawings.read_drawings(spark, str(tmp_path), "plain").first().text == "{}"


def test_svg_rows(spark):
    svg = '<svg><rect x="1" y="2" width="10" height="4" rx="2" style="fill: #ff0000"/><g><circle cx="5" cy="6" r="3" fill="blue"/></g><path d="M0 0L1,2z"/></svg>'
    rows = drawings.svg_primitives(drawings.svg_elements(spark.createDataFrame([(1, svg)], "id long, svg string"), "id", "svg")).orderBy("pos").collect()
    assert [(r.element, r.center, r.size, r.rounding, r.fill) for r in rows[:2]] == [("rect", [6.0, 4.0], [10.0, 4.0], 1.0, [1.0, 0.0, 0.0, 1.0]), ("circle", [5.0, 6.0], [6.0, 6.0], None, [0.0, 0.0, 1.0, 1.0])]
    assert rows[2].path == ["M", "0", "0", "L", "1", "2", "z"] and rows[2].fill == [0.0, 0.0, 0.0, 1.0]


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a/b", "{}"), (2, "a:b", "{1}"), (3, "", "</script>")], "id long, name string, text string")
    names = {r.id: r.file_name for r in sinks.unique_names(docs, "name", "id").collect()}
    assert names == {1: "a_b", 2: "a_b_2", 3: "unnamed"}
    sinks.write_json(docs, "text", f"{tmp_path}/out", gzip=True)
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out").collect()) == ["</script>", "{1}", "{}"]
    page = docs.where("id = 3").select(sinks.html_page(F.lit("<t>"), F.col("text")).alias("p")).first().p
    assert "<\\/script>" in page and "&lt;t>" in page
    for _ in range(2):
        sinks.append_events(spark.createDataFrame([("x",)], "event string"), f"{tmp_path}/events")
    assert corpus.read_event_log(spark, f"{tmp_path}/events").count() == 2


def test_differences(spark):
    docs = spark.createDataFrame([(1, '{"a": 1, "b": [2, 3]}'), (2, "no json")], "id long, text string")
    other = spark.createDataFrame([(1, '{"a": 1, "b": [2, 4], "c": null}')], "id long, text string")
    diff = sinks.differences(documents.walk(docs, "id", "text"), documents.walk(other, "id", "text"))
    assert [(r.path, r.left, r.right) for r in diff.collect()] == [("$.b[1]", "3", "4")]
