"""Queries over odd rows written by hand, against their own SQL; signs of zeros count."""

import datetime
import math

import duckdb
import pytest

from keyloom.plans import registry


def told(v):
    if isinstance(v, (list, tuple)):
        return [told(x) for x in v]
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v)


def agree(spark, folder, name, table, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    df = registry.QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    rel = con.execute(registry.ORACLES[name])
    at = [[d[0] for d in rel.description].index(c) for c in df.columns]
    want = sorted((told([r[k] for k in at]) for r in rel.fetchall()), key=str)
    got = sorted((told(list(r)) for r in df.collect()), key=str)
    assert got == want
    return got


def test_gradient_stops_of_small_and_missing_numbers(spark, tmp_path):
    tiny = [-1e-8, 0.5] * 12
    rows = [(0, tiny), (1, tiny), (2, [0.0078125, -0.0078125] * 12), (4, None), (5, None), (6, [0.25] * 18), (7, [])]
    assert any("'-0.0'" in str(r) for r in agree(spark, tmp_path, "gradient_stops", "embeddings", rows, "vec_id long, embedding array<float>"))


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event(i, at, user, value):
    return (i, None if at is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=at), user, "view", value, "{}")


def odd_events():
    """Values and times that are missing, several at a time, not a number, small, with long fractions; times before 1970."""
    first = [None, 2.0, float("nan"), -1e-9, 16.0603125, 49.1320625, None, 5.5]
    rows = [event(i, 61 * (i // 3), 1, first[i % 8]) for i in range(40)]
    rows += [event(100 + i, None if i % 5 == 3 else 40 * i, 2, 0.01 * i * i) for i in range(30)]
    rows += [event(200 + i, None, 3, 1.5) for i in range(4)] + [event(300 + i, 90 * i, None, 2.5 * i) for i in range(6)]
    rows += [event(400 + i, 70 * i, 4, None) for i in range(6)] + [event(500 + i, -1704067200 - 29.9995 * i, 5, i / 3) for i in range(12)]
    return rows


def test_keyframe_merge_of_odd_events(spark, tmp_path):
    agree(spark, tmp_path, "keyframe_merge", "events", odd_events(), EVENTS)


def test_keyframe_upsert_of_odd_events(spark, tmp_path):
    agree(spark, tmp_path, "keyframe_upsert", "events", odd_events(), EVENTS)


def test_sine_displace_of_odd_events(spark, tmp_path):
    agree(spark, tmp_path, "sine_displace", "events", odd_events(), EVENTS)


def test_union_resample_of_odd_events(spark, tmp_path):
    agree(spark, tmp_path, "union_resample", "events", odd_events(), EVENTS)


def test_value_at_time_of_odd_events(spark, tmp_path):
    agree(spark, tmp_path, "value_at_time", "events", odd_events(), EVENTS)


def test_simplify_text_of_odd_texts(spark, tmp_path):
    texts = [None, "", " ", " a b ", "　 ", "a\x0bb\x85c", "the video ſhowſ x", "the vıdeo shows", "THIS İMAGE", "the image shows", "tail \n", "x "]
    rows = [(4 * k + 2, x + "rest" if i else x, "en", "s", 1) for k, (x, i) in enumerate([(x, 0) for x in texts] + [(c, 1) for c in "ßŉǆﬁıİᾳᾀΐe\U00010428"])]
    agree(spark, tmp_path, "simplify_text", "documents", rows + [(r[0] + k, *r[1:]) for r in rows for k in (1, 2, 3)], "doc_id long, text string, lang string, source string, n_chars long")
