from __future__ import annotations

import json
import random

import pytest

from furrow.sources import json_array

ODD = ['plain', 'a "quoted" {brace}', '}]{[', 'ends in a backslash \\', '\\" \\\\"', '', 'खेत 🌾', '\n\t{']


def element(rng, depth=0):
    out = {"id": rng.randrange(10**6), rng.choice(ODD) + "k": rng.choice(ODD)}
    if depth < 3:
        out["in"] = [element(rng, depth + 1) for _ in range(rng.randrange(3))]
    return out


def texts(df):
    return sorted(json.dumps(json.loads(r.value), sort_keys=True) for r in df.collect())


@pytest.mark.parametrize("split_bytes", [97, 300, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_splits_anywhere(spark, tmp_path, split_bytes, indent):
    rng = random.Random(split_bytes)
    wanted = []
    for name, n in (("a", 25), ("b", 1), ("c", 0)):
        rows = [element(rng) for _ in range(n)]
        wanted += rows
        (tmp_path / f"{name}.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=False))
    (tmp_path / "empty.json").write_text("")
    want = sorted(json.dumps(w, sort_keys=True) for w in wanted)
    assert texts(json_array.elements(spark, str(tmp_path), split_bytes)) == want
    # and where the beginnings of splits are too many to be sent to every task
    assert texts(json_array.elements(spark, str(tmp_path), split_bytes, max_broadcast=0)) == want


def test_an_element_longer_than_splits(spark, tmp_path):
    rows = [{"a": 1}, {"a": "x{" * 4000, "b": [{"c": "}" * 3000}] * 5}, {"a": 2}]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    assert texts(json_array.elements(spark, str(tmp_path), 500)) == \
        sorted(json.dumps(r, sort_keys=True) for r in rows)


@pytest.mark.parametrize("text", ['[{"a": 1}', '[{"a": "b]}', '{"a": 1}}]'])
def test_a_broken_file_is_an_error(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(ValueError, match="1 files"):
        json_array.elements(spark, str(tmp_path))


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    df = spark.range(60_000).selectExpr("to_json(struct(id, repeat('z', 40) as pad)) as value")
    json_array.write(df.coalesce(1), str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    out = json_array.elements(spark, str(tmp_path / "in"), 256 << 10)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    assert out.selectExpr("get_json_object(value, '$.id') as id").distinct().count() == 60_000
    whole = spark.read.parquet(out.inputFiles()[0].rsplit("/fragment=", 1)[0] + "/fragment=false")
    assert whole.select("start").distinct().count() > 8
