"""Recipe files, tokenizer snapshots and JSON styles."""

import json

import pytest
from pyspark.sql import functions as F

from convspan.functions import json_text
from convspan.sources import tokenizer, training_recipe

RUN = """
schema_version: 1
model: {architecture: olmo2, repo_id: a/b, revision: "abc"}
data: {repo_id: c/d, revision: "def", split: train, adapter: messages}
objective: {rules: [{name: answers, select: {role: assistant}, weight: 1, require_match: true}]}
training: {max_length: 256, truncation: loss_aware, truncation_min_context_tokens: 32, steps: 10, peak_learning_rate: 1.0e-5}
run: {output_dir: /tmp/out}
"""


def test_recipe_files(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text(RUN)
    found, name = training_recipe.load_file(str(tmp_path / "a.yaml"))
    assert found["training"]["beta2"] == 0.95 and found["objective"]["rules"][0]["require_match"] is True
    (tmp_path / "b.json").write_text(json.dumps(found))
    assert training_recipe.load_file(str(tmp_path / "b.json")) == (found, name)
    (tmp_path / "c.yaml").write_text(RUN + "run: {output_dir: other}\n")
    with pytest.raises(ValueError, match="twice"):
        training_recipe.load_file(str(tmp_path / "c.yaml"))


@pytest.mark.parametrize(
    "section,key,value",
    [("model", "dtype", "int8"), ("model", "revision", ""), ("model", "extra", 1), ("data", "shuffle_buffer_size", 0), ("data", "renderer", "x"), ("training", "max_length", 1), ("training", "steps", 0), ("training", "warmup_steps", 10),
     ("training", "peak_learning_rate", float("inf")), ("training", "beta1", 1.0), ("training", "truncation", "none"), ("training", "truncation", "right"), ("training", "truncation_min_context_tokens", 256), ("run", "output_dir", None)],
)
def test_recipe_checks(section, key, value):
    yaml = pytest.importorskip("yaml")
    raw = yaml.safe_load(RUN)
    if section == "run":
        del raw["run"]["output_dir"]
    else:
        raw[section][key] = value
    with pytest.raises(ValueError):
        training_recipe.resolve(raw)


def test_tokenizer_snapshot(spark, tmp_path):
    file = tmp_path / "tokenizer.json"
    file.write_text(json.dumps({"model": {"vocab": {"a": 0, "b": 1}}, "added_tokens": [{"id": 2, "content": "<|endoftext|>"}]}))
    plain = tokenizer.snapshot(str(tmp_path))
    assert plain.pad_token_id == 2 and plain == tokenizer.snapshot(str(file)) and plain.table(spark).count() == 3
    (tmp_path / "tokenizer_config.json").write_text(json.dumps({"pad_token": {"content": "b"}}))
    named = tokenizer.snapshot(str(file))
    assert named.pad_token_id == 1 and named.identity != plain.identity and tokenizer.snapshot(str(file), 0).pad_token_id == 0
    with pytest.raises(ValueError):
        tokenizer.snapshot(str(file), 3)
    (tmp_path / "tokenizer_config.json").write_text(json.dumps({"pad_token": 7}))
    with pytest.raises(ValueError):
        tokenizer.snapshot(str(file))


def test_json_styles(spark, tmp_path):
    text = '{"b": 2.50, "a": [1, "é"], "c": null}'
    row = spark.createDataFrame([(text,), (None,)], "v string").select(json_text.canonical(F.col("v")).alias("c"), json_text.spaced(F.col("v")).alias("s"), json_text.pretty(F.col("v")).alias("p"), json_text.identity("x", F.col("v")).alias("i")).collect()
    assert row[0].c == '{"a":[1,"é"],"b":2.5,"c":null}' and row[0].s == '{"b": 2.5, "a": [1, "é"], "c": null}' and row[0].p.startswith('{\n  "b": 2.5') and len(row[0].i) == 64 and row[1].c is None
    events = spark.createDataFrame([(1, None), (2, "x")], "step int, note string")
    json_text.write_lines(events, str(tmp_path / "log"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "log")).collect()) == ['{"step":1,"note":null}', '{"step":2,"note":"x"}']
