"""Config texts: what is read, what is resolved, and parameters in bulk."""

import json
import math

import pytest

from sparkloom.sources import configs as C

TEXT = """
# a run
experiment_id: exp-12   # behind a value
language: "sm\\u00e5"
empty:
tilde: ~
'quoted key': 'it''s # no comment'
model:
  pretrained_name: org/base-model:v1
  sizes: [1, 2.5, "x, y", {a: b, c: [d]}, ${training.steps}]
  dropout: 1e-3
  on: yes
  url: http://host/a#b
training:
  steps: 20_000
  train_batch_size: ${divide:${training.steps},300}
  ratio: .5
  names:
  - one
  - two words
  nested:
    - name: first
      list:
        - 1
        - [2, 3]
    -
      name: second
  text: |
    line one
      line two

    line three
  folded: >-
    a
    b
note: ""
flow: {x: 1, "y z": null, u: "a: b"}
last: -3
"""


def test_parse():
    got = C.parse(TEXT)
    assert got == {
        "experiment_id": "exp-12", "language": "små", "empty": None, "tilde": None, "quoted key": "it's # no comment",
        "model": {"pretrained_name": "org/base-model:v1", "sizes": [1, 2.5, "x, y", {"a": "b", "c": ["d"]}, "${training.steps}"], "dropout": 0.001, "on": True, "url": "http://host/a#b"},
        "training": {"steps": 20000, "train_batch_size": "${divide:${training.steps},300}", "ratio": 0.5, "names": ["one", "two words"],
                     "nested": [{"name": "first", "list": [1, [2, 3]]}, {"name": "second"}], "text": "line one\n  line two\n\nline three\n", "folded": "a b"},
        "note": "", "flow": {"x": 1, "y z": None, "u": "a: b"}, "last": -3,
    }
    assert C.parse("") is None and C.parse("# only\n---\n") is None and C.parse("- a\n- b: 1\n  c: 2\n") == ["a", {"b": 1, "c": 2}]
    assert C.parse("[1, true, .inf]") == [1, True, math.inf] and C.parse("a: 1.0e-05")["a"] == 1e-5


def test_json_is_read_too():
    record = {"spec": {"name": "x", "seed": 1, "list": [1, None, True, "ü\n\"q\""], "f": 0.25}, "empty": {}, "none": []}
    assert C.parse(json.dumps(record)) == record == C.parse(json.dumps(record, indent=2, ensure_ascii=False))


@pytest.mark.parametrize("bad", ["a: 1\na: 2", "a: [1, 2", "a: 'x", "a: 1\n   b: 2", "a: &x 1", "a: *x", "just\nwords: x: y\n- z", "a: b\nc"])
def test_unreadable(bad):
    with pytest.raises(ValueError):
        C.parse(bad)


def test_resolved():
    got = C.resolved(C.parse(TEXT))
    assert got["training"]["train_batch_size"] == 66 and got["model"]["sizes"][4] == 20000
    assert C.resolved({"a": "${b.c.1}-${b.d}/x", "b": {"c": [1, 2], "d": "${e}"}, "e": True, "f": "${b.c}"}) == {"a": "2-True/x", "b": {"c": [1, 2], "d": True}, "e": True, "f": [1, 2]}
    for bad in ({"a": "${b}", "b": "${a}"}, {"a": "${x.y}"}, {"a": "${nope:1}"}):
        with pytest.raises(ValueError):
            C.resolved(bad)


def test_parameters_in_bulk(spark):
    rows = [("good", TEXT), ("none", None), ("list", "- a"), ("bad", "a: ["), ("noid", "model: {x: 1}")]
    df = spark.createDataFrame(rows, "file string, text string").repartition(2)
    got = C.config_parameters(df).collect()
    assert {r.file: r.problem for r in got if r.problem}.keys() == {"none", "list", "bad", "noid"}
    assert {(r.param, r.value) for r in got if r.file == "good"} == {("language", "små"), ("pretrained_name", "org/base-model:v1"), ("dropout", "0.001"), ("on", "true"), ("url", "http://host/a#b"), ("steps", "20k"), ("ratio", "0.5"), ("text", "line one\n  line two\n\nline three\n"), ("folded", "a b")}
    assert ("train_batch_size", "66") in {(r.param, r.value) for r in C.config_parameters(df, resolve=True).collect() if r.file == "good"}
    assert {r.run for r in got if r.file == "good"} == {"exp-12"}


def test_language():
    codes = {"en": "English", "sv": "Swedish"}
    assert [C.checked_language(x, codes) for x in ("sv", "EN", "Swedish", "detect", "DETECT")] == ["sv", "EN", "Swedish", None, None]
    for bad in (None, "klingon", ""):
        with pytest.raises(ValueError, match="en, sv"):
            C.checked_language(bad, codes)
