import pytest

from sylva.functions.scalars import number, number_text, ordered, resolve
from sylva.functions.yaml import YamlError, parse
from sylva.operators.shred import shred_text


def plain(n):
    if n is None:
        return None
    if n.kind == "scalar":
        return n.value
    if n.kind == "alias":
        return "*" + n.value
    return [plain(x) for x in n.items] if n.kind == "seq" else {plain(k): plain(v) for k, v in n.items}


@pytest.mark.parametrize(
    "text, want",
    [
        ("a: 1\nb:\n  - x\n  - y: 2\n    z: 3\nc: {d: [1, 2], \"e\":f}\n", [{"a": "1", "b": ["x", {"y": "2", "z": "3"}], "c": {"d": ["1", "2"], "e": "f"}}]),
        ("- a\n-\n  - b\n- - c\n  - d\n", [["a", ["b"], ["c", "d"]]]),
        ("a: |\n  x\n   y\n\nb: >-\n  fold\n  ed\n\n  para\n", [{"a": "x\n y\n", "b": "fold ed\npara"}]),
        ("a: |+\n  x\n\n", [{"a": "x\n\n"}]),
        ("--- 1\n---\n...\n--- {a: b}\n", ["1", None, {"a": "b"}]),
        ("? x\n: y\n? z\n", [{"x": "y", "z": ""}]),
        ("k:\n- a\n- b\no: c # comment\n", [{"k": ["a", "b"], "o": "c"}]),
        ("p: multi\n  line text\n\n  here\n", [{"p": "multi line text\nhere"}]),
        ("k: 'it''s'\nq: \"a\\n\\u00e9 b\\\n  c\"\n", [{"k": "it's", "q": "a\n\u00e9 bc"}]),
        ("a: 1\r\nb: x y\r\n", [{"a": "1", "b": "x y"}]),
        ("", []),
    ],
)
def test_values(text, want):
    assert [plain(d) for d in parse(text)] == want


@pytest.mark.parametrize("text", ["a: b: c", "[a", '"x', "a:\n\tb: 1\n", "{a b: }]", "key: - a", "[1,,2]", "a: *", "a: 1\n b: 2\n", "%YAML 1.2\n", "- a\nb\n", '"\\q"', "&a &b c", "!e!x y", "%YAML 1.2 more\n--- a", "%YAML\n--- a", "%TAG !x\n--- a", "%TAG !a! b\n%TAG !a! c\n--- d", "k: [\n\tx]\n", "k:\n\tx\n"])
def test_rejected(text):
    with pytest.raises(YamlError):
        parse(text)


def test_depth_limits():
    assert parse("[" * 500 + "]" * 500)
    with pytest.raises(YamlError):
        parse("[" * 2000 + "]" * 2000)


def test_scalars():
    assert [resolve(t, True, None)[0] for t in ("~", "null", "yes", "TRUE", "012", "1_000", "0x10", "01.5", "5.", ".5", ".inf", "1e400", "-", "+1")] == ["null", "null", "str", "bool", "str", "num", "num", "num", "num", "num", "nonfinite", "num", "str", "num"]
    assert resolve("1", False, None)[0] == "str"
    assert number_text(*number("1.50")) == "15e-1" and number_text(*number("0x10")) == "16"
    assert len({number(t)[:3] for t in ("1", "1.0", "1e0", "0x1")}) == 1
    keys = [ordered(*number(t)[:3]) for t in ("-1e400", "-2", "-1.5", "-1", "-0.5", "0", "0.05", "0.5", "1", "1.5", "10", "9e999", "1e1000")]
    assert keys == sorted(keys)


@pytest.mark.parametrize("text", ["1: v", "a: 1\na: 2", "[.inf]", "!custom v", "&root [*root]", "*none"])
def test_outside_the_json_model(text):
    assert shred_text(text)[0]["error"]


def test_shredded_rows():
    rows = shred_text("'a/b~c': [1, {x: é}]\nbase: &b {n: 1.0}\ncopy: *b\n")
    assert [r["pointer"] for r in rows] == ["", "/a~1b~0c", "/a~1b~0c/0", "/a~1b~0c/1", "/a~1b~0c/1/x", "/base", "/base/n", "/copy", "/copy/n"]
    assert rows[0]["json"] == '{"a/b~c":[1,{"x":"é"}],"base":{"n":1.0},"copy":{"n":1.0}}' and rows[0]["subtree_end"] == 8
    assert rows[4]["span_end"] - rows[4]["span_start"] == 2  # bytes
    assert shred_text("a: 1\nb: {c: 2}")[0]["canon"] == shred_text("{b: {c: 0x2}, 'a': 1.0}")[0]["canon"]


def test_places_of_errors_and_offsets():
    row = shred_text("é: 1\nb: [\n")[0]
    assert (row["error_line"], row["error_column"], row["error_at"]) == (2, 4, 9)
    rows = shred_text("".join(f"é{k}: ü\n" for k in range(3000)))
    assert rows[-1]["span_end"] - rows[-1]["span_start"] == 2
    assert shred_text("a: {b: [1]}", False)[0]["json"] is None


def test_mapping_and_order():
    from sylva.functions.values import Mapping, compare

    m = Mapping({"a": 1, "b": 2, "c": 3, "d": 4})
    assert m.insert("b", 9) == 2 and list(m) == ["a", "b", "c", "d"]
    assert m.swap_remove("a") == 1 and list(m) == ["d", "b", "c"] and m.swap_remove("c") == 3 and m.swap_remove("z") is None
    assert m.shift_remove("d") == 4 and m.entry("l", list) == [] and list(m) == ["b", "l"]
    m.retain(lambda k, v: k == "l")
    assert m == {"l": []}
    assert compare(None, False) == -1 and compare("b", "a") == 1 and compare(1, 1.0) == 0 and compare(float("nan"), 1) is None
    assert compare({"a": 1, "b": 2}, {"a": 1, "c": 0}) == -1 and compare([1, 2], [1]) == 1
