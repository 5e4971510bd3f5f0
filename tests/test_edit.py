import pytest
from pyspark.sql import functions as F

from sylva.functions.yaml import YamlError
from sylva.operators import command, edit

GARDEN = "plot: north # sunny\nrows:\n  - beans\n  - peas\nsoil: {ph: 6.5, mix: [loam, sand]}\ncare:\n  water: 'daily'\n"


@pytest.mark.parametrize(
    "change, old, new",
    [
        (lambda t: edit.replace(t, "/plot", '"south"'), "north", "south"),
        (lambda t: edit.replace(t, "/care/water", "weekly"), "'daily'", "'weekly'"),
        (lambda t: edit.replace(t, "/care/water", "3"), "'daily'", "3"),
        (lambda t: edit.replace(t, "/rows", "[]"), "rows:\n  - beans\n  - peas", "rows: []"),
        (lambda t: edit.remove(t, "/rows/1"), "  - peas\n", ""),
        (lambda t: edit.remove(t, "/soil/ph"), "ph: 6.5, ", ""),
        (lambda t: edit.remove(t, "/care/water"), "care:\n  water: 'daily'", "care: {}"),
        (lambda t: edit.add(t, "/rows/0", "{leek: 2}"), "  - beans", "  - {leek: 2}\n  - beans"),
        (lambda t: edit.add(t, "/care/mulch", "straw", comment="in May\nand June", before="water"), "  water", "  # in May\n  # and June\n  mulch: straw\n  water"),
        (lambda t: edit.rename_key(t, "/plot", "null"), "plot", '"null"'),
        (lambda t: edit.copy(t, "/soil/mix", "/care/bed"), "'daily'\n", "'daily'\n  bed: [loam, sand]\n"),
        (lambda t: edit.set_scalar(t, "/care/water", "it's"), "'daily'", "'it''s'"),
        (lambda t: edit.replace_text(t, "/soil", "clay"), "{ph: 6.5, mix: [loam, sand]}", "clay"),
        (lambda t: edit.add_value(t, "/soil/deep", [True, None]), "sand]}", "sand], deep: [true, null]}"),
        (lambda t: edit.remove(t, "/none", missing=True), "", ""),
    ],
)
def test_only_the_place_changes(change, old, new):
    assert change(GARDEN) == GARDEN.replace(old, new, 1)


@pytest.mark.parametrize(
    "text, op, want",
    [
        ("? x\n: 1\n? y\n: 2\n", {"op": "remove", "path": "/y"}, "? x\n: 1\n"),
        ("? x\n: 1\n? y\n: 2\n", {"op": "remove", "path": "/x"}, "? y\n: 2\n"),
        ("z: &s {q: 1}\n", {"op": "move", "from": "/z", "path": "/w"}, "{w: &s {q: 1}}\n"),
        ("v: 0\nz: &s {q: 1}\n", {"op": "move", "from": "/z", "path": "/w"}, "v: 0\nw: &s {q: 1}\n"),
        ("z: &s {q: 1}\ny: *s\n", {"op": "move", "from": "/z", "path": "/w"}, None),
        ("z: &s {q: 1}\ny: *s\n", {"op": "remove", "path": "/z"}, None),
        ("z: &s {q: 1}\ny: 0\n", {"op": "copy", "from": "/z", "path": "/w"}, None),
        ("z: &s {q: 1}\ny: *s\n", {"op": "remove", "path": "/y"}, "z: &s {q: 1}\n"),
        ("z: [&s 1, 2]\ny: *s\n", {"op": "replace", "path": "/z", "value": "0"}, None),
        ("&s key: 1\nuse: *s\n", {"op": "rename-key", "path": "/key", "value": "lock"}, "&s lock: 1\nuse: *s\n"),
        ('"key": 1\n', {"op": "rename-key", "path": "/key", "value": "a b"}, '"a b": 1\n'),
        ("t: 1\nt: 2\n", {"op": "replace", "path": "/t", "value": "3"}, None),
        ("5: five\n", {"op": "replace", "path": "/5", "value": "3"}, None),
        ("g: 1\r\nh: 2\r\n", {"op": "add", "path": "/i", "value": "3"}, "g: 1\r\nh: 2\r\ni: 3\r\n"),
        ("f: [\n    one, # 1\n    two,\n]\n", {"op": "add", "path": "/f/-", "value": "six"}, "f: [\n    one, # 1\n    two,\n    six,\n]\n"),
        ("f: [\n    one,\n    two\n]\n", {"op": "add", "path": "/f/0", "value": "zero"}, "f: [\n    zero,\n    one,\n    two\n]\n"),
        ("f: [\n    one,\n    two\n]\n", {"op": "remove", "path": "/f/1"}, "f: [\n    one\n]\n"),
        ("m: 0x1F\nn: {}\n", {"op": "copy", "from": "/m", "path": "/n/o"}, "m: 0x1F\nn: {o: 0x1F}\n"),
        ("m: &a 1\n", {"op": "add", "path": "/n", "value": "[&a 2, &a_1 3, *a]"}, "m: &a 1\nn: [&a_2 2, &a_1 3, *a_2]\n"),
        ("", {"op": "add", "path": "", "value": "1"}, None),
        ("---\n", {"op": "replace", "path": "", "value": "1"}, "---\n1"),
    ],
)
def test_hard_places(text, op, want):
    if want is not None:
        assert edit.apply(text, [op]) == want
        return
    with pytest.raises(edit.FAILURES):
        edit.apply(text, [op])


def test_declared_order():
    assert edit.add_in_order("first: 1\nthird: 3\n", "/second", "2", ["first", "second", "third"]) == "first: 1\nsecond: 2\nthird: 3\n"
    assert edit.add_in_order("first: 1\n", "/other", "2", ["first", "second"]) == "first: 1\nother: 2\n"


def test_move_and_documents():
    assert edit.move("left: 4\nright: []\n", "/left", "/right/-") == "right: [4]\n"
    assert edit.rename_key("k: 1\n--- # two\nk: 2\n", "/k", "kk", 1) == "k: 1\n--- # two\nkk: 2\n"
    with pytest.raises(edit.EditError):
        edit.move(GARDEN, "/care", "/care/water")
    assert edit.is_prefix("/a", "/a/b") and not edit.is_prefix("/a", "/ab") and not edit.is_prefix("/a", "/a")


def test_patches():
    ops = edit.read_patch("- {op: test, path: /soil/ph, value: 65e-1}\n- {op: add, path: /rows/-, value: kale}\n- {op: remove, path: /care}")
    assert edit.apply(GARDEN, ops) == GARDEN.replace("  - peas\n", "  - peas\n  - kale\n").replace("care:\n  water: 'daily'\n", "")
    for bad in ("{}", "[1]", "[{op: add, path: /a}]", "[{op: grow, path: /a}]", "[{op: remove, op: remove, path: /a}]", "[{op: remove, path: a}]", "[{op: move, path: /a}]", "[{op: remove, path: 1}]"):
        with pytest.raises(edit.FAILURES):
            edit.read_patch(bad)
    with pytest.raises(YamlError):
        edit.apply(GARDEN, [{"op": "replace", "path": "/plot", "value": "{"}])


def test_directives():
    assert edit.set_directive("a: 1\n", "YAML", "1.2") == "%YAML 1.2\n---\na: 1\n"
    assert edit.set_directive("%YAML 1.1 # old\n---\na: 1\n", "YAML", "1.2") == "%YAML 1.2 # old\n---\na: 1\n"
    assert edit.set_directive("%YAML 1.2\n---\na: 1\n", "TAG", "!m! tag:m,1:") == "%TAG !m! tag:m,1:\n%YAML 1.2\n---\na: 1\n"
    assert edit.remove_directive("%TAG !m! x\n%YAML 1.2\n---\na\n", "TAG", "!m!") == "%YAML 1.2\n---\na\n"
    assert edit.remove_directive("a\n", "YAML") == "a\n"
    with pytest.raises(edit.EditError):
        edit.set_directive("a", "YAML", "one")


def test_queue():
    q = edit.Queue("k: 1\nl: 2\n")
    q.put(3, 4, "9")
    q.put(5, 5, "x: 0\n")
    q.put(5, 5, "y: 0\n")
    for span in ((2, 4), (3, 4), (4, 99)):
        with pytest.raises(edit.EditError):
            q.put(*span, "")
    assert q.commit() == "k: 9\nx: 0\ny: 0\nl: 2\n"


def test_equality_follows_aliases():
    assert edit.test("o: &w {n: 10, m: x}\np: *w\n", "/p", '{"m": "x", n: 0xA}')
    assert not edit.test("o: '10'\n", "/o", "10")


def test_commands_by_alias_routes():
    t = "o: &w {n: 1}\np: *w\nq: {n: 1}\n"
    assert command.execute(t, "rename-key", query="$.*.n", value="m")[:2] == (True, "o: &w {m: 1}\np: *w\nq: {m: 1}\n")
    assert command.execute(t, "remove", query="$.p")[1] == "o: &w {n: 1}\nq: {n: 1}\n"
    assert command.execute(t, "query", query="$.q")[2:4] == ('"/q": {"n":1}\n', ["/q"])
    assert command.execute("a: [\n", "query", query="$")[4].endswith("1:4")
    assert command.execute("e: 1\n---\ne: {f: 2}\n", "get", query="$.e")[2] == "---\n1\n---\n{f: 2}\n"


def test_columns_keep_failures_to_their_rows(spark):
    rows = [(1, "a: 1\n"), (2, "["), (3, None), (4, "? a\n: 1\n? b\n: 2\n"), (5, "a: 1\na: 2\n"), (6, "%YAML 1 2\n---\na: 1"), (7, "a:\n\tb: 1\n"), (8, "[" * 3000)]
    d = spark.createDataFrame(rows, "k int, t string")
    got = {r.k: r.e for r in d.select("k", edit.edited(F.col("t"), [{"op": "replace", "path": "/a", "value": "7"}]).alias("e")).collect()}
    assert {k for k, e in got.items() if e.ok} == {1, 4} and got[4].text == "? a\n: 7\n? b\n: 2\n"
    assert all(got[k].text == t and got[k].error for k, t in rows if k not in (1, 4))
