import io
import os

import pytest

from sylva import cli
from sylva.operators import command, edit


@pytest.fixture
def shelf(tmp_path):
    for d in ("maps", "maps/.old"):
        (tmp_path / d).mkdir()
    (tmp_path / "index.yml").write_text("sheets: [7, 8, 9]  # printed\nscale: 50\n")
    (tmp_path / "maps" / "coast.YML").write_text("scale: 10\nlegend:\n  reef: red\n  sand:\n    - dry\n")
    (tmp_path / "maps" / ".old" / "bay.yaml").write_text("scale: 25\n")
    (tmp_path / "maps" / "notes.txt").write_text("scale: 1\n")
    os.symlink(tmp_path / "index.yml", tmp_path / "maps" / "same.yaml")
    return tmp_path


def call(spark, *args, stdin=""):
    out, err = io.StringIO(), io.StringIO()
    code = cli.run([str(a) for a in args], io.StringIO(stdin), out, err, spark)
    return code, out.getvalue(), err.getvalue()


def test_places():
    assert command.places(["/s/3", "/s/11", "/s/3", "/s/3/t", "/u"]) == ["/s/11", "/s/3", "/u"]
    assert edit.extract("legend:\n  reef: red\n  sand:\n    - dry\n", "/legend") == "reef: red\nsand:\n  - dry"


def test_folder(spark, shelf):
    code, out, err = call(spark, "query", shelf, "--query", "$.scale")
    assert (code, err) == (0, "3 files done, 0 failed\n")
    assert out == '==> index.yml <==\n"/scale": 50\n\n==> maps/.old/bay.yaml <==\n"/scale": 25\n\n==> maps/coast.YML <==\n"/scale": 10\n'
    assert call(spark, "get", shelf, "--query", "$.legend.*")[1] == "==> maps/coast.YML <==\n---\nred\n---\n- dry\n"
    (shelf / "torn.yaml").write_text("a: 'b\n")
    code, _, err = call(spark, "set", shelf, "--pointer", "/scale", "--value", "wide", "--in-place")
    assert code == 1 and "torn.yaml: unterminated quoted scalar at 1:4" in err and "3 files done, 1 failed" in err
    assert (shelf / "index.yml").read_text() == "sheets: [7, 8, 9]  # printed\nscale: wide\n" and (shelf / "torn.yaml").read_text() == "a: 'b\n"
    assert not [n for _, _, names in os.walk(shelf) for n in names if n.startswith(".write-")]


def test_one_file_and_standard_input(spark, shelf):
    i = shelf / "index.yml"
    assert call(spark, "remove", i, "--query", "$.sheets[1,-1,1]")[:2] == (0, "sheets: [7]  # printed\nscale: 50\n")
    assert call(spark, "get", shelf / "maps" / "coast.YML", "--pointer", "/legend")[:2] == (0, "reef: red\nsand:\n  - dry\n")
    two = "c: 1\n---\nc: 2\n"
    assert call(spark, "rename-key", "-", "--pointer", "/c", "--value", "~", "--doc", "1", stdin=two)[:2] == (0, 'c: 1\n---\n"~": 2\n')
    assert call(spark, "get", "-", "--pointer", "/c", stdin=two)[0] == 1
    assert call(spark, "test", i, "--query", "$.scale", "--value", "5e1")[0] == 0
    assert call(spark, "test", i, "--query", "$.nowhere", "--value", "1")[0] == 1
    assert call(spark, "patch", i, "--patch", "[{op: add, path: /seen, value: {by: me}}]")[1].endswith("scale: 50\nseen: {by: me}\n")
    for wrong in (("replace", i, "--pointer", "/scale", "--value", "1", "--output", i), ("replace", i, "--pointer", "/scale"), ("add", i, "--query", "$.scale", "--value", "1"), ("query", i)):
        assert call(spark, *wrong)[0] == 2
    assert call(spark, "remove", i, "--pointer", "/scale", "--output", shelf / "out.txt")[:2] == (0, "") and (shelf / "out.txt").read_text() == "sheets: [7, 8, 9]  # printed\n"
