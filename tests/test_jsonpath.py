import pytest
from pyspark.sql import types as T

from sylva.operators import typed
from sylva.operators.shred import errors, shred
from sylva.plans import jsonpath, local
from sylva.sources.texts import read_texts, sections
from sylva.streaming.stream import stream_pointer, stream_table

FLEET = "ships:\n- {name: Alba, crew: 12, ports: [x, y, z]}\n- {name: Bora, crew: 25e-1, steam: true}\n- {name: \"Cirrus\", crew: 0, like: '('}\n"
DEPTHS = "sounding: &s {name: deep}\nagain: *s\nmetres: [7, 0x8, 9, 10, 11]\n"


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(1, FLEET), (2, DEPTHS), (3, ""), (4, "---\n")], "k int, t string").cache()


@pytest.fixture(scope="module")
def nodes(texts):
    return shred(texts, "k", "t").cache()


PATHS = [
    ("$.ships[*].name", ["/ships/0/name", "/ships/1/name", "/ships/2/name"]),
    ("$.ships[?@.crew > 2].name", ["/ships/0/name", "/ships/1/name"]),
    ("$.ships[?2.5 >= @.crew && !@.like].name", ["/ships/1/name"]),
    ("$.ships[?@.steam || @.crew == 0].name", ["/ships/1/name", "/ships/2/name"]),
    ("$.ships[?@.mast != @.sail].name", []),
    ("$..name", ["/ships/0/name", "/ships/1/name", "/ships/2/name", "/sounding/name", "/again/name"]),
    ("$.metres[::-2]", ["/metres/4", "/metres/2", "/metres/0"]),
    ("$.metres[-2:]", ["/metres/3", "/metres/4"]),
    ("$.metres[3:1:-1]", ["/metres/3", "/metres/2"]),
    ("$.metres[::0]", []),
    ("$.metres[9]", []),
    ("$.metres[1,-1,1]", ["/metres/1", "/metres/4", "/metres/1"]),
    ("$['again',\"sounding\"].name", ["/again/name", "/sounding/name"]),
    ("$.ships[?match(@.name,'.o.*')].crew", ["/ships/1/crew"]),
    ("$.ships[?search(@.name,'rr')].crew", ["/ships/2/crew"]),
    ("$.ships[?search(@.name, @.like)].crew", []),
    ("$.ships[?length(@.ports)==3].name", ["/ships/0/name"]),
    ("$.ships[?length(@.name)==6].name", ["/ships/2/name"]),
    ("$.ships[?count(@.*)==3].name", ["/ships/0/name", "/ships/1/name", "/ships/2/name"]),
    ("$.ships[?value(@..steam)==true].name", ["/ships/1/name"]),
    ("$.ships[?@.crew==$.ships[0].crew].name", ["/ships/0/name"]),
    ("$.ships[?@.ports == $.ships[0].ports].name", ["/ships/0/name"]),
    ("$.ships[?@.steam <= true].name", ["/ships/1/name"]),
    ("$.ships[?@.name < 'B'].name", ["/ships/0/name"]),
    ("$", ["", "", ""]),
]


@pytest.mark.parametrize("path, want", PATHS)
def test_in_each_text(path, want):
    """The evaluator that runs where texts are read."""
    got = [p for t in (FLEET, DEPTHS, "", "---\n") for root in local.documents(t) for _, p in local.evaluate(jsonpath.parse(path), root)]
    assert got == want


@pytest.mark.parametrize("path, want", PATHS[1::3])
def test_over_the_node_table(nodes, path, want):
    got = sorted(jsonpath.query(nodes, path).collect(), key=lambda r: (r.doc_key, r["rank"]))
    assert [r.pointer for r in got] == want


def test_both_plans_agree(texts, nodes):
    cols = "doc_key", "doc_ix", "pointer", "kind", "text", "num", "json", "canon"
    for path in ("$..*", "$.ships[?@.crew]"):
        a = jsonpath.query(nodes, path).select(*cols).collect()
        b = jsonpath.query_texts(texts, "k", "t", path).select(*cols).collect()
        assert sorted(map(str, a)) == sorted(map(str, b)) and a


@pytest.mark.parametrize("path", ["", "x", "$.", "$..", "$[", "$[007]", "$[-0]", "$[?@.x==@..y]", "$[?size(@)]", "$[?length(@..x)==1]", "$[?count('x')==1]", "$[?search(@.x,'[')]", "$['\u0007']", "$ ", "$[?@.x<1<2]", "$[?value(@.x)]", "$[?match(@.x,'a') == true]"])
def test_rejected(path):
    with pytest.raises(jsonpath.JsonPathError):
        jsonpath.parse(path)


def test_modes(spark):
    d = spark.createDataFrame([(1, "q: 1"), (2, "{"), (3, None)], "k int, t string")
    assert [(r.doc_key, r.error_line, r.error_column) for r in errors(shred(d, "k", "t", "PERMISSIVE")).collect()] == [(2, 1, 1)]
    assert {r.doc_key for r in shred(d, "k", "t", "DROPMALFORMED").collect()} == {1}
    assert {r.doc_key: r.error is None for r in jsonpath.query_texts(d, "k", "t", "$.q", ("text",), "PERMISSIVE").collect()} == {1: True, 2: False}
    assert jsonpath.query_texts(d, "k", "t", "$.q", ("text",), "DROPMALFORMED").columns == ["doc_key", "doc_ix", "text"]
    with pytest.raises(Exception):
        jsonpath.query_texts(d, "k", "t", "$.q").collect()


def test_plans_without_joins(nodes, texts, capsys):
    jsonpath.query(nodes, "$.ships").explain()
    jsonpath.query_texts(texts, "k", "t", "$.ships[?@.crew > 1]..name").explain()
    out = capsys.readouterr().out
    assert "Join" not in out and "Exchange" not in out.split("MapInArrow")[-1]


def test_typed_and_merge(spark):
    n = shred(spark.createDataFrame([(1, "size: '70'\nunit: m\ngone: ~\n"), (2, "x: &x {u: 1, v: 1}\ny: &y {v: 2, w: 2}\nz:\n  <<: [*x, *y]\n  u: 0\n")], "k int, t string"), "k", "t")
    f = T.StructType([T.StructField("size", T.IntegerType()), T.StructField("unit", T.StringType()), T.StructField("gone", T.LongType())])
    assert [tuple(r)[2:] for r in typed.read_fields(n.where("doc_key = 1"), f).collect()] == [(70, "m", None)]
    assert {r.key: r.json for r in typed.merged_members(n, "/z").collect()} == {"u": "0", "v": "1", "w": "2"}


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "p: 1"), (2, "{"), (3, "p: [2]")], "k int, t string").write.parquet(str(tmp_path / "in"))
    q = stream_pointer(stream_table(spark, str(tmp_path / "in"), "k int, t string"), "k", "t", "/p").writeStream.format("memory").queryName("seen").start()
    q.processAllAvailable()
    q.stop()
    assert {r.doc_key: r.json for r in spark.table("seen").collect()} == {1: "1", 3: "[2]"}


def test_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "one.yml").write_bytes(b"v: 1\r\n")
    (tmp_path / "deep" / "two.Yaml").write_text("v: 2\n")
    (tmp_path / "three.txt").write_text("v: 3\n")
    found = read_texts(spark, str(tmp_path))
    assert sorted(r.text for r in found.collect()) == ["v: 1\r\n", "v: 2\n"]
    assert sorted(r.body for r in sections(jsonpath.query_texts(found, "path", "text", "$.v")).collect()) == ["1", "2"]
