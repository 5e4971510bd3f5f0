import pytest
from pyspark.sql import types as T

from sylva.functions import values
from sylva.operators import bind

SERVER = T.StructType([T.StructField("host", T.StringType(), False), T.StructField("port", T.IntegerType(), True, {"yaml": {"default": 80}})])
MODE = T.StructType([T.StructField("variant", T.StringType(), True, {"yaml": {"units": ["fast", "slow"]}}), T.StructField("limit", T.LongType()), T.StructField("server", SERVER)])
CONFIG = T.StructType(
    [
        T.StructField("timeoutSeconds", T.IntegerType(), False, {"yaml": {"alias": ["timeout"]}}),
        T.StructField("servers", T.ArrayType(SERVER)),
        T.StructField("mode", MODE, True, {"yaml": {"enum": True}}),
        T.StructField("common", T.StructType([T.StructField("note", T.StringType())]), True, {"yaml": {"flatten": True}}),
        T.StructField("other", T.MapType(T.StringType(), T.LongType()), True, {"yaml": {"rest": True}}),
    ]
)
TEXT = "# head\ntimeout-seconds: 5 # s\nservers:\n  - host: a\n    port: 1\n  - {host: b}\nmode: !limit 9\nnote: 'x'\nq: 1\n"


def test_bind_and_back():
    got = bind.bind(values.one(TEXT), CONFIG, "", "kebab-case")
    assert got == {"timeoutSeconds": 5, "servers": [{"host": "a", "port": 1}, {"host": "b", "port": 80}], "mode": {"variant": "limit", "limit": 9, "server": None}, "common": {"note": "x"}, "other": {"q": 1}}
    assert bind.bind(bind.unbind(got, CONFIG, "kebab-case"), CONFIG, "", "kebab-case") == got
    assert bind.bind({"timeout": 1, "mode": "slow"}, CONFIG, "", "kebab-case")["mode"]["variant"] == "slow"


@pytest.mark.parametrize("text, where", [("{}", "/timeout-seconds"), ("timeout: x", "/timeout"), ("timeout: 3000000000", "/timeout"), ("timeout: 1\nservers: [{}]", "/servers/0/host"), ("timeout: 1\nmode: none", "/mode"), ("timeout: 1\nmode: !none 1", "/mode"), ("timeout: 1\nz: a", "/z"), ("[]", "/")])
def test_errors_name_the_place(text, where):
    with pytest.raises(bind.BindError) as e:
        bind.bind(values.one(text), CONFIG, "", "kebab-case")
    assert str(e.value).startswith(where + ":")


def test_overlay_touches_only_what_differs():
    assert bind.overlay(TEXT, values.one(TEXT)) == TEXT
    new = values.one(TEXT) | {"timeout-seconds": 6, "z": [1]}
    new["servers"] = [{"host": "a", "port": 2}]
    assert bind.overlay(TEXT, new) == TEXT.replace("5 # s", "6 # s").replace("port: 1", "port: 2").replace("  - {host: b}\n", "") + "z: [1]\n"
    assert bind.overlay("a: 1\nb: 2 # c\n", {"b": 2}, prune=True) == "b: 2 # c\n"
    assert bind.overlay("", {"a": {"b": 1}}) == "a:\n  b: 1\n"


def test_columns(spark):
    df = spark.createDataFrame([(1, TEXT), (2, "[]"), (3, None)], "id int, t string")
    got = df.select("id", bind.read(df.t, CONFIG, "kebab-case").alias("r")).orderBy("id")
    rows = [r.r.asDict(True) for r in got.collect()]
    assert rows[0]["value"]["servers"][1] == {"host": "b", "port": 80} and rows[0]["value"]["mode"]["limit"] == 9
    assert [r["ok"] for r in rows] == [True, False, False]
    back = df.where("id = 1").select("t", bind.read(df.t, CONFIG, "kebab-case").alias("r"))
    text = back.select(bind.write(back.t, back.r.value, CONFIG, "kebab-case").alias("w")).first()["w"]
    assert text.ok and text.text == TEXT.replace("{host: b}", "{host: b, port: 80}")


def test_skip_comment_order_newtype_and_codecs():
    bind.register_codec("celsius", lambda v: float(str(v).rstrip("C")), lambda v: f"{v:g}C")
    one = T.StructType([T.StructField("n", T.LongType())])
    own = T.StructType([T.StructField("id", one, True, {"yaml": {"newtype": True}}), T.StructField("heat", T.DoubleType(), True, {"yaml": {"with": "celsius", "comment": "at noon"}}), T.StructField("tmp", T.LongType(), True, {"yaml": {"skip": True, "default": 3}}), T.StructField("last", T.StringType())])
    got = bind.bind(values.one("id: 4\nheat: 21.5C\ntmp: 9\n"), own)
    assert got == {"id": {"n": 4}, "heat": 21.5, "tmp": 3, "last": None}
    assert bind.unbind(got, own) == {"id": 4, "heat": "21.5C"}
    plan = bind.layout(own)
    assert bind.overlay("id: 4\nlast: z\n", {"heat": "3C"}, plan=plan) == "id: 4\n# at noon\nheat: \"3C\"\nlast: z\n"
    with pytest.raises(bind.BindError):
        bind.bind({"heat": "warm"}, own)
