from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sylva.functions import render, sql, values
from sylva.functions.render import Pairs, Tagged

_TEXT = st.text(alphabet=st.sampled_from("ab: #-?,[]{}'\"\\\n\t\r 01.eé~!&*|>%@`\x00\x7f\x85\u2028\ufeff😀"), max_size=12)
_VALUE = st.recursive(
    st.none() | st.booleans() | st.integers() | st.decimals(allow_nan=False, allow_infinity=False, places=3) | _TEXT,
    lambda x: st.lists(x, max_size=4) | st.dictionaries(_TEXT, x, max_size=4),
    max_leaves=12,
)


@settings(max_examples=400, deadline=None)
@given(_VALUE)
def test_rendered_values_read_back(v):
    assert values.one(render.block(v)) == v
    assert values.one(render.flow(v)) == v


@settings(max_examples=100, deadline=None)
@given(st.lists(_VALUE, min_size=1, max_size=3))
def test_streams_read_back(vs):
    assert values.documents(render.stream(vs)) == vs


def test_block_text():
    v = {"a": {"b": [1, {"c": "x", "d": [True]}, [2, 3], []]}, "t": "one\ntwo\n", "n": Decimal("1.50"), "yes": "true", "e": {}, "g": Tagged("!p", {"k": None})}
    assert render.block(v) == 'a:\n  b:\n    - 1\n    - c: x\n      d:\n        - true\n    - - 2\n      - 3\n    - []\nt: |\n  one\n  two\nn: 1.50\nyes: "true"\ne: {}\ng: !p\n  k: null\n'
    assert render.block(Pairs([([1], "x")])) == "? [1]\n: x\n"
    assert values.one("? [1]\n: x\n") == Pairs([([1], "x")])
    assert values.one("a: !p [1, !q x]") == {"a": Tagged("!p", [1, Tagged("!q", "x")])}


def test_text_helpers():
    assert render.append_document("a: 1", {"b": 2}) == "a: 1\n---\nb: 2\n"
    assert render.append_document("a: 1\r\n", [1]) == "a: 1\r\n---\r\n- 1\r\n"
    assert render.indented("a\n\nb", 2) == "  a\n\n  b" and render.continued("a\nb", 2) == "a\n  b" and render.dedented("a\n   b\n c", 2) == "a\n b\nc"
    rules = {"lowercase": "requestcount", "UPPERCASE": "REQUESTCOUNT", "snake_case": "request_count", "kebab-case": "request-count", "camelCase": "requestCount", "PascalCase": "RequestCount", "SCREAMING_SNAKE_CASE": "REQUEST_COUNT"}
    for rule, want in rules.items():
        assert render.renamed("request_count", rule) == render.renamed("RequestCount", rule) == want


def test_merge_is_deep_and_ordered():
    v = values.one("a: &a {x: 1, y: 1}\nb: &b {y: 2, z: 2}\nc:\n  d: {<<: [*a, *b], z: 9}\n")
    assert values.merged(v)["c"] == {"d": {"z": 9, "x": 1, "y": 1}}
    with pytest.raises(ValueError):
        values.merged({"<<": 1})


def test_sql(spark):
    sql.register(spark)
    spark.createDataFrame([(1, "a: [1, 0x10]\nb: *x\n"), (2, "a: &q [1, 0x10] # c\nb: *q\n"), (3, None)], "id int, t string").createOrReplaceTempView("texts")
    got = spark.sql("SELECT id, yaml_json(t), yaml_get(t, '/a/1'), yaml_test(t, '/b', '[1.0, 16]'), yaml_error(t), yaml_documents(t), yaml_patch(t, '[{op: remove, path: /b}]') FROM texts ORDER BY id").collect()
    assert got[1] == (2, '{"a":[1,16],"b":[1,16]}', "16", True, None, 1, "a: &q [1, 0x10] # c\n")
    assert got[0][1] is None and got[0][4] == "unknown anchor x" and got[2][1:] == (None,) * 6
    assert spark.sql("SELECT pointer FROM texts, LATERAL yaml_nodes(t) n WHERE id = 2 AND n.kind = 'num' ORDER BY pre").collect() == [("/a/0",), ("/a/1",), ("/b/0",), ("/b/1",)]
    assert spark.sql("SELECT array_join(transform(array_sort(collect_list(struct(k.ord, k.text))), x -> x.text), '') FROM texts, LATERAL yaml_tokens(t) k WHERE id = 2").first()[0] == "a: &q [1, 0x10] # c\nb: *q\n"
    assert spark.range(1).select(sql.to_yaml(F.struct(F.lit(1).alias("a"), F.array(F.lit("x"), F.lit("1")).alias("b")))).first()[0] == 'a: 1\nb:\n  - x\n  - "1"\n'
    assert spark.sql("SELECT yaml_format('a: {b: !t [1]}')").first()[0] == "a:\n  b: !t\n    - 1\n"
