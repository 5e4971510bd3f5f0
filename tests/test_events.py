import pytest

from sylva.functions.yaml import YamlError, parse
from sylva.operators import events

TEXT = '%YAML 1.2\n%TAG !e! tag:e,2000: # note\n---\n# head\n&m map: !e!x "v\\n"\n? k\n: [a, {b: c}, *m]\nfold: >-\n  one\n  two\n...\n---\n- \'é\'\n'


def test_event_notation():
    want = ["+STR", "+DOC ---", "+MAP", "=VAL &m :map", '=VAL <tag:e,2000:x> "v\\n', "=VAL :k", "+SEQ []", "=VAL :a", "+MAP {}", "=VAL :b", "=VAL :c", "-MAP", "=ALI *m", "-SEQ", "=VAL :fold", "=VAL >one two", "-MAP", "-DOC ...", "+DOC ---", "+SEQ", "=VAL 'é", "-SEQ", "-DOC", "-STR"]
    assert events.event_text(TEXT).splitlines() == want


@pytest.mark.parametrize("text", [TEXT, "", "a: b", "﻿a: 1\r\nb: 2\r\n", "- &x !!str a # c\n- *x\n", "[a, &q b, !t c]", "--- |\n x\n", "{? a : b, 'c': d}\n"])
def test_tokens_join_to_the_source(text):
    rows = events.token_rows(text)
    assert "".join(r[2] for r in rows) == text
    assert [r[3] for r in rows[1:]] == [r[4] for r in rows[:-1]]
    assert not [r for r in rows if r[1] == "other"]


def test_directives_and_characters():
    assert [(r[0], r[2], r[3]) for r in events.directive_rows(TEXT)] == [(0, "YAML", ["1.2"]), (0, "TAG", ["!e!", "tag:e,2000:"])]
    for bad in ("a: \x01", "%YAML 1.2\n%YAML 1.2\n---\na"):
        with pytest.raises(YamlError):
            parse(bad)


def test_tables(spark):
    texts = spark.createDataFrame([(1, TEXT), (2, "["), (3, None)], "id long, t string")
    got = events.events(texts, "id", "t", "PERMISSIVE")
    assert got.groupBy("doc_key").count().orderBy("doc_key").collect() == [(1, 24), (2, 1), (3, 2)]
    assert got.where("error is not null").select("doc_key").collect() == [(2,)]
    again = {r[0]: r[1] for r in events.tokens_text(events.tokens(texts, "id", "t", "DROPMALFORMED")).collect()}
    assert again == {1: TEXT}
    assert events.directives(texts, "id", "t", "DROPMALFORMED").count() == 2
    assert [r[0] for r in texts.select(events.valid_source(texts.t)).collect()] == [True, True, None]
