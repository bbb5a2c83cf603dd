"""Node tables: member order, repeated names, lone surrogates, rebuilding, what is refused."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.operators import json_nodes as N

VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=20)


def _joined(nodes):
    return "".join(("," if o else "") + (f'"{k}":' if k is not None else "") + raw + after for _, _, o, k, _, _, raw, after in nodes)


@settings(max_examples=150, deadline=None)
@given(VALUES, st.booleans())
def test_nodes_rebuild_the_text(value, ascii_):
    nodes = N.scan(json.dumps(value, ensure_ascii=ascii_, indent=1))
    assert _joined(nodes) == json.dumps(value, ensure_ascii=ascii_, separators=(",", ":"))
    assert [n[0] for n in nodes] == list(range(len(nodes)))
    assert all(n[1] < n[0] for n in nodes[1:]) and sum(n[5] for n in nodes) == len(nodes) - 1


def test_what_is_refused():
    for text in ("", " ", "01", "+1", "1.", ".5", "1e", "nul", "[1,]", "[,1]", '{"a"}', '{"a":}', '{"a":1,}', "{1:2}", "[1 2]", "[1]]", "[}", '"\n"', '"\\x"', '"\\u12"', "'a'", "[1}", "1 2", "NaN", '{"a":1]', "]", " 1", "[" * 257 + "]" * 257):
        assert N.scan(text) is None, text
    assert len(N.scan("[" * 256 + "]" * 256)) == 256 and N.scan(" \r\n\t-0.5e+7 ")[0][6] == "-0.5e+7"


def test_repeated_names_and_surrogates(spark):
    rows = [(1, '{"a":1,"b":{"a":2},"a":[true,null],"\\ud800":"x\\udc00\\n"}'), (2, "broken"), (3, None), (None, "[]"), (4, ' "é" ')]
    df = spark.createDataFrame(rows, "id bigint, body string")
    table = N.nodes(df, "id", "body")
    got = {(r.id, r.n): r for r in table.collect()}
    assert {k[0] for k in got} == {1, 4, None} and [got[1, n].key for n in range(8)] == [None, "a", "b", "a", "a", None, None, "\\ud800"]
    assert [(r["rank"], r.kind, r.size, r.ordinal) for r in N.members(table, "id", "a").orderBy("rank").collect()] == [(1, "number", 0, 0), (2, "array", 2, 2)]
    text = {r.id: r.text for r in N.rebuilt(table, "id").collect()}
    assert text == {1: rows[0][1], None: "[]", 4: '"é"'}
    raw = table.where("id = 1 and n = 7").selectExpr("key", "substring(raw, 2, length(raw) - 2) AS raw")
    r = raw.select(N.string_bytes(raw["key"]).alias("k"), N.string_bytes(raw["raw"]).alias("v")).first()
    assert bytes(r.k) == b"\xed\xa0\x80" and bytes(r.v) == b"x\xed\xb0\x80\n"
    assert N.nodes(df.where("false"), "id", "body").count() == 0
