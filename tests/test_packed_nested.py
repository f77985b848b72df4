"""Packed fields and nested records: hand-made cases, round trips, odd tables."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casemill.operators.nested import CLOSE, LIST, MASK_NEST, OBJECT, Level, NestSpec, flatten_nested, flatten_repeated, members, nested_keys, positions_of, record_triples, repeated_paths, stream
from casemill.operators.packed import explode_packed, pack, split_packed

CASES = [
    ("a; b; c", 3, ["a", "b", "c"]), ("a;b;c", None, ["a", "b", "c"]), ('"a; x"; b', 2, ["a; x", "b"]), ("a | b; c", 2, ["a", "b; c"]), ("a | b ; c", 3, ["a", "b", "c"]),
    ("March 3, 2010, x, 'April 9, 2021'", 3, ["March 3, 2010", "x", "April 9, 2021"]), ("March 3,2004/3/4,x", 3, ["March 3", "2004/3/4", "x"]), ("2010/1/2 / 3-4 weeks / he", 3, ["2010/1/2", "3-4 weeks", "he"]),
    ("['a', \"b, c\", 'd']", 3, ["a", "b, c", "d"]), ('["a\\"b", "c"]', 2, ['a"b', "c"]), ('"say ""x"""; b', 2, ['say "x"', "b"]), ("O'Tavin, x; y", 2, ["O'Tavin, x", "y"]),
    ("a; b; ", 2, ["a", "b"]), ("a; ; c", 3, ["a", None, "c"]), ('"a"; ""; "c"', 3, ["a", None, "c"]), ("; b", 2, [None, "b"]), ("AGE、SEX；DATE", 3, ["AGE", "SEX", "DATE"]), ("a\tb\nc", 3, ["a", "b", "c"]),
    ("f(x; y); z", 2, ["f(x; y)", "z"]), ("a (b; c", 2, ["a (b", "c"]), ("one", 1, ["one"]), ("", 3, []), ("   ", 3, []), (None, 3, []), ("a;b", 0, []), ('"open; b', 2, ['"open', "b"]),
]


@pytest.mark.parametrize("text, slots, values", CASES)
def test_split(text, slots, values):
    assert split_packed(text, slots) == [(i, v) for i, v in enumerate(values, 1) if v]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab ,;|\"'é漢", max_size=6).map(str.strip), min_size=2, max_size=6), st.sampled_from(["; ", "|", " | ", "\t"]))
def test_round_trip(values, delimiter):
    values = [v if not set(v) & set("'\"") else v.replace("'", "").replace('"', "").strip() for v in values]
    packed = delimiter.join('"' + v + '"' for v in values)
    if any(values):
        assert split_packed(packed, len(values)) == [(i, v) for i, v in enumerate(values, 1) if v]


def test_pack_is_the_inverse():
    values = ["a; b", 'say "x"', "plain"]
    assert [v for _, v in split_packed(pack(values), 3)] == values


def test_long_field():
    assert len(split_packed("; ".join(["w"] * 20_000), 20_000)) == 20_000


def test_explode_packed_on_odd_tables(spark):
    rows = [(1, 2, "a; b", "X; Y", "f"), (1, 2, "a | b", "X|Y", "g"), (None, 1, "z", None, "h"), (2, None, "p; q; r", "", "i"), (3, 0, None, None, "j")]
    df = spark.createDataFrame(rows, "id long, n int, t string, `k` string, pos string")
    got = {tuple(r) for r in explode_packed(df, "id", ("t", "k"), "n").collect()}
    assert got == {(1, "t", 1, "a"), (1, "t", 2, "b"), (1, "k", 1, "X"), (1, "k", 2, "Y"), (None, "t", 1, "z"), (2, "t", 1, "p"), (2, "t", 2, "q"), (2, "t", 3, "r")}
    assert explode_packed(df.limit(0), "id", ("t",), "n").count() == 0


RECORDS = [
    [{"mask_type": "A", "candidates": [{"token": "x", "rejection_reasons": ["r1", "r2"]}, {"token": "y", "rejection_reasons": "r3"}, {"token": "z", "rejection_reasons": None}, {}]}, {"mask_type": "B"}],
    {"batches": [{"masks": [{"mask_type": "A"}]}, {"masks": [{"mask_type": None, "candidates": {"token": "x"}}]}]},
    {"mask_type": "A", "candidates": None}, [], {}, [1, None, "x", {"other": 1}], [[[{"mask_type": "deep"}]]],
]
KEYS = [[(1, 0, 0), (1, 1, 0), (1, 1, 1), (1, 1, 2), (1, 2, 0), (1, 2, 1), (1, 3, 0), (1, 4, 0), (2, 0, 0)], [(1, 0, 0), (2, 0, 0), (2, 1, 0)], [(1, 0, 0)], [], [], [], [(1, 0, 0)]]


def test_nested_keys(spark):
    texts = [json.dumps(r) for r in RECORDS]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, json.dumps(texts[0])), (90, None), (91, ""), (92, "  "), (93, texts[0][:-5]), (94, '"plain"'), (95, json.dumps(texts[0][:-5])), (96, "[" * 100_000)]
    got = sorted(tuple(r) for r in nested_keys(spark.createDataFrame(rows, "id long, m string"), "id", "m").collect())
    assert got == sorted((i, *k) for i, keys in enumerate(KEYS) for k in keys)


def test_flat_tables_link_to_parents(spark):
    df = spark.createDataFrame([(7, json.dumps(RECORDS[0]), "x")], "id long, m string, value string")
    t = flatten_nested(df, ["id"], "m")
    assert [(r["id"], r["mask_pos"], r["mask_type"]) for r in t["mask"].orderBy("mask_pos").collect()] == [(7, 1, "A"), (7, 2, "B")]
    assert [(r["mask_pos"], r["candidate_pos"], r["token"]) for r in t["candidate"].orderBy("candidate_pos").collect()] == [(1, 1, "x"), (1, 2, "y"), (1, 3, "z"), (1, 4, None)]
    assert [(r["candidate_pos"], r["reason_pos"], r["value"]) for r in t["reason"].orderBy("candidate_pos", "reason_pos").collect()] == [(1, 1, "r1"), (1, 2, "r2"), (2, 1, "r3")]
    orphans = t["reason"].join(t["candidate"], ["id", "mask_pos", "candidate_pos"], "left_anti")
    assert orphans.count() == 0 and flatten_nested(df.limit(0), ["id"], "m")["mask"].count() == 0


def test_key_named_like_a_column(spark):
    df = spark.createDataFrame([("k", json.dumps(RECORDS[0]))], "token string, m string")
    out = flatten_nested(df, ["token"], "m")["candidate"]
    assert {"token", "token_"} <= set(out.columns) and out.filter(F.col("token") == "k").count() == 4


def test_other_nests(spark):
    spec = NestSpec((Level("order", marker="order_id", columns=("order_id",)), Level("line", field_name="lines", columns=("sku", "qty"))))
    df = spark.createDataFrame([(1, '{"orders":[{"order_id":5,"lines":[{"sku":"a","qty":2},{"sku":"b"}]}]}')], "id long, j string")
    assert [(r["order_pos"], r["line_pos"], r["sku"], r["qty"]) for r in flatten_nested(df, ["id"], "j", spec)["line"].orderBy("line_pos").collect()] == [(1, 1, "a", "2"), (1, 2, "b", None)]
    assert len(MASK_NEST.levels) == 3


def test_no_field_is_lost(spark):
    record = {"version": 3, "tags": ["a", "b"], "batches": [{"batch": 7, "masks": [{"mask_type": "A", "classification": {"pos": "ADV", "flags": {"protected": True}}, "extra": {"deep": [1, {"x": 2}]}, "candidates": [{"token": "t", "rank": 4, "rejection_reasons": [{"code": 9}]}]}]}]}
    t = flatten_nested(spark.createDataFrame([(7, json.dumps(record))], "id long, m string"), ["id"], "m")
    mask = t["mask"].first()
    assert (mask["classification_pos"], mask["classification_flags_protected"], mask["path"], mask["ordinals"]) == ("ADV", "true", "batches[].masks[]", [1, 1]) and mask["more"] == {"extra.deep[]": "[1]", "extra.deep[].x": "[2]"}
    assert t["candidate"].first()["more"] == {"rank": "4"} and t["reason"].first()["more"] == {"code": "9"}
    assert {(r["path"], tuple(r["ordinals"]), tuple(sorted(r["more"].items()))) for r in t["envelope"].collect()} == {("", (), (("version", "3"),)), ("tags[]", (1,), (("value", "a"),)), ("tags[]", (2,), (("value", "b"),)), ("batches[]", (1,), (("batch", "7"),))}


def test_repeated_ancestors_are_found_in_the_data(spark):
    df = spark.createDataFrame([(1, '{"o":[{"n":5,"l":[{"sku":"a","q":2},{"sku":"b"}]}]}'), (2, '{"o":[],"id":"z"}'), (3, "{"), (4, None)], "id long, j string")
    assert {(r["ancestor"], r["field"], r["members"]) for r in repeated_paths(df, "j").collect()} == {("", None, 1), ("", "id", 1), ("o[]", "n", 1), ("o[].l[]", "sku", 2), ("o[].l[]", "q", 1)}
    t = flatten_repeated(df, ["id"], "j")
    assert sorted(t) == ["", "o[]", "o[].l[]"] and [tuple(r) for r in t[""].orderBy("id").collect()] == [(1, [], None), (2, [], "z")]
    assert [tuple(r) for r in t["o[].l[]"].orderBy("ordinals").collect()] == [(1, [1, 1], "2", "a"), (1, [1, 2], None, "b")]
    assert flatten_repeated(df.limit(0), ["id"], "j") == {}


def test_stream_takes_what_is_complete_and_nothing_else():
    good = ["[]", "{}", " [1, -2.5e3 ,null,true,{\"a\":[[]]}] ", '"x"', "0", '{"a":"\\u00e9\\n"}', "[NaN,-Infinity]", "[" * 50_000 + "1" + "]" * 50_000]
    bad = ["", " ", "[", "[1,]", "{,}", '{"a"}', '{"a":1,}', "[1 2]", "01", "[1]x", "tru", "nullx", '"a', '"\\x"', "{1:2}", "]", "[}", "1.", "[" * 50_000]
    assert [t[:9] for t in good if record_triples(t) is None and not t.startswith(('"', "0"))] == [] and [t[:9] for t in bad if record_triples(t) is not None] == []
    assert [(p.text, positions_of(o), v) for p, o, v in stream('{"a":[{"b":1},2]}')] == [("", (), OBJECT), ("a", (), LIST), ("a[]", (1,), OBJECT), ("a[].b", (1,), 1), ("a[]", (1,), CLOSE), ("a[]", (2,), 2), ("a", (), CLOSE), ("", (), CLOSE)]
    assert len(list(members(good[-1]))) == 1
