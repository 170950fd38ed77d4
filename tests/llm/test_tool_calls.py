"""Tool-call linking: order, validation and joins against plain Python."""

import json
import random

import duckdb

from skyroll.llm import tool_calls
from skyroll.llm.tool_calls import link_tool_calls

CALLS = "conv_id long, turn long, index int, call_id string, tool string, arguments string, level int"
RESULTS = "conv_id long, turn long, call_id string, content string, status string"


def link(spark, calls, results=()):
    """Rows by (conv_id, call_id); the tables have columns named like the result's."""
    got = link_tool_calls(
        spark.createDataFrame([(*c, 7) for c in calls], CALLS),
        spark.createDataFrame([(*r, "x") for r in results], RESULTS)).collect()
    assert len({(r.conv_id, r.call_id) for r in got}) == len(got)
    return {(r.conv_id, r.call_id): r for r in got}


def lookup(after=None, **more):
    return json.dumps({"key": "k", **({"after": after} if after is not None else {}), **more})


def test_long_chain_in_few_rounds(spark, monkeypatch):
    made = []
    keep = tool_calls.saved
    monkeypatch.setattr(tool_calls, "saved", lambda df, name: made.append(name) or keep(df, name))
    n = 1000
    calls = [(1, i, 0, f"c{i}", "lookup", lookup(f"c{i - 1}" if i else None)) for i in range(n)]
    random.Random(1).shuffle(calls)
    got = link(spark, calls)
    assert {k: r.level for k, r in got.items()} == {(1, f"c{i}"): i for i in range(n)}
    assert sum(x.startswith("call-jumps") for x in made) <= 13


def test_random_forests_with_cycles(spark):
    r = random.Random(4)
    calls, dep = [], {}
    for conv in range(12):
        for i in range(40):
            after = r.choice([None, f"c{r.randrange(40)}", f"c{r.randrange(40)}"])
            dep[conv, f"c{i}"] = after
            calls.append((conv, i, 0, f"c{i}", "lookup", lookup(after)))

    def level(conv, call):
        seen = set()
        while dep[conv, call] is not None:
            if call in seen:
                return None
            seen.add(call)
            call = dep[conv, call]
        return len(seen)

    got = link(spark, calls)
    assert {k: x.level for k, x in got.items()} == {k: level(*k) for k in dep}
    assert all((x.status == "cycle") == (x.level is None) for x in got.values())


def test_cycles_and_what_waits_for_them(spark):
    got = link(spark, [(1, 0, 0, "a", "lookup", lookup("a")), (1, 1, 0, "b", "lookup", lookup("c")),
                       (1, 2, 0, "c", "lookup", lookup("b")), (1, 3, 0, "d", "lookup", lookup("c")),
                       (1, 4, 0, "e", "lookup", lookup()), (1, 5, 0, "f", "lookup", lookup("e"))])
    assert [got[1, c].status for c in "abcd"] == ["cycle"] * 4
    assert (got[1, "e"].level, got[1, "f"].level) == (0, 1)


def test_many_calls_wait_for_one(spark):
    calls = [(1, 0, 0, "root", "lookup", lookup())]
    calls += [(1, i, 0, f"c{i}", "lookup", lookup("root")) for i in range(1, 3000)]
    got = link(spark, calls)
    assert {r.level for k, r in got.items() if k[1] != "root"} == {1} and len(got) == 3000


def test_repeated_ids_and_several_results(spark):
    got = link(spark,
               [(1, 5, 0, "a", "lookup", lookup(x=1)), (1, 2, 1, "a", "lookup", lookup(y=1)),
                (1, 2, 0, "a", "lookup", lookup()), (2, 0, 0, "a", "lookup", lookup())],
               [(1, 9, "a", "late"), (1, 3, "a", "early"), (1, 4, "gone", "stray"), (2, 1, "a", None)])
    assert got[1, "a"].turn == 2 and got[1, "a"].errors == ""
    assert json.loads(got[1, "a"].canonical)["result"] == "early"
    # a result without content is a result
    assert got[2, "a"].status == "ok" and "result" not in json.loads(got[2, "a"].canonical)


def test_null_and_broken_arguments(spark):
    got = link(spark, [(1, 0, 0, "a", "lookup", None), (1, 1, 0, "b", "lookup", "[1]"),
                       (1, 2, 0, "c", "lookup", '{"key": '), (1, 3, 0, "d", None, lookup()),
                       (1, 4, 0, "e", "nope", lookup()), (1, 5, 0, "f", "lookup", ""),
                       (1, 6, 0, "g", "lookup", lookup("nowhere")), (None, 0, 0, "h", "lookup", lookup()),
                       (1, 7, 0, None, "lookup", lookup()),
                       (1, 8, 0, "i", "search", '{"query": 5, "limit": "x", "zz": null}'),
                       (1, 9, 0, "j", "convert", '{"value": 1, "unit": "mile"}')])
    assert {k[1]: r.errors for k, r in got.items()} == {
        "a": "not_an_object", "b": "not_an_object", "c": "not_an_object", "d": "unknown_tool",
        "e": "unknown_tool", "f": "not_an_object", "g": "unknown_dependency",
        "i": "type:limit,type:query,unknown:zz", "j": "enum:unit"}
    assert got[1, "g"].level == 0 and {r.status for r in got.values()} == {"invalid"}


def test_canonical_form(spark):
    text = 'say "hi"\n' + "long " * 20_000
    got = link(spark, [(1, 0, 0, "a", "lookup", ' { "key" : "k",\n"after": "none" } ')],
               [(1, 1, "a", text)])
    line = got[1, "a"].canonical
    assert json.loads(line) == {"arguments": {"after": "none", "key": "k"}, "id": "a",
                                "name": "lookup", "result": text}
    assert line.startswith('{"arguments":{"after":"none","key":"k"},"id":"a","name":"lookup"')


def test_empty_tables(spark):
    assert link(spark, []) == {}
    got = link(spark, [(1, 0, 0, "a", "lookup", lookup())])
    assert got[1, "a"].status == "no_result"


def test_small_tables_match_the_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    want = con.execute(tool_calls.ORACLE_OP3)
    names = [d[0] for d in want.description]
    got = tool_calls.op3_tool_calls(spark, sf).select(*names).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)
