import json

import pytest

from helixframe.llm import tool_calls, url_filter
from helixframe.llm.queries import URL_RULES


def slow_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    return host, rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]


def slow_rule(host, path):
    fits = [(r, v) for r, v in URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


URLS = [
    None, "", "nothing", "http://", "http://A.Com", "http://a.com/", "HTTPS://WWW.Example.COM/en/x?q=1#f", "x://sub.example.com/en/a://b", "http://net/es/1",
    "http://net/es", "http://xnet/es/1", "http://a.net?x=/es/", "http://a.net#/es/", "http://é.net/fr/ü", "http://example.com/en/", "http://a/" + "seg/" * 500, "http://h/a\nb/c",
]


def test_parts_and_rules(spark, sf_dir):
    own = spark.createDataFrame([(i, u, "x") for i, u in enumerate([*URLS, URLS[5], URLS[5]])], "page_id long, url string, host string")
    for pages in (own, spark.read.parquet(f"{sf_dir}/pages.parquet"), own.limit(0)):
        rows = {r["page_id"]: r for r in url_filter.filter_urls(pages, URL_RULES).collect()}
        given = pages.select("page_id", "url").collect()
        assert len(rows) == len(given)
        for g in given:
            r, (host, path) = rows[g["page_id"]], slow_parts(g["url"])
            rule, verdict = slow_rule(host, path)
            assert (r["host"], r["path"], r["rule"]) == (host, path, rule), g["url"]
            assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")


def test_templates_learn_from_labels(spark):
    rows, bad, n = [], [], 0
    for kind, is_bad in (("shop", 1), ("news", 0)):
        for i in range(200):
            rows.append((n, f"http://one.org/{kind}/{i}/item-{i}.html" if kind == "shop" else f"http://one.org/{kind}/{i}"))
            if i % 2:
                bad.append((n, is_bad))
            n += 1
    rows.append((n, "http://other.org/shop/5/item-5.html"))
    pages, labels = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([*bad, (None, 1), (n, None)], "page_id long, bad int")
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages, (), labels).collect()}
    for i, u in rows[:-1]:
        assert got[i]["verdict"] == ("block" if "/shop/" in u else "allow"), u
    assert got[n]["verdict"] == "allow" and got[0]["template"] == "/shop/{n}/item-{n}.html" and got[300]["template"] == "/news/{n}"


def test_alike_branches_merge_and_busy_nodes_become_wildcards(spark):
    rows = [f"http://a.org/{lang}/{i}" for lang in ("de", "en", "fr") for i in range(50)] + [f"http://b.org/u/name{chr(97 + i // 26)}{chr(97 + i % 26)}/photos" for i in range(200)]
    rows += [f"http://c.org/x/{i}" for i in range(100)] + [f"http://c.org/y/word{chr(97 + i % 26)}" for i in range(100)]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {(r["host"], r["template"]) for r in url_filter.filter_urls(pages, ()).collect()}
    assert ("a.org", "/*/{n}") in got and {t for h, t in got if h == "a.org"} == {"/*/{n}"}
    assert {t for h, t in got if h == "b.org"} == {"/u/*/photos"}
    assert all(t.startswith(("/x", "/y")) for h, t in got if h == "c.org")


def slow_templates(urls, bad):
    """(template, purity) by page, from plain loops; ``bad`` holds the labelled pages."""
    import math
    import re
    from collections import defaultdict

    def kind(segment):
        if segment in (None, ""):
            return "none" if segment is None else "end"
        if re.fullmatch(r"\{[a-z]+\}", segment):
            return segment
        end = re.search(r"(\.[A-Za-z0-9]{1,5})?$", segment)[0]
        return ("mixed" if re.search(r"\{[a-z]+\}", segment) else "word") + end

    paths = {i: (slow_parts(u)[0], re.sub(r"[0-9]+", "{n}", slow_parts(u)[1])[1:].split("/")) for i, u in urls.items()}
    branches = defaultdict(lambda: [defaultdict(int), 0, 0])
    for i, (host, s) in paths.items():
        for d in range(len(s)):
            b = branches[host, tuple(s[:d]), s[d]]
            b[0][kind(s[d + 1] if d + 1 < len(s) else None)] += 1
            b[1] += i in bad
            b[2] += bad.get(i, 0)
    sides = defaultdict(list)
    for (host, above, segment), b in branches.items():
        sides[host, above, bool(b[1] and 2 * b[2] >= b[1])].append((segment, b))
    merged = {}
    for (host, above, side), own in sides.items():
        total = defaultdict(int)
        for _, b in own:
            for k, n in b[0].items():
                total[k] += n
        labelled, n_bad = sum(b[1] for _, b in own), sum(b[2] for _, b in own)
        share, df = n_bad / max(labelled, 1), max(len(total) - 1, 1)
        for segment, b in own:
            size = sum(b[0].values())
            chi = sum(n * n / (size * total[k] / sum(total.values())) for k, n in b[0].items()) - size
            z = (math.cbrt(max(chi, 0) / df) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
            agrees = abs(b[2] - b[1] * share) <= 3.09 * math.sqrt(b[1] * share * (1 - share))
            if len(own) > 1 and z <= 3.09 and agrees and not re.fullmatch(r"(\{[a-z]+\}|)", segment):
                merged[host, above, segment] = "*bad" if side else "*"
    template = {i: (host, "/" + "/".join(merged.get((host, tuple(s[:d]), s[d]), s[d]) for d in range(len(s)))) for i, (host, s) in paths.items()}
    sums = defaultdict(lambda: [0, 0])
    for i, t in template.items():
        sums[t][0] += bad.get(i, 0)
        sums[t][1] += i in bad
    return {i: (t[1], (sums[t][0] + 0.8) / (sums[t][1] + 4)) for i, t in template.items()}


def test_the_tree_equals_plain_loops(spark):
    import random

    rng = random.Random(4)
    urls, bad = {}, {}
    for n in range(3000):
        host = rng.choice(["a.org", "b.org", "c.net"])
        path = [rng.choice(["de", "en", "es", "fr", "shop", "x1"])]
        path += rng.choice([[str(n)], ["item.html"], ["u", f"name{rng.choice('abcdefgh')}", "photos"], ["deep"] * 9 + [str(n)], [""]])
        urls[n] = f"http://{host}/" + "/".join(path)
        if path[0] in ("es", "fr", "shop") and rng.random() < 0.6:
            bad[n] = int(rng.random() < (0.1 if path[0] == "shop" else 0.95))
    urls |= {3000 + i: f"http://busy.org/u/user{a}{b}/photos" for i, (a, b) in enumerate((a, b) for a in "abcdefghij" for b in "abcdefghij")}
    pages, labels = spark.createDataFrame(list(urls.items()), "page_id long, url string"), spark.createDataFrame(list(bad.items()), "page_id long, bad int")
    want = slow_templates(urls, bad)
    rows = url_filter.filter_urls(pages, (), labels).collect()
    assert {r["page_id"]: (r["template"], round(r["purity"], 9)) for r in rows} == {i: (t, round(p, 9)) for i, (t, p) in want.items()}
    assert all(r["verdict"] == ("block" if r["purity"] >= 0.5 else "allow") for r in rows)
    for host in ("a.org", "c.net"):  # verdicts vary within a host, and branches without labels stay
        own = [(r["path"].split("/")[1], r["verdict"]) for r in rows if r["host"] == host]
        assert ("es", "block") in own and not {v for s, v in own if s in ("de", "en", "shop")} - {"allow"}
    assert {r["template"] for r in rows if r["host"] == "busy.org"} == {"/u/*/photos"}
    assert any(t.count("deep") == 9 for t, _ in want.values())


def test_main_path_has_no_python(spark, sf_dir, capsys):
    url_filter.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES).explain()
    assert not [w for w in ("Python", "Pandas", "Arrow") if w in capsys.readouterr().out]


SCHEMA = {"search": {"type": "object", "properties": {"q": {"type": "string", "minLength": 1}, "n": {"type": "integer", "minimum": 1}}, "required": ["q"], "additionalProperties": False}}


def call(name, id_, **arguments):
    return f"<tool_call>{json.dumps({'id': id_, 'name': name, 'arguments': arguments})}</tool_call>"


def result(id_, content):
    return f"<tool_result>{json.dumps({'id': id_, 'content': content})}</tool_result>"


@pytest.fixture(scope="module")
def linked(spark):
    rows = [
        (1, 0, "user", "hi"),
        (1, 1, "tool", result("a", 1.0)),
        (1, 2, "assistant", "see " + call("search", "a", q="z", n=2.0)),
        (1, 3, "assistant", call("search", "b", q={"$ref": "a"}, w=1) + "<tool_call>{bad}</tool_call>"),
        (1, 4, "tool", result("b", {"y": "é", "x": [1.5, None]})),
        (2, 0, "assistant", call("search", "a", q={"$ref": "b"})),
        (2, 1, "assistant", call("search", "b", q={"$ref": "a"})),
        (2, 2, "tool", result("a", 1)),
        (2, 3, "tool", result("b", 1)),
        (3, 0, None, None),
        (4, 0, "assistant", call("other", "c") + call("search", "c", q="")),
        (4, 1, "tool", result("c", "first") + result("zz", 0)),
        (5, 0, "assistant", call("search", "x", q="1")),
        (5, 0, "assistant", call("search", "x", q="1")),
        (5, 1, "tool", result("x", 1)),
        (5, 2, "tool", result("x", 2)),
        (None, 1, "user", "x"),
    ]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, node string")
    return tool_calls.link_tool_calls(df, SCHEMA).collect(), len(rows)


def test_links_and_order(linked):
    rows, n = linked
    assert len(rows) == n
    by = {(r["conv_id"], r["turn"]): r for r in rows}
    first = sorted((r for r in rows if r["conv_id"] == 1), key=lambda r: (r["order_turn"], r["order_level"], r["turn"]))
    assert [r["turn"] for r in first] == [0, 2, 1, 3, 4]
    assert by[1, 1]["status"] == "ok" and by[1, 3]["status"] == "malformed,invalid" and by[1, 3]["errors"] == "$: unknown w"
    assert "cycle" in {s for r in rows if r["conv_id"] == 2 for s in r["status"].split(",")}
    assert by[4, 0]["n_calls"] == 2 and by[4, 0]["n_answered"] == 1 and by[4, 0]["n_invalid"] == 2 and "unanswered" in by[4, 0]["status"]
    assert by[4, 1]["n_orphans"] == 1 and by[4, 1]["status"] == "orphan"
    assert all(r["n_answered"] == 1 for r in rows if r["conv_id"] == 5 and r["role"] == "assistant")
    assert by[3, 0]["message"] == '{"content":"","role":""}' and by[None, 1]["status"] == "ok"


def test_canonical_json(linked):
    by = {(r["conv_id"], r["turn"]): r["message"] for r in linked[0]}
    assert by[1, 2] == '{"content":"see ","role":"assistant","tool_calls":[{"arguments":{"n":2,"q":"z"},"id":"a","name":"search"}]}'
    assert by[1, 4] == '{"content":"","role":"tool","tool_results":[{"content":{"x":[1.5,null],"y":"é"},"id":"b"}]}'
    assert tool_calls.canonical_json({"b": float("nan"), "a": [True, 1e300, -0.0]}) == '{"a":[true,1e+300,0],"b":null}'


@pytest.mark.parametrize(
    "value, schema, wrong",
    [(1, {"type": "integer"}, 0), (1.0, {"type": "integer"}, 0), (True, {"type": "integer"}, 1), ("a", {"type": ["null", "string"]}, 0), (3, {"maximum": 2}, 1), ([1, "x"], {"items": {"type": "number"}}, 1),
     ("ab", {"pattern": "^a$"}, 1), (2, {"enum": [1, 3]}, 1), (True, {"const": 1}, 1), ({"a": 1}, {"additionalProperties": {"type": "string"}}, 1), ([], {"minItems": 1}, 1), ({"$ref": "c"}, {"type": "string"}, 0)],
)
def test_schema_errors(value, schema, wrong):
    assert len(tool_calls.schema_errors(value, schema)) == wrong


def test_conversations_without_calls_keep_their_order(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    got = {(r["conv_id"], r["turn"]): r for r in tool_calls.link_tool_calls(df).collect()}
    for r in df.collect():
        g = got[r["conv_id"], r["turn"]]
        assert (g["order_turn"], g["order_level"], g["status"]) == (r["turn"], 0, "ok")
        assert json.loads(g["message"]) == {"content": r["text"], "role": r["role"]}
    assert tool_calls.link_tool_calls(df.limit(0)).collect() == []


def test_one_odd_message_does_not_end_the_job(spark):
    deep = "[" * 500 + "]" * 500
    for _ in range(900):
        nested = {"a": nested} if _ else {}
    texts = [
        '<tool_call>{"id": "\\ud800", "name": "search", "arguments": {"q": "\\udfff x"}}</tool_call>',
        f'<tool_call>{{"id": "b", "name": "search", "arguments": {{"q": {deep}}}}}</tool_call>',
        f'<tool_call>{{"id": "c", "name": "search", "arguments": {json.dumps(nested)}}}</tool_call>',
        f'<tool_call>{{"id": "d", "name": "search", "arguments": {"[" * 100000}</tool_call>',
    ]
    df = spark.createDataFrame([(1, i, "assistant", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    bad = spark.sql("select 1L as conv_id, 9L as turn, cast(unhex('61FF') as string) as role, cast(unhex('FE62') as string) as text")
    got = {r["turn"]: r for r in tool_calls.link_tool_calls(df.unionByName(bad), SCHEMA).collect()}
    assert got[0]["message"] == '{"content":"","role":"assistant","tool_calls":[{"arguments":{"q":"\\udfff x"},"id":"\\ud800","name":"search"}]}'
    assert json.loads(got[0]["message"])["tool_calls"][0]["id"] == "\ud800"
    for i in (1, 2, 3):
        assert got[i]["malformed"] == 1 and json.loads(got[i]["message"])["content"] == texts[i]
    assert got[9]["message"] == '{"content":"\ufffdb","role":"a\ufffd"}'


def test_order_equals_a_plain_search(spark):
    import random

    rng = random.Random(3)
    rows, want = [], {}
    for conv in range(12):
        ids = list(range(8))
        needs = {i: [j for j in range(i) if rng.random() < 0.3] for i in ids}
        turns = rng.sample(range(40), 16)
        nodes = {("call", i): turns[i] for i in ids} | {("result", i): turns[8 + i] for i in ids}
        before = {("result", i): [("call", i)] for i in ids} | {("call", i): [("result", j) for j in needs[i]] for i in ids}
        for (kind, i), turn in nodes.items():
            text = call("search", f"t{i}", q="x", n=[{"$ref": f"t{j}"} for j in needs[i]]) if kind == "call" else result(f"t{i}", 1)
            rows.append((conv, turn, kind, text))

        place = {}
        for i in ids:
            for key in (("call", i), ("result", i)):
                t, level = max([place[b] for b in before[key]], default=(-1, -1))
                place[key] = (t, level + 1) if t >= nodes[key] else (nodes[key], 0)
                want[conv, nodes[key]] = place[key]
    got = tool_calls.link_tool_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r["conv_id"], r["turn"]): (r["order_turn"], r["order_level"]) for r in got} == want


def test_cycles_and_long_conversations(spark, monkeypatch):
    """Random graphs with and without cycles: one task, rounds and a plain search agree on place and cycle."""
    import random

    rng = random.Random(11)
    rows, want = [], {}
    for conv in range(8):
        n = 10
        needs = {i: sorted(rng.sample(range(n), rng.randint(0, 1 + conv % 2))) for i in range(n)}
        turns = rng.sample(range(50), 2 * n)
        node = {("call", i): turns[i] for i in range(n)} | {("result", i): turns[n + i] for i in range(n)}
        before = {("result", i): [("call", i)] for i in range(n)} | {("call", i): [("result", j) for j in needs[i]] for i in range(n)}
        for (kind, i), turn in node.items():
            rows.append((conv, turn, kind, call("search", f"t{i}", q="x", n=[{"$ref": f"t{j}"} for j in needs[i]]) if kind == "call" else result(f"t{i}", 1)))
        place = {}
        while fresh := [k for k in node if k not in place and all(b in place for b in before[k])]:
            for k in fresh:
                t, level = max([place[b] for b in before[k]], default=(-1, -1))
                place[k] = (t, level + 1) if t >= node[k] else (node[k], 0)
        for k in node:
            t, level = max([place[b] for b in before[k] if b in place], default=(-1, -1))
            want[conv, node[k]] = (*((t, level + 1) if t >= node[k] else (node[k], 0)), k not in place)
    assert {c for *_, c in want.values()} == {True, False}
    df = spark.createDataFrame([*rows, (0, None, "call", call("search", "t0", q={"$ref": "t1"}))], "conv_id long, turn long, role string, text string")
    for bound in (tool_calls.GROUP_EDGES, 12):
        monkeypatch.setattr(tool_calls, "GROUP_EDGES", bound)
        got = tool_calls.link_tool_calls(df.where("turn is not null")).collect()
        assert {(r["conv_id"], r["turn"]): (r["order_turn"], r["order_level"], "cycle" in r["status"].split(",")) for r in got} == want
        unplaced = [r for r in tool_calls.link_tool_calls(df).collect() if r["turn"] is None]
        assert [r["order_turn"] for r in unplaced] == [None]


def test_numbers_of_a_frequent_identifier(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    key = F.when(F.col("node") % 3 == 0, 0).otherwise(F.col("node") % 40)
    rows = spark.range(6000).select(F.col("id").alias("node")).select("node", (key % 4).alias("conv_id"), key.cast("string").alias("id"), F.xxhash64("node").alias("turn"), F.lit(0).alias("at"))
    want = rows.withColumn("k", F.row_number().over(Window.partitionBy("conv_id", "id").orderBy("turn", "node", "at")))
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbers = lambda df: {(r["node"], r["k"]) for r in df.collect()}
        assert numbers(tool_calls._numbered(rows)) == numbers(want)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
