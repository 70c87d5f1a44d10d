"""Usage totals, response assembly and call validation."""

import json


from repolens.operators import responses as R


def _calls(spark, rows):
    return spark.createDataFrame(rows, "run bigint, seconds double, usage_json string")


def test_usage_accumulation(spark):
    df = _calls(spark, [(1, 1.0, json.dumps({"prompt_tokens": 10, "completion_tokens": 5})),
                        (1, 2.0, json.dumps({"prompt_tokens": 20, "completion_tokens": 10}))])
    r = R.usage_totals(df).collect()[0]
    assert (r.calls, r.seconds, r.input_tokens, r.output_tokens, r.total_tokens) == (2, 3.0, 30, 15, 45)


def test_usage_key_styles_and_total_fallback(spark):
    df = _calls(spark, [(1, 1.0, json.dumps({"input_tokens": 10, "output_tokens": 5})),
                        (1, 1.0, json.dumps({"total_tokens": 20, "completion_tokens": 8}))])
    r = R.usage_totals(df).collect()[0]
    assert (r.input_tokens, r.output_tokens) == (22, 13)


def test_usage_tokens_per_second(spark):
    df = _calls(spark, [(7, 2.0, json.dumps({"prompt_tokens": 100, "completion_tokens": 50}))])
    r = R.usage_totals(df).collect()[0]
    assert r.tokens_per_second == 25.0


def test_usage_edge_cases(spark):
    # zero falls through to the next key; fallback may go negative; null usage
    # still counts the call; nested and fractional values do not null the record.
    df = _calls(spark, [
        (1, 0.0, json.dumps({"prompt_tokens": 0, "input_tokens": 7, "completion_tokens": 0, "output_tokens": 3})),
        (2, 0.0, json.dumps({"completion_tokens": 9})),
        (3, 1.5, None),
        (4, 1.0, json.dumps({"prompt_tokens": 4, "completion_tokens": 2, "details": {"cached": 1}})),
        (5, 0.0, "{}"),
    ])
    got = {r.run: (r.calls, r.input_tokens, r.output_tokens, r.tokens_per_second)
           for r in R.usage_totals(df).collect()}
    assert got[1] == (1, 7, 3, 0.0)
    assert got[2] == (1, -9, 9, 0.0)
    assert got[3] == (1, 0, 0, 0.0)
    assert got[4][1:3] == (4, 2)
    assert got[5] == (1, 0, 0, 0.0)


def _lines(spark, rows):
    return spark.createDataFrame(rows, "response_id bigint, line_no bigint, line string")


def _chunk(content=None, tools=None, usage=None, choices=True):
    obj = {}
    if choices:
        delta = {}
        if content is not None:
            delta["content"] = content
        if tools is not None:
            delta["tool_calls"] = tools
        obj["choices"] = [{"index": 0, "delta": delta}]
    else:
        obj["choices"] = []
    if usage is not None:
        obj["usage"] = usage
    return "data: " + json.dumps(obj)


def test_assemble_out_of_order_and_tool_calls(spark):
    rows = [
        (1, 3, _chunk("world")),
        (1, 1, ": keep-alive"),
        (1, 2, _chunk("hello ")),
        (1, 4, _chunk(tools=[{"index": 0, "id": "c1", "function": {"name": "read_", "arguments": '{"a"'}}])),
        (1, 5, _chunk(tools=[{"index": 1, "id": "c2", "function": {"name": "ls", "arguments": "{}"}},
                             {"function": {"name": "file", "arguments": ": 1}"}}])),
        (1, 6, "data: {broken"),
        (1, 7, "  data: [DONE]  "),
        (1, 8, _chunk("!")),  # the tool-loop reader skips the marker and continues
        (2, 1, _chunk(usage={"prompt_tokens": 3}, choices=False)),
    ]
    out = {r.response_id: r for r in R.assemble_responses(_lines(spark, rows)).collect()}
    assert out[1].content == "hello world!"
    calls = [(c["index"], c["id"], c["name"], c["arguments"]) for c in out[1].tool_calls]
    assert calls == [(0, "c1", "read_file", '{"a": 1}'), (1, "c2", "ls", "{}")]
    assert out[2].content is None and out[2].tool_calls is None


def test_stop_at_done(spark):
    rows = [(1, 1, _chunk("a")), (1, 2, "data: [DONE]"), (1, 3, _chunk("b"))]
    kept = R.event_line_source(_lines(spark, rows), stop_at_done=True).collect()
    assert [r.line_no for r in kept] == [1]
    assert len(R.event_line_source(_lines(spark, rows)).collect()) == 2


def test_response_usage_last_nonzero(spark):
    rows = [(1, 1, _chunk(usage={"prompt_tokens": 5, "completion_tokens": 0}, choices=False)),
            (1, 2, _chunk(usage={"prompt_tokens": 0, "completion_tokens": 7}, choices=False)),
            (1, 3, _chunk(usage={"input_tokens": 9, "output_tokens": 0}, choices=False)),
            (2, 1, _chunk("x"))]
    got = {r.response_id: (r.prompt_tokens, r.completion_tokens, r.total_tokens)
           for r in R.response_usage(_lines(spark, rows)).collect()}
    assert got == {1: (9, 7, 16), 2: (0, 0, 0)}


def test_iteration_limit(spark):
    rounds = [(1, i, True) for i in range(10)] + [(2, i, True) for i in range(5)] + [(2, 5, False)] + \
             [(2, 6, True)] * 1
    df = spark.createDataFrame(rounds, "run bigint, ts bigint, has_tool_call boolean")
    got = {r.run: (r.leading_tool_rounds, r.hit_limit) for r in R.iteration_limit_audit(df).collect()}
    assert got == {1: (10, True), 2: (5, False)}


def test_validate_calls(spark):
    reg = spark.createDataFrame([("read_file", "filepath", True), ("list_files", "directory", False),
                                 ("write_file", "filepath", True), ("write_file", "content", True)],
                                "tool string, param string, required boolean")
    calls = spark.createDataFrame([
        (1, "read_file", '{"filepath": "a"}'), (2, "nope", "{}"), (3, "read_file", "{bad"),
        (4, "write_file", '{"filepath": "a"}'), (5, "list_files", '{"directory": ".", "x": 1}'),
        (6, "list_files", "{}"), (7, "read_file", "[1, 2]")], "event_id bigint, tool string, args string")
    got = {r.call_id: (r.status, r.detail) for r in R.validate_calls(calls, reg, "event_id").collect()}
    assert got[1] == ("ok", None)
    assert got[2] == ("unknown_tool", "Error: Tool nope not found.")
    assert got[3][0] == "bad_json" and got[7][0] == "bad_json"
    assert got[4] == ("missing_argument", "content")
    assert got[5] == ("unexpected_argument", "x")
    assert got[6] == ("ok", None)


def test_read_event_files(spark):
    import os
    import uuid

    from repolens.sources.events import read_event_files

    root = spark.sparkContext.getCheckpointDir().replace("file:", "").rstrip("/") + f"/events-{uuid.uuid4().hex}"
    os.makedirs(root)
    with open(os.path.join(root, "r1.txt"), "w") as f:
        f.write("\n".join([_chunk("hel"), ": ping", _chunk("lo"), "data: [DONE]", ""]))
    with open(os.path.join(root, "r2.txt"), "w") as f:
        f.write(_chunk("x") + "\r\n" + "data: [DONE]")
    lines = read_event_files(spark, root)
    out = {r.response.rsplit("/", 1)[-1]: r.content
           for r in R.assemble_responses(lines, key="response").collect()}
    assert out == {"r1.txt": "hello", "r2.txt": "x"}


def test_stream_event_files(spark):
    import os
    import time
    import uuid

    from repolens.sources.events import read_event_files
    from repolens.streaming.assembly import assembly_stream, rocksdb_state

    base = spark.sparkContext.getCheckpointDir().replace("file:", "").rstrip("/") + f"/evstream-{uuid.uuid4().hex}"
    os.makedirs(base + "/in")
    with open(base + "/in/a.txt", "w") as f:
        f.write("\n".join([_chunk("ab"), _chunk("cd"), "data: [DONE]"]))
    src = read_event_files(spark, base + "/in", stream=True)
    with rocksdb_state(spark):
        q = (assembly_stream(src, timeout_ms=None, key="response").writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", base + "/ckpt").trigger(availableNow=True).start(base + "/out"))
    q.awaitTermination(120)
    rows = spark.read.parquet(base + "/out").collect()
    assert [(r.response.rsplit("/", 1)[-1], r.content, r.complete) for r in rows] == [("a.txt", "abcd", True)]


class _State:
    """One key's value, list or map state in memory; counts the calls."""

    def __init__(self, calls):
        self.calls, self.value, self.items, self.map = calls, None, [], {}

    def _count(self, name):
        self.calls.append(name)

    def get(self):
        self._count("get")
        return self.value

    def update(self, value):
        self._count("update")
        self.value = value

    def appendValue(self, value):
        self._count("append")
        self.items.append(value)

    def appendList(self, values):
        self._count("append")
        self.items += values

    def getValue(self, key):
        self._count("get")
        return self.map.get(key)

    def updateValue(self, key, value):
        self._count("update")
        self.map[key] = value

    def iterator(self):
        self._count("iterator")
        return iter(list(self.map.items()))

    def clear(self):
        self._count("clear")
        self.value, self.items, self.map = None, [], {}


class _ListState(_State):
    def get(self):
        self._count("get")
        return iter(list(self.items))


class _Handle:
    def __init__(self):
        self.calls, self.states = [], []

    def _new(self, kind):
        self.states.append(kind(self.calls))
        return self.states[-1]

    def getListState(self, *_):
        return self._new(_ListState)

    def getMapState(self, *_):
        return self._new(_State)

    getValueState = getMapState


def _assembler():
    from repolens.streaming.assembly import Assembler

    a, handle = Assembler("response_id", 0, None), _Handle()
    a.init(handle)
    return a, handle


def _feed(a, lines):
    from pyspark.sql import Row

    rows = [Row(response_id=7, line_no=n, is_done=text is None, content=text, tool_json=None) for n, text in lines]
    return list(a.handleInputRows((7,), iter(rows), None))


def test_assembler_makes_few_calls_on_the_state():
    """Each call is a message to the JVM: two for a short response's
    micro-batch, whatever it brings."""
    a, handle = _assembler()
    waves = [(4, None)], [(1, "b"), (3, "d")], [(0, "a"), (2, "c"), (2, "again")]
    out = []
    for wave in waves:
        before = len(handle.calls)
        out += _feed(a, wave)
        assert len(handle.calls) - before <= 2, handle.calls[before:]
    assert [sorted(zip(r["line_nos"], r["contents"])) for r in out] == [[(0, "a"), (1, "b"), (2, "again"), (2, "c"), (3, "d")]]
    assert out[0]["complete"] and all(not s.value and not s.items and not s.map for s in handle.states)
    handle.calls.clear()
    assert _feed(a, [(0, "x"), (1, None)])[0]["contents"] == ["x"] and handle.calls == ["get"]


def test_assembler_keeps_long_responses_in_chunks(monkeypatch):
    """Long chunks are appended and not written again; line numbers go on
    over several blocks, the marker comes first, between or last."""
    import random

    from repolens.streaming import assembly

    monkeypatch.setattr(assembly, "CHUNK_LINES", 700)
    n = 3 * assembly.BLOCK + 5
    lines = [(i, f"w{i} ") for i in range(n)] + [(n, None)]
    random.Random(3).shuffle(lines)
    for at in (0, n // 2, n):
        order = [x for x in lines if x[1] is not None]
        order.insert(at, (n, None))
        a, handle = _assembler()
        out, sizes = [], []
        for k in range(0, len(order), 1500):
            assert not out
            out += _feed(a, order[k:k + 1500])
            sizes.append(len(handle.states[0].items))
        assert sizes[:-1] == sorted(sizes[:-1]) and max(sizes) > 3
        assert sorted(zip(out[0]["line_nos"], out[0]["contents"])) == sorted(x for x in lines if x[1] is not None)
        assert all(not s.value and not s.items and not s.map for s in handle.states)


def test_stream_keeps_responses_beside_a_null_id(spark):
    """A null id in a batch leaves the other ids what they are."""
    import uuid

    from repolens.streaming.assembly import assembly_stream, rocksdb_state

    base = spark.sparkContext.getCheckpointDir().rstrip("/") + f"/nullid-{uuid.uuid4().hex}"
    ids = [None, *range(20)]
    for wave in ([(i, 1, "data: [DONE]") for i in ids], [(i, 0, _chunk(f"r{i}")) for i in ids]):
        _lines(spark, wave).coalesce(1).write.mode("append").parquet(f"{base}/in")
    src = (spark.readStream.schema("response_id bigint, line_no bigint, line string").option("maxFilesPerTrigger", 1)
           .parquet(f"{base}/in"))
    with rocksdb_state(spark):
        q = (assembly_stream(src, timeout_ms=None).writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start(f"{base}/out"))
    q.awaitTermination(120)
    rows = spark.read.parquet(f"{base}/out").collect()
    assert sorted((str(r.response_id), r.content) for r in rows) == sorted((str(i), f"r{i}") for i in ids)
