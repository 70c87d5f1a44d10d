"""Repeated rows, repeated keys, null keys and equal positions: each row
counts once, whatever it shares with others."""

import json

import pandas as pd
from pyspark.sql import functions as F

from repolens.operators import responses, sessions, summarize
from repolens.session import scratch_folder
from repolens.streaming import assembly


def _emitted(items, batch=2, small=5):
    """Batches of (pos, path, text) items in a sequential pass."""
    out, held = [], []
    for it in items:
        if len(it[2]) >= small:
            out.append([it])
        else:
            held.append(it)
            if len(held) == batch:
                out.append(held)
                held = []
    return out + ([held] if held else [])


def test_size_batches_keeps_every_row(spark):
    rows = [("a", 1, "p", "x"), ("a", 1, "p", "x"), ("a", 2, "p", "y"), ("a", 3, "q", "large text"), ("a", 3, "q", "large text"), ("a", 3, "r", "other large"),
            ("a", None, None, "z"), (None, 1, "p", "x"), (None, 1, "p", None), (None, 2, None, "large again"), (None, 2, None, "large again"), ("b", 1, "p", "large text")]
    df = spark.createDataFrame(rows, "change_set string, pos int, path string, diff string").repartition(4)
    got = summarize.size_batches(df, small_chars=5, batch_size=2).collect()
    assert all(r["n_items"] == len(r["members"]) for r in got)
    for key in ("a", None, "b"):
        mine = sorted((r for r in got if r["change_set"] == key), key=lambda r: r["batch_no"])
        assert [r["batch_no"] for r in mine] == list(range(1, len(mine) + 1))
        members = sorted(((m["pos"], m["path"], m["diff"]) for r in mine for m in r["members"]), key=str)
        assert members == sorted(((p, q, t or "") for k, p, q, t in rows if k == key), key=str)
    # One text for each position: the batches of a sequential pass.
    plain = [("k", i, "p", "t" * (1 + (i * 7) % 9)) for i in range(40)]
    df = spark.createDataFrame(plain, "change_set string, pos int, path string, diff string")
    got = sorted(summarize.size_batches(df, small_chars=5, batch_size=3).collect(), key=lambda r: r["batch_no"])
    assert [[(m["pos"], m["path"], m["diff"]) for m in r["members"]] for r in got] == _emitted([r[1:] for r in plain], 3)


def test_inject_mentions_keeps_rows_apart(spark):
    texts = [(1, "see @a.py now"), (1, "not @a.py again @b.py"), (2, "plain"), (2, "see @a.py now"), (2, "see @a.py now"), (None, "@b.py"), (None, None)]
    files = spark.createDataFrame([("a.py", "A"), ("a.py", "A"), ("a.py", "B"), ("c.py", "C")], "path string, content string")
    got = sessions.inject_mentions(spark.createDataFrame(texts, "doc_id int, text string"), files).collect()
    block = sessions.CONTEXT_HEADER_START + "a.py" + sessions.CONTEXT_HEADER_END + "A" + sessions.CONTEXT_FOOTER
    want = [(k, t if t is None else t.replace("@a.py", block)) for k, t in texts]
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(want, key=str)


def test_null_sessions_and_runs(spark):
    log = spark.createDataFrame([(None, 1, "write_file", "always"), (None, 2, "write_file", "n"), ("s", 1, "write_file", "n"), (None, 3, None, "n")],
                                "session string, seq int, tool string, choice string")
    got = {(r["session"], r["seq"]): r["allowed"] for r in sessions.sticky_permissions(log).collect()}
    assert got[None, 1] and got[None, 2] and not got["s", 1] and len(got) == 4
    rounds = spark.createDataFrame([(None, 1, True), (None, 2, True), (None, 3, False), (None, 4, True), ("r", 1, True)], "run string, ts int, has_tool_call boolean")
    got = {r["run"]: (r["leading_tool_rounds"], r["hit_limit"]) for r in responses.iteration_limit_audit(rounds, cap=2).collect()}
    assert got == {None: (2, True), "r": (1, False)}


def test_fill_missing_gives_a_row_for_a_row(spark):
    methods = spark.createDataFrame([(1, "m"), (1, "n"), (2, "o"), (None, "p")], "doc_id int, name string")
    existing = spark.createDataFrame([(1, "b"), (1, "a"), (1, ""), (2, ""), (None, "x")], "doc_id int, docstring string")
    got = sorted(((r["doc_id"], r["docstring"], r["action"]) for r in sessions.fill_missing(methods, existing, F.col("name")).collect()), key=str)
    assert got == sorted([(1, "a", "kept"), (1, "a", "kept"), (2, "o", "generated"), (None, "p", "generated")], key=str)


def test_lines_delivered_twice_count_once_in_batch_and_stream(spark):
    def text(c):
        return 'data: {"choices":[{"delta":{"content":"%s"}}]}' % c
    tool = 'data: {"choices":[{"delta":{"tool_calls":[{"index":0,"id":"i","function":{"name":"f","arguments":"{}"}}]}}]}'
    done = "data: [DONE]"
    # The marker first, then lines out of order, some again in a later micro-batch; a line after the marker.
    waves = [[(1, 4, done), (1, 9, text("z")), (1, 1, text("c")), (2, 0, done)], [(1, 0, text("a")), (1, 1, text("b")), (1, 0, text("a")), (None, 0, text("n"))],
             [(1, 2, tool), (1, 1, text("c")), (None, 1, done)], [(1, 3, text("d")), (1, 2, tool)]]
    schema = "response_id int, line_no bigint, line string"
    batch = {r["response_id"]: r for r in responses.assemble_responses(spark.createDataFrame(sum(waves, []), schema).where("line_no < 9").repartition(3)).collect()}
    assert batch[1]["content"] == "abd" and [(c["name"], c["arguments"]) for c in batch[1]["tool_calls"]] == [("f", "{}")]
    root = scratch_folder(spark, "streams/twice")
    for n, wave in enumerate(waves):
        spark.createDataFrame(wave, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        with assembly.rocksdb_state(spark):  # each wave restarts the query from its checkpoint
            q = (assembly.assembly_stream(src, timeout_ms=None).writeStream.format("parquet").outputMode("append")
                 .option("checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).start(f"{root}/out"))
        q.awaitTermination()
        got = {r["response_id"]: r for r in spark.read.parquet(f"{root}/out").collect()}
        assert (1 in got) == (n == 3) and (None in got) == (n >= 2) and got[2]["content"] is None
    assert got[1]["content"] == "abd" and got[1]["n_lines"] == 4 and got[1]["complete"] and got[None]["content"] == "n"
    assert [(c["name"], c["arguments"]) for c in json.loads(got[1]["tool_calls_json"])] == [("f", "{}")]


class _Handle:
    """State in dictionaries; counts the fragments and entries written."""

    def __init__(self):
        self.appended, self.entries, self.timers = 0, 0, []

    def getListState(self, name, schema):
        handle, held = self, []

        class L:
            def appendList(self, xs):
                handle.appended += len(xs)
                held.extend(xs)

            def get(self):
                return iter(held)

            def clear(self):
                held.clear()
        return L()

    def getMapState(self, name, key, value):
        handle, held = self, {}

        class M:
            getValue, clear = staticmethod(held.get), staticmethod(held.clear)

            def updateValue(self, k, v):
                handle.entries += 1
                held[k] = v

            def iterator(self):
                return iter(list(held.items()))
        return M()

    def getValueState(self, name, schema):
        held = []

        class S:
            def get(self):
                return held[0] if held else None

            def update(self, v):
                held[:] = [v]
            clear = staticmethod(held.clear)
        return S()

    def registerTimer(self, t):
        self.timers.append(t)

    def deleteTimer(self, t):
        self.timers.remove(t)


def test_a_micro_batch_writes_only_its_own_lines():
    class Clock:
        def __init__(self, t):
            self.getCurrentProcessingTimeInMs = self.getExpiryTimeInMs = lambda: t

    handle, a = _Handle(), assembly.Assembler("response_id", 0, 100)
    a.init(handle)
    per = 500
    for n in range(40):
        at = range(n * per, (n + 1) * per)
        lines = pd.DataFrame({"line_no": list(at), "is_done": False, "content": ["x"] * per, "tool_json": [None] * per})
        before = handle.appended, handle.entries
        assert list(a.handleInputRows((1,), iter([lines]), Clock(n))) == []
        assert handle.appended - before[0] == per and handle.entries - before[1] <= 2 and handle.timers == [n + 100]
    assert list(a.handleExpiredTimer((1,), Clock(0), Clock(100))) == []      # an older timer
    end = pd.DataFrame({"line_no": [40 * per], "is_done": [True], "content": [None], "tool_json": [None]})
    (out,) = a.handleInputRows((1,), iter([end]), Clock(50))
    assert len(out["contents"][0]) == 40 * per and out["complete"][0] and handle.timers == [] and a.progress.get() is None


def test_generated_files_are_dealt_to_all_cores(spark):
    from repolens.sources import views as V
    from repolens.sources.tables import Tables
    from tests.conftest import SF_SMALL

    code = V.v_code(Tables(spark, SF_SMALL))
    assert code.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
