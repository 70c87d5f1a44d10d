"""I1 through a ledger: killed runs, failures, repeated prompts, calls in flight."""

import asyncio
import os
import time
import uuid

import pytest

from repolens.operators import calls, summarize
from repolens.session import scratch_folder


def _batches(spark, rows):
    """One large item a batch."""
    diffs = spark.createDataFrame([(k, i, f"{k}/{i}.py", d + " " * 500) for k, i, d in rows], "change_set string, pos int, path string, diff string")
    return summarize.size_batches(diffs).checkpoint()


def _note(folder, text):
    with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
        f.write(text)


def _noted(folder):
    return sorted(open(os.path.join(folder, f)).read() for f in os.listdir(folder))


def test_a_killed_run_repeats_no_finished_call(spark, tmp_path):
    log, ledger, flag = str(tmp_path / "log"), scratch_folder(spark, "ledger"), str(tmp_path / "kill")
    os.mkdir(log)
    rows = [(k, i, f"{k}{i}") for k in ("a", None) for i in range(6)] + [("a", 6, "a0"), ("b", 0, "fails")]
    batches = _batches(spark, rows)

    def fn(prompt):
        if prompt.startswith("None3") and os.path.exists(flag):
            os._exit(1)
        if prompt.startswith("fails"):
            _note(log, "failed")
            raise ValueError("no")
        _note(log, prompt.strip())
        return f" <{prompt.strip()}> "

    open(flag, "w").close()
    args = dict(fn=fn, template="{diff}", max_concurrent=1, in_flight=1, write_every=1)
    with pytest.raises(Exception):
        calls.call_batches(batches, ledger, **args)
    first = _noted(log)
    assert first and "None3" not in first
    os.remove(flag)
    got = {(r["change_set"], r["files"][0]): (r["summary"], r["error"]) for r in calls.call_batches(batches, ledger, **args).collect()}
    assert got == {(k, f"{k}/{i}.py"): ((None, "no") if d == "fails" else (f"<{d}>", None)) for k, i, d in rows}
    done = [x for x in _noted(log) if x != "failed"]
    assert done == sorted({d for _, _, d in rows} - {"fails"})          # each prompt once in both runs
    n_failed = _noted(log).count("failed")
    calls.call_batches(batches, ledger, **args)                         # nothing left but the failure
    assert [x for x in _noted(log) if x != "failed"] == done and _noted(log).count("failed") == n_failed + 1


def test_calls_in_flight_are_bounded_per_change_set(spark, tmp_path):
    log = str(tmp_path)
    rows = [(k, i, f"{k}:{i}") for k in "abc" for i in range(12)]

    async def fn(prompt):
        start = time.time()
        await asyncio.sleep(0.3)
        _note(log, f"{prompt[0]} {start} {time.time()}")
        return prompt

    out = calls.call_batches(_batches(spark, rows), scratch_folder(spark, "ledger"), fn, "{diff}", max_concurrent=4, in_flight=2)
    assert out.where("summary IS NULL OR error IS NOT NULL").count() == 0 and out.count() == 36
    spans = [x.split() for x in _noted(log)]
    most = 0
    for k in "abc":
        ends = sorted([(float(s), 1) for c, s, _ in spans if c == k] + [(float(e), -1) for c, _, e in spans if c == k])
        n = 0
        for _, step in ends:
            n += step
            most = max(most, n)
    assert 2 <= most <= 4


def test_summaries_through_a_ledger(spark):
    diffs = spark.createDataFrame([("a", 0, "x", "one"), (None, 0, "y", "two"), ("a", 1, "z", None)], "change_set string, pos int, path string, diff string")
    ledger = scratch_folder(spark, "ledger")
    plain = sorted(summarize.summarize_change_sets(diffs).collect(), key=str)
    for _ in range(2):
        assert sorted(summarize.summarize_change_sets(diffs, ledger=ledger).collect(), key=str) == plain
    assert calls.call_batches(summarize.size_batches(diffs.limit(0)), ledger).count() == 0
    with pytest.raises(ValueError):
        calls.call_batches(summarize.size_batches(diffs), ledger, max_concurrent=1, in_flight=2)
