"""Runs of a model over rows: how often it is asked, what it is told, what ends a run."""

import json

import pytest
from pyspark.sql import functions as F

from tandem.operators import context
from tandem.plans import proofread
from tandem.plans.compare import kept_in
from tandem.plans.proofread import FatalRequestError


def rows_of(spark, n, keys=("p",), extra=""):
    data = [(k, i, f"原文第{i}行说了一句话{extra}", f"译文{i}甲乙丙丁", f"譯文{i}子丑寅卯辰", f"译文{i}子丑寅卯辰", f"sig{i}") for k in keys for i in range(n)]
    return spark.createDataFrame(data, "project string, index int, jp string, cn string, tw string, tw_cn string, signature string").withColumn("score", F.lit(0.0))


def none(spark):
    return spark.createDataFrame([], "project string, index int")


def counting(path, answer):
    """A client that writes a line for each request; answer(system, user, n of this client) gives content or raises."""

    def client():
        seen = []

        def call(system, user):
            seen.append(1)
            row = json.loads(user)
            with open(path, "a") as f:
                f.write(json.dumps({"index": row["row"]["index"], "near": len(row["nearbyRows"])}) + "\n")
            return answer(system, row, len(seen))

        return call

    return client


def requests(path):
    return [json.loads(x) for x in path.read_text().splitlines()] if path.exists() else []


SAME = json.dumps({"semanticSame": True, "needsEdit": False, "better": "target"})


def test_each_row_and_round_is_asked_once(spark, tmp_path):
    def answer(system, row, n):
        return json.dumps({"semanticSame": True, "needsEdit": False, "better": "target", "needsContext": row["row"]["index"] == 3 and len(row["nearbyRows"]) < 4})

    cfg = proofread.clean_config({"concurrency": 2, "mode": "trilingual"})
    done = spark.createDataFrame([("p", 5)], "project string, index int")
    out = proofread.run(rows_of(spark, 8), done, counting(tmp_path / "log", answer), cfg, keys=("project",))
    assert sorted((r["index"], r.status, r.done) for r in out.events.collect()) == [(i, "same", True) for i in range(8) if i != 5]
    assert out.events.where("status = 'error'").count() == 0 and out.stops.count() == 0  # used again, and nothing is asked again
    asked = sorted((x["index"], x["near"]) for x in requests(tmp_path / "log"))
    assert asked == sorted([(i, 0) for i in range(8) if i != 5] + [(3, 2), (3, 4)])


def test_breaker_ends_a_run(spark, tmp_path):
    """Every other request fails: ten outcomes with five errors end the run, whatever is left of sixty rows."""

    def answer(system, row, n):
        if row["row"]["index"] % 2:
            raise RuntimeError("HTTP 500")
        return SAME

    cfg = proofread.clean_config({"concurrency": 2, "mode": "trilingual"})
    out = proofread.run(rows_of(spark, 60), none(spark), counting(tmp_path / "log", answer), cfg, keys=("project",))
    events = out.events.collect()
    assert sum(r.status == "error" for r in events) == 5 and len(requests(tmp_path / "log")) <= 12
    assert [tuple(r) for r in out.stops.collect()] == [("p", "errors", 5, 10)]
    assert all("调用失败" in r.note for r in events if r.status == "error")


@pytest.mark.parametrize("answer", [FatalRequestError("HTTP 401"), "<html>no json {oops}</html>"])
def test_fatal_errors_end_a_run_at_once(spark, tmp_path, answer):
    def give(system, row, n):
        if isinstance(answer, Exception):
            raise answer
        return answer

    cfg = proofread.clean_config({"concurrency": 3, "mode": "bilingual"})
    out = proofread.run(rows_of(spark, 20), none(spark), counting(tmp_path / "log", give), cfg, keys=("project",))
    assert len(requests(tmp_path / "log")) <= 4 and {r.reason for r in out.stops.collect()} == {"fatal"}
    assert 1 <= out.events.where("status = 'error'").count() <= 4


def test_projects_are_runs_of_their_own(spark, tmp_path):
    def answer(system, row, n):
        if "bad" in row["row"]["source"]:
            raise FatalRequestError("HTTP 403")
        assert all("bad" not in x["source"] for x in row["nearbyRows"])
        return json.dumps({"semanticSame": True, "needsEdit": False, "better": "target", "needsContext": len(row["nearbyRows"]) < 2})

    rows = rows_of(spark, 15, ("a", "b")).unionByName(rows_of(spark, 15, ("x",), "bad"))
    out = proofread.run(rows, none(spark), counting(tmp_path / "log", answer), proofread.clean_config({"concurrency": 2}), keys=("project",))
    by = {k: 0 for k in "abx"}
    for r in out.events.collect():
        by[r.project] += 1
    assert by["a"] == by["b"] == 15 and by["x"] <= 2 and [r.project for r in out.stops.collect()] == ["x"]


def test_stop_is_heard_between_rows_and_waves(spark, tmp_path):
    flag = tmp_path / "stop"

    def answer(system, row, n):
        if n == 3:
            flag.write_text("")
        return SAME

    out = proofread.run(rows_of(spark, 60), none(spark), counting(tmp_path / "log", answer), proofread.clean_config({"concurrency": 1}), keys=("project",), stop=flag.exists)
    assert len(requests(tmp_path / "log")) == 3 and out.events.count() == 3
    assert [(r.reason, r.seen) for r in out.stops.collect()] == [("stopped", 3)]


def test_messages(spark):
    near = [{"index": 4, "relative": -1, "round": 1, "source": "s", "target": "t", "counterpart": "c"}]
    row = {"index": 5, "source": "A", "target": "B", "counterpart": "C", "helper": "- x\n+ y"}
    for mode in ("bilingual", "trilingual"):
        cfg = proofread.clean_config({"mode": mode, "target": "tw"})
        system, user = proofread.messages(row, near, cfg, {"cn": "简"})
        assert system.endswith(proofread.MARKUP_RULE) and proofread.MODE_RULE[mode] in system and "noteref" in system
        said = json.loads(user)
        assert said["comparisonMode"] == mode and set(said["outputSchema"]) == {"semanticSame", "needsEdit", "needsContext", "better", "severity", "summary", "revisedText"}
        assert said["contextBudget"] == {"maxRounds": 6, "maxRows": 12, "maxChars": 6000} and said["row"]["diffHelper"] == "- x\n+ y"
        assert said["nearbyRows"][0]["position"] == "前 1 行" and said["contextExpansion"]["rounds"] == 1 and said["contextPolicy"] == proofread.CONTEXT_RULE[True]
        assert (said["row"]["targetLabel"], said["row"]["counterpartLabel"]) == (("简", "原文 A") if mode == "bilingual" else ("非原文 C", "简"))
    own = proofread.clean_config({"system": "own words"})
    assert proofread.messages(row, [], own, {})[0].startswith("own words\n") and proofread.MARKUP_RULE in proofread.messages(row, [], own, {})[0]


def test_options():
    assert proofread.model_options([" a ", "b", "a", "custom", ""], "b") == {"models": ["a", "b"], "options": ["a", "b", "custom"], "selected": "b"}
    assert proofread.model_options([], "x")["selected"] == "custom" and proofread.model_options(["a"], "x")["selected"] == "a"
    saved = {"base_url": "http://h/v1/", "model_options_base_url": "http://h/v1", "model_options": ["a", " ", "b "]}
    assert proofread.restorable_options(saved) == ["a", "b"]
    assert proofread.restorable_options({**saved, "base_url": "http://other"}) == proofread.restorable_options(None) == proofread.restorable_options({**saved, "model_options": "a"}) == []
    assert proofread.clean_config({"threshold": None}).threshold == 0.5 and proofread.clean_config({"concurrency": 99}).concurrency == 12


def test_a_wave_and_the_last_outcomes_say_what_the_whole_log_says(spark):
    import random

    rng = random.Random(9)
    rows = [(f"r{n}", i, "e" if rng.random() < rate else None, False) for n, rate in enumerate([0.1, 0.3, 0.4, 0.45, 0.6] * 6) for i in range(1, 91)]
    log = spark.createDataFrame(rows, "run string, place long, error string, fatal boolean").cache()
    whole = {r.run: r.trip_at for r in context.trip_point(log, F.col("error").isNotNull(), ["run"], ["place"]).collect()}
    for before, to in ((0, 10), (10, 30), (30, 90)):
        recent = log.where((F.col("place") > before - context.LAST) & (F.col("place") <= to))
        want = {run for run, place in whole.items() if place <= before}  # those have ended; of the others the ones that trip in the wave
        got = {r.run for r in proofread.ended(recent, before).collect()} - want
        assert got == {run for run, place in whole.items() if before < place <= to}
    assert 0 < len(whole) < 30


def test_places_count_each_run(spark):
    rows = [(f"r{i % 3}", 7 * i % 1000, i) for i in range(300)]
    got = proofread.placed(spark.createDataFrame(rows, "run string, index int, x int").repartition(5), kept_in(spark)).collect()
    for run in ("r0", "r1", "r2"):
        mine = sorted((r["index"], r.place) for r in got if r.run == run)
        assert [p for _, p in mine] == list(range(1, 101))
