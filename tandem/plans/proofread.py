"""Proofreading rows with a model behind an interface: what is asked, how often context is added, what stops a run."""

from __future__ import annotations

import json
import re
import urllib.error
import urllib.request
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import decisions
from ..functions import text as T
from ..functions.decisions import BETTER, TRUE
from ..operators import context, diff, prefilter
from ..operators.context import CHARS, LAST, LEAST, RATE, ROUNDS, ROWS
from .compare import kept_in
from .store import scratch

FATAL = [400, 401, 403, 404, 405, 415, 422]
TIMEOUT = 90
#: Defaults by provider.
PROVIDERS = {"local": "http://127.0.0.1:1234/v1", "openai": "https://api.openai.com/v1", "claude": "https://api.anthropic.com/v1"}
#: What a model is told, by mode. The names of the answer's fields are fixed, as decisions are read by them.
SHARED = (
    "You review translations for publication. Judge meaning, omissions, additions, register, terms and fluency. Change as little as possible, and nothing for taste alone. "
    "Answer with one JSON object of the given schema and nothing else. severity is critical where the meaning is wrong or lost, major where a reader would stumble or be misled, minor for small flaws, none where nothing is to be changed. "
    "revisedText holds the whole target after the change, never a part of it; it is empty where needsEdit is false."
)
SYSTEM = {
    "bilingual": f"{SHARED}\nTwo texts: A is the original, B its only translation and the only text to change. semanticSame says whether B carries all of A's meaning. A is no candidate: never copy A into B. better is target if B stays, else usually neither.",
    "trilingual": f"{SHARED}\nThree texts: A is the original, B and C are translations of equal standing. Only the target is to be changed. semanticSame compares the target with the other translation; if they differ and the target is the better one, needsEdit is false and better is target. better=counterpart takes over the other's better parts into the target and keeps what is right in it.",
}
#: Added to every system text, also to one that a user has written.
MODE_RULE = {
    "bilingual": "Two texts: change B alone, by the meaning of A; a change is given as the complete B in B's own language and style.",
    "trilingual": "Three texts: change the chosen target alone, with an eye on A and on the other translation.",
}
MARKUP_RULE = "Hard rule of format: EPUB note references (noteref markup) in the target are kept in revisedText word for word and in their place; no tag, attribute or content of them may change."
POLICY = {"bilingual": "Judge how B stands to A; only B can be changed, A settles the meaning and what is missing.", "trilingual": "Judge whether the target is right, fluent and true to A, with the other translation beside it."}
CONTEXT_RULE = {
    False: "Only the row itself is given. If it is not enough, answer needsContext=true; do not guess, and do not ask for context to be safe.",
    True: "Rows before and after are given. If they are still not enough, answer needsContext=true; else give the final judgement.",
}
#: Fields of the answer and what they hold.
SCHEMA = {"semanticSame": "boolean", "needsEdit": "boolean", "needsContext": "boolean", "better": "target | counterpart | neither | unclear", "severity": "critical | major | minor | none", "summary": "string", "revisedText": "string"}
NO_DIFFERENCE = "No word differences are made across languages; judge by meaning."
LABELS = {"jp": "原文 A", "cn": "非原文 B", "tw": "非原文 C"}


@dataclass(frozen=True)
class Config:
    """A run's settings in their bounds."""

    provider: str = "local"
    target: str = "cn"
    mode: str = "bilingual"
    concurrency: int = 3
    threshold: float = 0.92
    model: str = "local-model"
    base_url: str = ""
    temperature: float | None = 0.2
    effort: str | None = None
    system: str = ""

    @property
    def roles(self) -> tuple[str, str]:
        """The column that may change and the one beside it."""
        return ("cn", "jp") if self.mode == "bilingual" else ("tw", "cn") if self.target == "tw" else ("cn", "tw")


def _number(value, low, high, fallback, whole=False):
    """null counts as 0; only what is no number takes the fallback."""
    try:
        n = float(value if value not in (None, "") else 0)
    except (TypeError, ValueError):
        return fallback
    if n != n or n in (float("inf"), float("-inf")):
        return fallback
    n = int(n + 0.5) if whole else n
    return max(low, min(high, n))


def clean_config(given: dict) -> Config:
    provider = given.get("provider") if given.get("provider") in PROVIDERS else "local"
    mode = "trilingual" if given.get("mode") == "trilingual" else "bilingual"
    model = str(given.get("model") or "local-model").strip()
    gpt = re.match(r"(?i)^(gpt|o\d)", model) is not None
    temperature = None if gpt else round(_number(given.get("temperature", 0.2), 0.0, 1.0, 0.2), 1)
    effort = (given.get("effort") if given.get("effort") in ("minimal", "low", "medium", "high") else "medium") if gpt else None
    concurrency = _number(given["concurrency"], 1, 12, 3, True) if "concurrency" in given else 3
    threshold = _number(given["threshold"], 0.5, 1.0, 0.92) if "threshold" in given else 0.92
    base = str(given.get("base_url") or PROVIDERS[provider]).strip().rstrip("/")
    return Config(provider, "tw" if given.get("target") == "tw" else "cn", mode, concurrency, threshold, model, base, temperature, effort, str(given.get("system") or "").strip() or SYSTEM[mode])


class FatalRequestError(RuntimeError):
    pass


def http_client(config: Config, key: str = "") -> Callable[[str, str], str]:
    """A client (system, user) -> content for servers that speak either of the two usual chat forms."""

    def call(system: str, user: str) -> str:
        head = {"Content-Type": "application/json"}
        if config.provider == "claude":
            url, head = f"{config.base_url}/messages", head | {"x-api-key": key, "anthropic-version": "2023-06-01"}
            body = {"model": config.model, "max_tokens": 4096, "system": system, "messages": [{"role": "user", "content": user}]}
        else:
            url, head = f"{config.base_url}/chat/completions", head | ({"Authorization": f"Bearer {key}"} if key else {})
            body = {"model": config.model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}], "response_format": {"type": "json_object"}}
        body |= {"temperature": config.temperature} if config.temperature is not None else {"reasoning_effort": config.effort}
        try:
            with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), head), timeout=TIMEOUT) as r:
                data = json.loads(r.read())
        except urllib.error.HTTPError as e:
            raise (FatalRequestError if e.code in FATAL else RuntimeError)(f"HTTP {e.code}") from e
        except json.JSONDecodeError as e:
            raise FatalRequestError("the answer is no JSON") from e
        return "".join(c.get("text", "") for c in data.get("content", [])) if config.provider == "claude" else data["choices"][0]["message"]["content"]

    return call


def model_list(models: DataFrame, fallback: list[str]) -> DataFrame:
    """Distinct ids (id), trimmed, in order; the fallback where there is none."""
    found = models.select(T.strip("id").alias("id")).where("id <> ''").distinct()
    spare = models.sparkSession.createDataFrame([(x,) for x in fallback], "id string")
    return found.unionByName(spare.join(found.select(F.lit(1).alias("_x")).limit(1), F.lit(True), "left_anti")).orderBy("id")


def model_options(models: list[str], selected: str = "") -> dict:
    """What a user chooses from: the distinct models in their order and `custom`; the selected one if it is among them, else the first."""
    known = list(dict.fromkeys(m for m in (str(x or "").strip() for x in models) if m and m != "custom"))
    chosen = str(selected or "").strip()
    return {"models": known, "options": [*known, "custom"], "selected": chosen if chosen in known else known[0] if known else "custom"}


def restorable_options(saved: dict | None) -> list[str]:
    """Stored models, if they were listed by the server that is still set."""
    plain = lambda key: str((saved or {}).get(key) or "").strip().rstrip("/")
    given = (saved or {}).get("model_options")
    return [m for m in (str(x or "").strip() for x in given) if m] if isinstance(given, list) and plain("base_url") and plain("base_url") == plain("model_options_base_url") else []


def messages(row: dict, around: list[dict], config: Config, labels: dict[str, str]) -> tuple[str, str]:
    """(system, user) for a row (index, source, target, counterpart, helper) and the context items so far."""
    target, other = (labels.get(r) or LABELS[r] for r in config.roles)
    near = [{"index": int(c["index"]), "relative": int(c["relative"]), "position": f"{'前' if c['relative'] < 0 else '后'} {abs(c['relative'])} 行", "source": c["source"], "target": c["target"], "counterpart": c["counterpart"]} for c in around]
    user = {
        "task": f"{config.mode} review; target: {target}", "comparisonMode": config.mode, "modePolicy": POLICY[config.mode], "contextPolicy": CONTEXT_RULE[bool(near)],
        "contextBudget": {"maxRounds": ROUNDS, "maxRows": ROWS, "maxChars": CHARS}, "outputSchema": SCHEMA,
        "row": {"index": row["index"], "source": row["source"], "targetLabel": target, "targetText": row["target"], "counterpartLabel": other, "counterpartText": row["counterpart"], "diffHelper": row["helper"]},
        "contextExpansion": {"rounds": -(-len(near) // 2), "strategy": f"each round adds the row before and the row after, up to {ROUNDS} rounds"}, "nearbyRows": near,
    }
    return "\n".join([config.system, MODE_RULE[config.mode], MARKUP_RULE]), json.dumps(user, ensure_ascii=False, indent=2, default=int)


def wants_context(content: str | None) -> bool:
    """Whether an answer asks for context or leaves open which text is better. Text that is no JSON is an error."""
    found = re.search(r"\{[\s\S]*\}", content or "")
    answer = json.loads(found[0]) if found else {}
    return str(answer.get("needsContext", "")).lower() in TRUE or str(answer.get("better", "unclear")).strip().lower() in ("", *BETTER["unclear"])


def question(row: dict, call, config: Config, labels: dict[str, str]) -> dict:
    """One row's content or error: asked without context first; while the answer wants context, one more ring joins."""
    items, rounds = sorted(row["context"] if row["context"] is not None else [], key=lambda c: c["index"]), 0
    while True:
        try:
            content = call(*messages(row, [c for c in items if c["round"] <= rounds], config, labels))
            more = wants_context(content) and any(c["round"] > rounds for c in items)
        except (FatalRequestError, json.JSONDecodeError) as e:
            return {"content": None, "error": str(e) if isinstance(e, FatalRequestError) else "the answer is no JSON", "fatal": True, "rounds": rounds}
        except Exception as e:  # any other failed call is this row's error
            return {"content": None, "error": f"{type(e).__name__}: {e}", "fatal": False, "rounds": rounds}
        if not more:
            return {"content": content, "error": None, "fatal": False, "rounds": rounds}
        rounds += 1


def ask(rows: DataFrame, client: Callable[[], Callable[[str, str], str]], config: Config, labels: dict[str, str], stop: Callable[[], bool] | None = None) -> DataFrame:
    """Of rows (run, place, index, source, target, counterpart, helper, context) those that were asked: run, place, content or error, fatal, rounds.

    client() is made once for each task, and at most `concurrency` tasks ask at once. A task asks no more for a run of which it has seen a fatal error or the
    breaker's rate of errors, and nothing at all once stop() says so.
    """

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call, closed, last = client(), set(), {}
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                run = row["run"]
                if run in closed or (stop and stop()):
                    continue
                found = question(row, call, config, labels)
                outcomes = last.setdefault(run, deque(maxlen=LAST))
                outcomes.append(found["error"] is not None)
                if found["fatal"] or (len(outcomes) >= LEAST and sum(outcomes) >= RATE * len(outcomes)):
                    closed.add(run)
                out.append({"run": run, "place": row["place"], **found})
            yield pd.DataFrame(out, columns=["run", "place", "content", "error", "fatal", "rounds"])

    return rows.select("run", "place", "index", "source", "target", "counterpart", "helper", "context").repartition(config.concurrency).mapInPandas(task, ANSWER)


STOP = "run string, reason string, errors long, seen long"
ANSWER = "run string, place long, content string, error string, fatal boolean, rounds int"
#: Rows of a run in the first wave, as many as the breaker needs, and at most in a later one.
FIRST_WAVE, MOST_WAVE = LEAST, 2000


class Run(NamedTuple):
    """events: (keys, index, signature, status, done, note). stops: (keys, reason, errors, seen) of runs that ended early, reason `fatal`, `errors` or `stopped`."""

    events: DataFrame
    stops: DataFrame


def run(rows: DataFrame, done: DataFrame, client, config: Config, labels: dict[str, str] | None = None, keys: tuple[str, ...] = (), stop: Callable[[], bool] | None = None) -> Run:
    """Compare rows proofread: pre-screened ones first, the model's answers for the rest. Rows of equal keys are one project and one run; without keys all rows are one.

    Rows are asked in waves that double, in order of index. What a wave answered is written before it is used, so no row is asked twice by what is done with
    the answers, and between the waves the log decides: a run with a fatal error, or with half of its last twenty outcomes failed, takes part in no further
    wave. stop() is asked between the waves and before each row. Rows that were not asked have no event and are pending as before. A task that Spark starts
    again asks its rows again; only the answers of the attempt that is committed count.
    """
    spark, keep, labels, by = rows.sparkSession, kept_in(rows.sparkSession), labels or {}, [*keys, "index"]
    left = keep(prefilter.classify(prefilter.sides(prefilter.pending(rows, done, by), config.mode), config.threshold))
    target, other = config.roles
    name = F.to_json(F.struct(*keys)) if keys else F.lit("")
    texts = rows.select(*by, name.alias("run"), T.text_of("jp").alias("source"), T.text_of(target).alias("target"), T.text_of(other).alias("counterpart"))
    other_cn = F.coalesce(F.nullif(T.text_of("tw_cn"), F.lit("")), T.text_of("tw"))
    helper = F.lit(NO_DIFFERENCE) if config.mode == "bilingual" else diff.summary(T.text_of("cn"), other_cn, labels.get("cn") or LABELS["cn"], labels.get("tw") or LABELS["tw"])
    waiting = left.where("kind is null").select(*by, "signature", helper.alias("helper"))
    queue = keep(placed(context.context(texts, ["run"]).join(waiting, by), keep))
    path, start, size, stopped, waves = scratch(spark), 0, FIRST_WAVE, False, 0
    total = queue.agg(F.max("place")).first()[0] or 0
    answers, stops = spark.createDataFrame([], ANSWER), spark.createDataFrame([], STOP)
    # of what was answered before, a wave needs the last outcomes and two counts of each run
    tail, counts = answers.select("run", "place", "error", "fatal"), stops.select("run", "errors", "seen")
    while start < total and not stopped:
        wave = queue.where((F.col("place") > start) & (F.col("place") <= start + size)).join(stops.select("run"), "run", "left_anti")
        ask(wave, client, config, labels, stop).write.parquet(at := f"{path}/wave={waves}")
        now = spark.read.schema(ANSWER).parquet(at).select("run", "place", "error", "fatal")
        before, start, size, waves, stopped = start, start + size, min(2 * size, MOST_WAVE), waves + 1, bool(stop and stop())
        recent = tail.unionByName(now)
        counts = keep(counts.unionByName(counted(now)).groupBy("run").agg(F.sum("errors").alias("errors"), F.sum("seen").alias("seen")))
        stops = keep(stops.unionByName(ended(recent, before).join(stops.select("run"), "run", "left_anti").select("run", "reason").join(counts, "run")))
        last = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("place")))
        tail = keep(recent.withColumn("_n", last).where(F.col("_n") <= LAST).drop("_n"))
    if waves:
        answers = spark.read.schema(ANSWER).parquet(f"{path}/wave=*")
    if stopped:
        rest = queue.join(answers, ["run", "place"], "left_anti").select("run").distinct().join(stops, "run", "left_anti")
        none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        stops = stops.unionByName(rest.join(counts, "run", "left").select("run", F.lit("stopped").alias("reason"), none("errors"), none("seen")))
    asked = keep(queue.select(*by, "run", "place", "signature", "counterpart").join(answers, ["run", "place"]))
    parsed = decisions.parse(asked.where("error is null"))
    named = lambda role: labels.get(role) or LABELS[role]
    given = decisions.results(decisions.ensure_revised(parsed, target, "counterpart", config.mode), named(target), named(other))
    event = [*by, "signature", "status", "done", "note"]
    failed = asked.where("error is not null").withColumns({"status": F.lit("error"), "done": F.lit(False), "note": F.concat(F.lit(f"{decisions.MARK}\n调用失败："), "error")})
    events = prefilter.results(left, labels, config.mode, keys).unionByName(given.select(event)).unionByName(failed.select(event))
    projects = queue.select(*keys, "run").distinct()
    return Run(events, projects.join(stops, "run").select(*keys, "reason", "errors", "seen"))


def counted(answers: DataFrame) -> DataFrame:
    """(run, errors, seen) of answers."""
    return answers.groupBy("run").agg(F.count_if(F.col("error").isNotNull()).alias("errors"), F.count("*").alias("seen"))


def placed(rows: DataFrame, keep) -> DataFrame:
    """rows with place, their number from 1 in their run in order of index. A run of any size is dealt by ranges, and only the counts of the ranges meet."""
    kept = keep(rows.repartitionByRange("run", "index").sortWithinPartitions("run", "index").withColumn("_id", F.monotonically_increasing_id()))
    part, at = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    cells = kept.groupBy("run", part.alias("_part")).agg(F.count("*").alias("_n"), F.min(at).alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("run").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("run", "_part", (before - F.col("_first") + 1).alias("_shift"))
    return kept.withColumns({"_part": part, "_at": at}).join(cells, ["run", "_part"]).withColumn("place", (F.col("_at") + F.col("_shift")).cast("long")).drop("_id", "_part", "_at", "_shift")


def ended(answers: DataFrame, before: int = 0) -> DataFrame:
    """(run, reason) of runs that end by answers (run, place, error, fatal) after place `before`; of the earlier ones the last LAST of a run are enough."""
    rated = context.rolling_rate(answers, F.col("error").isNotNull(), ["run"], ["place"]).where(F.col("place") > before)
    of = rated.groupBy("run").agg(F.bool_or("fatal").alias("fatal"), F.bool_or("tripped").alias("tripped"))
    return of.where("fatal or tripped").select("run", F.when(F.col("fatal"), "fatal").otherwise("errors").alias("reason"))


def proofread(rows: DataFrame, done: DataFrame, client, config: Config, labels: dict[str, str] | None = None, keys: tuple[str, ...] = (), stop: Callable[[], bool] | None = None) -> DataFrame:
    """The events of run()."""
    return run(rows, done, client, config, labels, keys, stop).events
