"""The external text function: calls with retries, a fallback and splitting, answers checked, cached and reviewed.

A batch is a row: batch_id, cues, before, after (arrays of cue_id, cue_index, source). Calls are made in ``mapInArrow`` with a function
that is given in; the one here answers without a network, for tests and dry runs. A task that is run again calls
again, so answers belong into the cache, whose key makes the step repeatable.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Kinds of errors, and which of them lead to the fallback or to halves.
PROVIDER_ERRORS = ("provider_timeout", "provider_http_5xx", "provider_request_failed", "provider_missing_choices")
FALLBACK_ON = (*PROVIDER_ERRORS, "invalid_json")
SPLIT_ON = ("invalid_json", "schema_mismatch", "missing_required_cue_id", "duplicate_cue_id", "invalid_cue_id", "context_cue_output_violation", "empty_translation")
MAX_SPLITS = 2
SPLIT_VERSION = "v1"
INVALID_JSON = "translation response is not valid JSON"


class CallError(Exception):
    """A failed call or an answer that can't be used; ``kind`` is one of the kinds above or None."""

    def __init__(self, kind: str | None, message: str):
        super().__init__(message)
        self.kind = kind


@dataclass(frozen=True)
class Batch:
    batch_id: int
    cues: list[dict]
    before: list[dict] = field(default_factory=list)
    after: list[dict] = field(default_factory=list)


@dataclass(frozen=True)
class Policy:
    """How often a batch is tried; ``structured`` asks for exact answers by cue_id and allows halves."""

    max_retries: int = 3
    fallback: bool = False
    structured: bool = True

    def __post_init__(self):
        if self.max_retries < 0:
            raise ValueError("max_retries must be 0 or more")


def without_fence(text: str) -> str:
    whole = text.strip()
    lines = whole.splitlines()
    fenced = len(lines) > 1 and lines[0] in ("```", "```json") and lines[-1] == "```"
    return "\n".join(lines[1:-1]).strip() if fenced else whole


def body_content(body: str) -> str:
    """The message of a provider's answer: JSON, after which only end marks of a stream may stand."""
    whole = body.lstrip()
    try:
        value, end = json.JSONDecoder().raw_decode(whole)
    except ValueError as e:
        raise CallError("provider_request_failed", "translation provider returned invalid JSON") from e
    if any(x.strip() and x != "data: [DONE]" for x in whole[end:].strip().splitlines()):
        raise CallError("provider_request_failed", "translation provider returned invalid JSON")
    try:
        content = value["choices"][0]["message"]["content"]
    except (KeyError, IndexError, TypeError):
        content = None
    if not isinstance(content, str):
        raise CallError("provider_missing_choices", "translation provider response missing choices[0].message.content")
    return content


def record_ids(batch: Batch) -> dict[int, str]:
    """The name of each cue of a batch and its context, by index: its id where that is unique, else its index."""
    every = [*batch.before, *batch.cues, *batch.after]
    names = [c["cue_id"].strip() for c in every]
    out = {c["cue_index"]: n if n and names.count(n) == 1 else str(c["cue_index"]) for c, n in zip(every, names, strict=True)}
    if len(set(out.values())) < len(every):
        raise CallError(None, f"batch_id {batch.batch_id} generated non-unique structured cue_ids")
    return out


def _items(text: str, n: int, structured: bool) -> list:
    try:
        value = json.loads(without_fence(text))
    except ValueError as e:
        raise CallError("invalid_json", INVALID_JSON) from e
    kind = "schema_mismatch" if structured else None
    if not isinstance(value, list):
        raise CallError(kind, "translation response must be a JSON array")
    if len(value) != n:
        raise CallError(kind, f"translation count {len(value)} does not match cue count {n}")
    return value


def read_plain(text: str, batch: Batch) -> dict[str, str]:
    """Answers by id: as many as cues, each with strings, each cue answered and not blank; the last of several with one id counts."""
    out: dict[str, str] = {}
    for item in _items(text, len(batch.cues), False):
        if not isinstance(item, dict):
            raise CallError(None, "translation item must be an object")
        if not isinstance(item.get("id"), str):
            raise CallError(None, "translation item id must be a string")
        if not isinstance(item.get("translation"), str):
            raise CallError(None, f"cue id {item['id']} translation must be a string")
        out[item["id"]] = item["translation"]
    _check_complete(batch, out)
    return {c["cue_id"]: out[c["cue_id"]] for c in batch.cues}


def _check_complete(batch: Batch, answers: dict[str, str]) -> None:
    if len(answers) != len(batch.cues):
        raise CallError(None, f"translation count {len(answers)} does not match cue count {len(batch.cues)}")
    seen: set[str] = set()
    for c in batch.cues:
        name = c["cue_id"]
        problem = (
            f"cue index {c['cue_index']} id is empty" if not name.strip()
            else f"duplicate cue id: {name}" if name in seen
            else f"cue id {name} source is empty" if not (c["source"] or "").strip()
            else f"missing translation for cue id {name}" if name not in answers
            else f"translation for cue id {name} is empty" if not answers[name].strip()
            else None
        )
        if problem:
            raise CallError(None, problem)
        seen.add(name)


def read_structured(text: str, batch: Batch) -> dict[str, str]:
    """Answers by cue_id: exactly its two keys, every cue once, none of the context and none unknown; the first fault counts."""
    names = record_ids(batch)
    targets = {names[c["cue_index"]] for c in batch.cues}
    context = {names[c["cue_index"]] for c in (*batch.before, *batch.after)}
    out: dict[str, str] = {}
    for item in _items(text, len(batch.cues), True):
        if not isinstance(item, dict):
            raise CallError("schema_mismatch", "translation item must be an object")
        if set(item) != {"cue_id", "translation"}:
            raise CallError("schema_mismatch", "translation item keys must exactly match cue_id and translation")
        name, said = item["cue_id"], item["translation"]
        if not isinstance(name, str) or not name.strip():
            raise CallError("missing_required_cue_id", "translation item cue_id must be a non-empty string")
        if name in out:
            raise CallError("duplicate_cue_id", f"duplicate cue_id {name}")
        if name not in targets:
            raise CallError("context_cue_output_violation" if name in context else "invalid_cue_id", f"unexpected cue_id {name}")
        if not isinstance(said, str):
            raise CallError("schema_mismatch", f"cue_id {name} translation must be a string")
        if not said.strip():
            raise CallError("empty_translation", f"translation for cue_id {name} is empty")
        out[name] = said
    if missing := sorted(targets - set(out)):
        raise CallError("missing_required_cue_id", f"missing translation for cue_id {missing[0]}")
    by_id = {c["cue_id"]: out[names[c["cue_index"]]] for c in batch.cues}
    _check_complete(batch, by_id)
    return by_id


def read_review(text: str, ids: list[str]) -> dict[str, str]:
    """The fixes of a review: one item for each candidate in their order, each to keep or fix with text and reason; any fault rejects all."""
    try:
        value = json.loads(without_fence(text))
    except ValueError as e:
        raise CallError(None, "QA response is not valid JSON") from e
    if not isinstance(value, list):
        raise CallError(None, "QA response must be a JSON array")
    if len(value) != len(ids):
        raise CallError(None, "QA response item count does not match candidate count")
    fixes, seen = {}, set()
    filled = lambda x: isinstance(x, str) and bool(x.strip())
    for want, item in zip(ids, value, strict=True):
        if not isinstance(item, dict):
            raise CallError(None, "QA response item must be an object")
        name = item.get("id")
        for wrong, message in (
            (not isinstance(name, str) or name not in ids, "QA response id does not match candidates"),
            (name in seen if isinstance(name, str) else False, "QA response contains duplicate id"),
            (name != want, "QA response id order does not match candidates"),
            (item.get("action") not in ("keep", "fix"), "QA response action must be keep or fix"),
            (not filled(item.get("translation")), "QA response translation must be a non-empty string"),
            (not filled(item.get("reason")), "QA response reason must be a non-empty string"),
        ):
            if wrong:
                raise CallError(None, message)
        seen.add(name)
        if item["action"] == "fix":
            fixes[name] = item["translation"]
    return fixes


#: (batch, attempt from 1, route main or fallback) -> answer; raises CallError.
Provider = Callable[[Batch, int, str], str]


def offline(batch: Batch, attempt: int, route: str) -> str:
    """A deterministic answer without a network: each source in brackets."""
    names = record_ids(batch)
    return json.dumps([{"cue_id": names[c["cue_index"]], "translation": f"[{c['source']}]"} for c in batch.cues], ensure_ascii=False)


@dataclass
class Outcome:
    answers: dict[str, str] | None
    calls: int
    fallback_calls: int
    retries: int
    attempts: int
    error: str | None
    route: str | None
    response: str | None = None
    children: tuple[int, ...] = ()
    split_attempt: int | None = None
    message: str | None = None


def routed(batch: Batch, provider: Provider, policy: Policy) -> Outcome:
    """A batch by its routes: main up to max_retries + 1 times, then the fallback once if the last error is of its kinds."""
    read = read_structured if policy.structured else read_plain
    calls = fallback_calls = 0
    error = message = None
    for attempt in range(1, policy.max_retries + 3):
        route = "main" if attempt <= policy.max_retries + 1 else "fallback"
        if route == "fallback" and not (policy.fallback and error in FALLBACK_ON):
            break
        calls += 1
        fallback_calls += route == "fallback"
        try:
            text = provider(batch, attempt, route)
            return Outcome(read(text, batch), calls, fallback_calls, calls - 1, calls, error, route, text)
        except CallError as e:
            # a failed fallback doesn't change what the main route failed with
            error, message = (e.kind if route == "main" or error is None else error), str(e)
    return Outcome(None, calls, fallback_calls, max(calls - 1, 0), calls, error, None, message=message)


def executed(batch: Batch, provider: Provider, policy: Policy, next_id: int, depth: int = 0) -> Outcome:
    """A batch by its routes, or else its halves, which keep its outer context; a half that fails fails the batch.

    Children are named from ``next_id`` on, in the order of the splits.
    """
    own = routed(batch, provider, policy)
    if own.answers is not None or not policy.structured or len(batch.cues) < 2 or depth >= MAX_SPLITS or own.error not in SPLIT_ON:
        return own
    mid = len(batch.cues) // 2
    ids, taken = (next_id, next_id + 1), next_id + 2
    results = []
    for name, cues in zip(ids, (batch.cues[:mid], batch.cues[mid:]), strict=True):
        got = executed(Batch(name, cues, batch.before, batch.after), provider, policy, taken, depth + 1)
        taken = max([taken, *(c + 1 for c in got.children)])
        results.append(got)
        if got.answers is None:
            break
    total = lambda f: f(own) + sum(map(f, results))
    counts = (total(lambda o: o.calls), total(lambda o: o.fallback_calls), total(lambda o: o.retries))
    if len(results) < 2 or results[-1].answers is None:
        return Outcome(None, *counts, own.calls + sum(r.attempts for r in results), results[-1].error, None, message=results[-1].message)
    merged = results[0].answers | results[1].answers
    children = (*ids, *(c for r in results for c in r.children))
    return Outcome({c["cue_id"]: merged[c["cue_id"]] for c in batch.cues}, *counts, own.calls + sum(r.attempts for r in results), own.error, "shrink", None, children, depth + 1)


_CUE = "struct<cue_id:string,cue_index:bigint,source:string>"
BATCH_SCHEMA = f"batch_id long, cues array<{_CUE}>, before array<{_CUE}>, after array<{_CUE}>"
RESULT_SCHEMA = (
    "video_id {id}, batch_id long, state string, cue_count long, attempts long, calls long, fallback_calls long, retries long, error_type string, route string, "
    "child_batch_ids array<long>, split_attempt long, response string, answers array<struct<cue_id:string,translation:string>>, message string"
)


def made_batches(cues: DataFrame, size: int, before: int, after: int) -> DataFrame:
    """video_id, batch_id, cues, before, after of every batch of ``size`` cues of a video, in order; nothing but the grouping is shuffled."""
    if size <= 0 or before < 0 or after < 0:
        raise ValueError("a batch has cues, and no negative context")
    item = F.struct("cue_index", F.col("cue_id").cast("string").alias("cue_id"), "source")
    lists = cues.groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x.cue_id.alias("cue_id"), x.cue_index.alias("cue_index"), x.source.alias("source"))).alias("every"))
    ids = lists.select("video_id", "every", F.explode(F.sequence(F.lit(1), F.ceil(F.size("every") / size).cast("int"))).alias("batch_id"))
    lo = (F.col("batch_id") - 1) * size
    n = F.least(F.lit(before), lo)
    part = lambda start, count: F.slice("every", start, count)
    return ids.select("video_id", F.col("batch_id").cast("long").alias("batch_id"), part(lo + 1, F.lit(size)).alias("cues"), part(F.greatest(lo + 1 - n, F.lit(1)), n).alias("before"), part(lo + size + 1, F.lit(after)).alias("after"))


def translated(batches: DataFrame, provider: Provider = offline, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """A result for each batch: its state, attempts, route, error, children and answers, in the order of its cues.

    Children of a video's batches are named from after its last batch, each parent's from a range of its own, so that
    names don't depend on which task is done first.
    """
    kind = batches.schema["video_id"].dataType.simpleString()
    named = batches.withColumn("top", F.max("batch_id").over(Window.partitionBy("video_id")))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in rows:
            if schema is None:
                schema = pa.schema([batch.schema.field("video_id"), *_RESULT_FIELDS])
            out = []
            for r in batch.to_pylist():
                got = executed(Batch(r["batch_id"], r["cues"], r["before"], r["after"]), provider, policy, r["top"] + 1 + 6 * (r["batch_id"] - 1))
                answers = [{"cue_id": k, "translation": v} for k, v in (got.answers or {}).items()]
                out.append(
                    {"video_id": r["video_id"], "batch_id": r["batch_id"], "state": "success" if got.answers is not None else "failed_permanent", "cue_count": len(r["cues"]), "attempts": got.attempts,
                     "calls": got.calls, "fallback_calls": got.fallback_calls, "retries": got.retries, "error_type": got.error, "route": got.route, "child_batch_ids": list(got.children[:2]),
                     "split_attempt": got.split_attempt, "response": got.response, "answers": answers, "message": got.message}
                )
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return named.select("video_id", "batch_id", "cues", "before", "after", "top").mapInArrow(run, RESULT_SCHEMA.format(id=kind))


_PAIR = pa.struct([("cue_id", pa.string()), ("translation", pa.string())])
_RESULT_FIELDS = [
    *((n, pa.string() if n == "state" else pa.int64()) for n in ("batch_id", "state", "cue_count", "attempts", "calls", "fallback_calls", "retries")),
    ("error_type", pa.string()), ("route", pa.string()), ("child_batch_ids", pa.list_(pa.int64())), ("split_attempt", pa.int64()), ("response", pa.string()),
    ("answers", pa.list_(_PAIR)), ("message", pa.string()),
]


def checked(responses: DataFrame, *, structured: bool = True) -> DataFrame:
    """video_id, batch_id, error_type, message and answers of ``responses`` (batches with a column response): each read as an answer."""
    kind = responses.schema["video_id"].dataType.simpleString()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            schema = pa.schema([batch.schema.field("video_id"), ("batch_id", pa.int64()), ("ok", pa.bool_()), ("error_type", pa.string()), ("message", pa.string()), ("answers", pa.list_(_PAIR))])
            out = []
            for r in batch.to_pylist():
                row = {"video_id": r["video_id"], "batch_id": r["batch_id"], "ok": True, "error_type": None, "message": None, "answers": []}
                try:
                    got = (read_structured if structured else read_plain)(r["response"] or "", Batch(r["batch_id"], r["cues"], r["before"], r["after"]))
                    row["answers"] = [{"cue_id": k, "translation": v} for k, v in got.items()]
                except CallError as e:
                    row |= {"ok": False, "error_type": e.kind, "message": str(e)}
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return responses.select("video_id", "batch_id", "cues", "before", "after", "response").mapInArrow(run, f"video_id {kind}, batch_id long, ok boolean, error_type string, message string, answers array<struct<cue_id:string,translation:string>>")


def reviewed(reviews: DataFrame) -> DataFrame:
    """video_id, ok, message and fixes of ``reviews`` (video_id, ids, response): one review of all candidates of a video."""
    kind = reviews.schema["video_id"].dataType.simpleString()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            schema = pa.schema([batch.schema.field("video_id"), ("ok", pa.bool_()), ("message", pa.string()), ("fixes", pa.list_(_PAIR))])
            out = []
            for r in batch.to_pylist():
                row = {"video_id": r["video_id"], "ok": True, "message": None, "fixes": []}
                try:
                    row["fixes"] = [{"cue_id": k, "translation": v} for k, v in read_review(r["response"] or "", r["ids"]).items()]
                except CallError as e:
                    row |= {"ok": False, "message": str(e)}
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return reviews.select("video_id", "ids", "response").mapInArrow(run, f"video_id {kind}, ok boolean, message string, fixes array<struct<cue_id:string,translation:string>>")


def overlaid(translations: DataFrame, fixes: DataFrame) -> DataFrame:
    """``translations`` (video_id, cue_id, translation) with the fixes of a review in their place; all others stay as they are."""
    named = fixes.select("video_id", "cue_id", F.col("translation").alias("fix"))
    return translations.join(named, ["video_id", "cue_id"], "left").withColumn("translation", F.coalesce("fix", "translation")).withColumn("is_fixed", F.col("fix").isNotNull()).drop("fix")


def in_parent_order(parents: DataFrame, children: DataFrame) -> DataFrame:
    """The answers of child batches (parent_id, cue_id, translation) in the order of their parents' cues (batch_id, cues)."""
    order = parents.select(F.col("batch_id").alias("parent_id"), F.posexplode("cues").alias("pos", "c")).select("parent_id", "pos", "c.cue_id")
    return order.join(children, ["parent_id", "cue_id"]).select("parent_id", F.col("pos").cast("long").alias("pos"), "cue_id", "translation")


def split_faults(parents: DataFrame, halves: DataFrame) -> DataFrame:
    """Parents (batch_id, cues) whose halves (batch_id, half, cues; arrays of ids) share an id or aren't the parent in order."""
    both = halves.groupBy("batch_id").agg(F.max(F.when(F.col("half") == 0, F.col("cues"))).alias("left"), F.max(F.when(F.col("half") == 1, F.col("cues"))).alias("right"))
    reason = F.when(F.arrays_overlap("left", "right"), "shared id").when(F.concat("left", "right") != F.col("cues"), "not the parent")
    return parents.join(both, "batch_id").select("batch_id", reason.alias("reason")).filter("reason is not null")


def adaptive(events: DataFrame, most: int, least: int = 1) -> DataFrame:
    """How many calls run at once after each event (run_id, pos, ok) of a run: one fewer after an error, one more after two successes.

    A fold over a run's events in order, as a stream over sorted rows with a state of two numbers.
    """
    if not 1 <= least <= most:
        raise ValueError("1 <= least <= most")
    kind = events.schema["run_id"].dataType.simpleString()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_id, now, streak = None, most, 0
        for batch in rows:
            out = []
            for own, ok in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if own != run_id:
                    run_id, now, streak = own, most, 0
                change = 0
                if not ok:
                    change, streak = (-1 if now > least else 0), 0
                else:
                    streak += 1
                    if streak >= 2 and now < most:
                        change, streak = 1, 0
                now += change
                out.append((now, change))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=["run_id", "pos", "at_once", "change"])

    ordered = events.select("run_id", F.col("pos").cast("long").alias("pos"), "ok").repartition("run_id").sortWithinPartitions("run_id", "pos")
    return ordered.mapInArrow(run, f"run_id {kind}, pos long, at_once long, change long")


# The cache: a table whose key is cache_key.
CACHE_COLUMNS = (
    "cache_key", "engine_version", "structured_output", "provider", "base_url", "model", "main_model_alias", "target_lang", "prompt_version",
    "output_schema_version", "batching_strategy_version", "glossary_hash", "context_hash", "batch_source_hash", "result_json", "updated_at",
)
_LATER = {"engine_version": "", "structured_output": 0, "base_url": "", "main_model_alias": "", "output_schema_version": "", "batching_strategy_version": ""}


def migrated(cache: DataFrame) -> DataFrame:
    """An older cache with the columns that were added later, at their defaults."""
    missing = {c: F.lit(v) for c, v in _LATER.items() if c not in cache.columns}
    return cache.withColumns(missing).select(*[c for c in CACHE_COLUMNS if c in {*cache.columns, *missing}])


def looked_up(batches: DataFrame, cache: DataFrame) -> DataFrame:
    """``batches`` (with cache_key) and the answer that the cache holds, null if none; whether it is a hit only reading it can tell."""
    return batches.join(cache.select("cache_key", F.col("result_json").alias("response")), "cache_key", "left")


def stored(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with ``new`` answers: one row for each key, the latest; equal times by the answer itself. Aggregated before anything is sent."""
    every = cache.unionByName(new, allowMissingColumns=True)
    row = F.struct(*[c for c in every.columns if c != "cache_key"])
    return every.groupBy("cache_key").agg(F.max_by(row, F.struct("updated_at", "result_json")).alias("r")).select("cache_key", "r.*")


def cacheable(results: DataFrame) -> DataFrame:
    """Only answers of the main route are stored."""
    return results.filter("route = 'main' and response is not null")


def counters(results: DataFrame) -> DataFrame:
    """The counts of a run, by video: sums, so that partial results add up in any order."""
    sums = [F.sum(c).cast("long").alias(c) for c in ("calls", "fallback_calls", "retries")]
    return results.groupBy("video_id").agg(F.count("*").alias("total_batches"), *sums, F.count_if(F.col("state") != "success").cast("long").alias("failed_batches"))


def id_class(name: Column, targets: Column, context: Column) -> Column:
    """What is wrong with a returned name; null if it is a target."""
    return F.when(F.array_contains(targets, name), F.lit(None).cast("string")).when(F.array_contains(context, name), "context_cue_output_violation").otherwise("invalid_cue_id")
