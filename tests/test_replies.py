"""Reply texts of every kind, resuming, generation."""

import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from tidewatch.functions.replies import ERROR_MARK, FALLBACK_ADVICE, acceptable
from tidewatch.operators.generate import generate_replies, requests
from tidewatch.operators.replies import apply_fallback, not_yet_answered, parse_replies
from tidewatch.plans.echo_client import BreaksDown, PanelEcho
from tidewatch.session import work_path
from tidewatch.settings import GenerationParams
from tidewatch.streaming import incremental
from tidewatch.streaming.incremental import answer_missing, read_answers, run_batch, run_stream

E20, R10 = "This explanation is long enough", "Call them today"
OK = f'{{"decision": "churn", "explanation": "{E20}", "recommendation": "{R10}"}}'
CASES = [
    (OK, ("ok", "churn", E20, R10)),
    (OK.replace('"churn"', '" ChUrn "').replace(", ", ",\n  "), ("ok", "churn", E20, R10)),
    (f"```json\n{OK}\n```", ("ok", "churn", E20, R10)),
    (f"<think>a\n{{b}}</think>\n{OK}", ("ok", "churn", E20, R10)),
    (f"Sure: {OK} bye", ("ok", "churn", E20, R10)),
    (OK + " }", ("salvaged", "churn", E20 + " [truncated]", R10 + " [truncated]")),
    (OK.replace('"', "'"), ("error", None, None, None)),
    (OK.replace("long enough", "long\nenough"), ("salvaged", "churn", E20.replace("long enough", "long\nenough") + " [truncated]", R10 + " [truncated]")),
    ('{"decision": " churn ", "explanation": "cut', ("error", None, None, None)),
    (f'{{"decision": "retain", "explanation": "{E20}', ("salvaged", "retain", E20 + " [truncated]", "[truncated]")),
    ('{"decision": "retain", "explanation": "short', ("salvaged", "retain", "[truncated]", "[truncated]")),
    (f'{{"decision": "churn", "explanation": "{E20}", "recommendation": "call', ("salvaged", "churn", E20 + " [truncated]", "[truncated]")),
    (OK.replace("churn", "maybe"), ("error", None, None, None)),
    (OK.replace(E20, " "), ("error", None, None, None)),
    ('{"decision": "churn", "recommendation": "x"}', ("error", None, None, None)),
    (f'{{"decision": "churn", "explanation": null, "recommendation": "{R10}"}}', ("error", None, None, None)),
    ("no json at all", ("error", None, None, None)),
    ("", ("error", None, None, None)),
    (OK[:-1] + ', "decision": "retain"}', ("ok", "retain", E20, R10)),
    (OK.replace(E20, 'He said \\"go\\" {now}'), ("ok", "churn", 'He said "go" {now}', R10)),
    ('{"decision": "churn", "explanation": 4.0, "recommendation": true}', ("ok", "churn", "4.0", "True")),
    (OK.replace(E20, "x" * 20000), ("ok", "churn", "x" * 20000, R10)),
]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(i, raw, "CHURN", 1.5) for i, (raw, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "customer_id bigint, raw_reply string, churn_decision string, time_sec double")
    return parse_replies(df)


def test_every_kind_of_reply(parsed):
    rows = parsed.orderBy("customer_id").collect()
    for row, (raw, want) in zip(rows, CASES):
        assert (row["status"], row["decision"], row["explanation"], row["recommendation"]) == want, raw[:80]
        assert acceptable(raw) == (want[0] != "error"), raw[:80]


def test_null_field_in_compat_mode(spark):
    raw = f'{{"decision": "churn", "explanation": null, "recommendation": "{R10}"}}'
    df = spark.createDataFrame([(raw,)], "raw_reply string")
    row = parse_replies(df, compat=True).first()
    assert (row["status"], row["explanation"]) == ("ok", "None")


def test_fallback(parsed):
    rows = {r["customer_id"]: r for r in apply_fallback(parsed).collect()}
    row = rows[16]
    assert (row["decision"], row["explanation"], row["recommendation"], row["time_sec"]) == (
        "churn", ERROR_MARK + "no json at all", FALLBACK_ADVICE, 0.0)
    assert rows[0]["time_sec"] == 1.5


def prompts(spark, n):
    text = F.concat(F.lit("    Prediction       : "), F.when(F.col("id") % 2 == 0, "CHURN").otherwise("RETAIN"),
                    F.lit("\n"), F.repeat(F.lit("x"), (F.col("id") % 7).cast("int")))
    return spark.range(n).select(F.col("id").alias("customer_id"), F.lit(1).alias("y_true"),
                                 F.lit("CHURN").alias("churn_decision"), text.alias("prompt"))


class Broken:
    def generate(self, model, requests):
        return ["nothing useful"] * len(requests)


class Raises:
    def generate(self, model, requests):
        raise ConnectionError("no server")


class Counts(PanelEcho):
    """Fails one prompt of each batch at first; batches are never larger than asked for."""

    def generate(self, model, requests):
        assert len(requests) <= 5
        return super().generate(model, requests)


def test_generation_and_retries(spark):
    out = generate_replies(requests(prompts(spark, 40)), Counts, GenerationParams(batch_size=5), partitions=4)
    rows = out.collect()
    assert len(rows) == 80
    assert all(r["attempts"] == (2 if len(r["prompt"]) % 5 == 0 else 1) for r in rows)
    failed = generate_replies(requests(prompts(spark, 3), GenerationParams(models=("qwen",), limit=2)), Broken)
    assert [(r["attempts"], r["raw_reply"]) for r in failed.collect()] == [(4, "nothing useful")] * 2
    raised = generate_replies(requests(prompts(spark, 3)), Raises).collect()
    assert len(raised) == 6 and all(r["raw_reply"].startswith("client error") and r["attempts"] == 4 for r in raised)
    with pytest.raises(Exception, match="no server"):
        generate_replies(requests(prompts(spark, 3)), Raises, GenerationParams(on_error="raise")).collect()


def test_retry_loop_and_parser_accept_the_same_replies(spark):
    good = '{"decision": "churn", "explanation": "because of many returns", "recommendation": "call the customer"}'
    texts = [
        good, good.replace('"churn"', '" CHURN "'), "```json\n" + good + "\n```", "<think>a\nb</think>" + good, "text " + good + " after",
        good + " trailing }", good.replace('"', "'"), good.replace("many", "ma\nny"), good[:60], good[:100], good.replace("churn", "maybe"),
        good.replace("because of many returns", ""), '{"decision": "churn"}', good.replace('"call the customer"', "null"), "nothing", "",
        '{"decision": " churn ", "explanation": "cut', '{"decision": "retain", "explanation": "short'
    ]
    df = spark.createDataFrame([(i, "m", t, "RETAIN") for i, t in enumerate(texts)], "customer_id long, model string, raw_reply string, churn_decision string")
    status = {r.customer_id: r.status for r in parse_replies(df).collect()}
    for i, text in enumerate(texts):
        assert acceptable(text) == (status[i] != "error"), (text, status[i])


def test_anti_join_for_each_fill(spark):
    wanted = spark.createDataFrame([(1,), (2,)], "customer_id bigint")
    for done, left in ([], 2), ([(1, "churn")], 1), ([(1, None)], 2), ([(1, "churn"), (2, "retain")], 0):
        sink = spark.createDataFrame(done, "customer_id bigint, decision string")
        assert not_yet_answered(wanted, sink, ["customer_id"]).count() == left


def test_resumed_run_equals_one_run(spark):
    everything = prompts(spark, 30)
    sink = work_path(spark, "answers")
    run_batch(everything.filter("customer_id < 11"), sink, PanelEcho, GenerationParams(models=("qwen",)))
    for _ in range(2):  # a repeated batch replaces itself
        earlier = read_answers(spark, sink).filter("batch <> 'again'")
        answer_missing(requests(everything), earlier, sink, "again", PanelEcho)
    resumed = read_answers(spark, sink)
    once = run_batch(everything, work_path(spark, "once"), PanelEcho)
    keys = ["customer_id", "model", "decision"]
    assert resumed.count() == 60
    assert resumed.select(keys).exceptAll(once.select(keys)).count() == 0


def test_finished_buckets_survive_a_breakdown(spark):
    everything = prompts(spark, 40)
    sink = work_path(spark, "answers")
    params = GenerationParams(models=("qwen",), on_error="raise", buckets=8)
    with pytest.raises(Exception, match="server is gone"):
        run_batch(everything, sink, BreaksDown, params)
    before = read_answers(spark, sink).collect()
    after = run_batch(everything, sink, PanelEcho, params)
    assert after.count() == 40 and after.select("customer_id").distinct().count() == 40
    assert set(before) <= set(after.collect())


def test_limit_counts_once_per_run(spark):
    sink = work_path(spark, "answers")
    assert run_batch(prompts(spark, 40), sink, PanelEcho, GenerationParams(models=("qwen",), limit=7)).count() == 7
    with pytest.raises(ValueError):
        run_stream(spark, sink, prompts(spark, 1).schema, sink, "c", PanelEcho, GenerationParams(limit=2))


def test_two_streams_share_a_sink(spark):
    everything = prompts(spark, 10)
    sink = work_path(spark, "answers")
    for name, part in (("a", "customer_id < 6"), ("b", "customer_id >= 4")):
        source = work_path(spark, f"arrivals_{name}")
        everything.filter(part).repartition(3).write.parquet(source)
        for _ in range(2):  # started again, a stream finds nothing new
            run_stream(spark, source, everything.schema, sink, f"{sink}_progress_{name}", PanelEcho, files_per_batch=1)
    got = read_answers(spark, sink)
    assert got.count() == 20 and got.select("customer_id", "model").distinct().count() == 20


def test_a_stream_hands_few_prompts_to_python_at_once(spark, monkeypatch):
    """A micro-batch may hold many prompts; the session's own setting is as before once the stream has run."""
    setting, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, real = spark.conf.get(setting), incremental.store_answers

    def seeing(todo, *rest):
        seen.append(int(todo.sparkSession.conf.get(setting)))
        real(todo, *rest)

    monkeypatch.setattr(incremental, "store_answers", seeing)
    sink, source, progress = (work_path(spark, n) for n in ("answers", "arrivals", "progress"))
    everything = prompts(spark, 6)
    everything.coalesce(1).write.parquet(source)
    assert run_stream(spark, source, everything.schema, sink, progress, PanelEcho).count() == 12
    assert set(seen) == {incremental.ROWS_AT_ONCE} and spark.conf.get(setting) == before


class Reads(StreamingQueryListener):
    """Rows read from each source, one entry for each micro-batch."""

    def __init__(self):
        self.rows = []

    def onQueryStarted(self, event):  # noqa: N802
        pass

    def onQueryProgress(self, event):  # noqa: N802
        self.rows.append((event.progress.batchId, [s.numInputRows for s in event.progress.sources]))

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        pass


def test_a_micro_batch_does_not_read_the_sink(spark):
    """Fifty micro-batches beside earlier answers: those are read once, then only each batch's own prompts."""
    everything = prompts(spark, 120)
    sink, source, progress = (work_path(spark, n) for n in ("answers", "arrivals", "progress"))
    params = GenerationParams(models=("qwen",))
    run_batch(everything.filter("customer_id < 30"), sink, PanelEcho, params)
    everything.filter("customer_id >= 20").repartitionByRange(50, "customer_id").write.parquet(source)
    reads = Reads()
    spark.streams.addListener(reads)
    try:
        got = run_stream(spark, source, everything.schema, sink, progress, PanelEcho, params, files_per_batch=1)
        for _ in range(50):
            if len(reads.rows) >= 50:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(reads)
    assert got.count() == 120 and got.select("customer_id").distinct().count() == 120
    rows = [r for b, r in sorted(reads.rows) if sum(r)]
    assert len(rows) == 50 and sum(a for a, _ in rows) == 100
    assert rows[0][1] == 30 and all(b == 0 for _, b in rows[1:]) and max(a for a, _ in rows) <= 3


def test_a_stream_goes_on_after_a_breakdown(spark):
    everything = prompts(spark, 12)
    sink, source, progress = (work_path(spark, n) for n in ("answers", "arrivals", "progress"))
    everything.repartitionByRange(4, "customer_id").write.parquet(source)
    params = GenerationParams(models=("qwen",), on_error="raise")
    with pytest.raises(Exception, match="server is gone"):
        run_stream(spark, source, everything.schema, sink, progress, BreaksDown, params, files_per_batch=1)
    # Two customers are answered by somebody else before the stream goes on; one file is a repeated request.
    run_batch(everything.filter("customer_id >= 10"), sink, PanelEcho, params)
    everything.filter("customer_id < 3").write.mode("append").parquet(source)
    got = run_stream(spark, source, everything.schema, sink, progress, PanelEcho, params, files_per_batch=1)
    assert got.count() == 12 and got.select("customer_id").distinct().count() == 12


def test_reply_metrics_compile(spark):
    """Without the fallback to interpreted code, generated code that does not compile is an error."""
    from tidewatch.operators.metrics import reply_metrics

    df = spark.createDataFrame(
        [("m", 1, "churn", "fine", 2.675), ("m", 0, " Churn ", "[parse_error] x", 0.0), ("m", 0, "retain", None, 1.0), ("n", 1, None, "x", 1.0)],
        "model string, y_true int, decision string, explanation string, time_sec double")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        rows = [r.asDict() for r in reply_metrics(df).collect()]
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    assert rows == [{"model": "m", "n_evaluated": 3, "accuracy": 0.6667, "precision": 0.5, "recall": 1.0, "f1": 0.6667, "roc_auc": 0.75,
                     "avg_time_sec": 1.22, "parse_failure_rate": 0.3333}]


def test_benchmarks_read_the_stored_customers(spark, monkeypatch):
    from tidewatch.plans import data, prompt_queries

    folder = "/root/testdata/sf0.001"
    data.forget_stages()
    data.customers(spark, folder)

    def again(*_):
        raise AssertionError("the source tables are read again")

    monkeypatch.setattr(data, "customer_features", again)
    assert prompt_queries.benchmarks(spark, folder).count() == 20
    data.forget_stages()


def test_explained_customers_are_stored_without_copies(spark):
    from tidewatch.plans import data, reason_queries

    folder = "/root/testdata/sf0.001"
    data.forget_stages()
    table = reason_queries.explained(spark, folder)
    stored = spark.read.parquet(*table.inputFiles()).columns
    assert not {"contributions", "rolled", "reason_1", "top_5_reasons"} & set(stored)
    one = table.select("reasons", "top_5_reasons", "reason_1", "reason_5").first()
    texts = [r.reason_with_magnitude for r in one.reasons]
    assert (one.top_5_reasons, one.reason_1, one.reason_5) == (" | ".join(texts), texts[0], texts[4])
    data.forget_stages()


def test_reasons_are_ranked_by_plain_comparison(spark):
    """No lambda for each pair of features; ties keep column order, a missing category and number read alike."""
    from tidewatch.operators.reasons import top_reasons

    df = spark.sql("SELECT CAST(NULL AS DOUBLE) AS Age, 'x' AS Gender, CAST(NULL AS STRING) AS Country, array(-1D, 1D, 2D) AS rolled")
    out = top_reasons(df, ["Age", "Gender", "Country"], top=3)
    assert "array_sort" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.feature, r.shap_value, r.feature_value) for r in out.first().reasons] == [
        ("Country", 2.0, "missing"), ("Age", -1.0, "missing"), ("Gender", 1.0, "x")]


def test_prompts_write_out_shown_numbers_only(spark):
    from tidewatch.plans import data, prompt_queries

    plan = prompt_queries.prompts_for(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array(Age") <= 2  # the array of all numbers for benchmarks, and whole numbers
    data.forget_stages()


def test_a_streams_state_needs_no_python(spark):
    """Keys that have been asked are kept by the JVM's removal of duplicates: no call of Python for each key."""
    source, sink = (work_path(spark, n) for n in ("arrivals", "answers"))
    everything = prompts(spark, 4)
    everything.write.parquet(source)
    spark.range(0).write.parquet(sink)
    wanted, answered = (spark.readStream.schema(s).parquet(p) for s, p in ((everything.schema, source), (incremental.ANSWER_SCHEMA, sink)))
    plan = incremental.unasked(incremental.requests(wanted), answered)._jdf.queryExecution().analyzed().toString()
    assert "Deduplicate" in plan and "Pandas" not in plan


def test_answers_of_others_that_come_with_new_prompts(spark):
    """They are not asked again, in the first micro-batch of a start or in the one after a batch that broke down."""
    everything = prompts(spark, 40)
    sink, source, progress = (work_path(spark, n) for n in ("answers", "arrivals", "progress"))
    params = GenerationParams(models=("qwen",), on_error="raise")

    def arrive(first, last):
        everything.filter(f"customer_id BETWEEN {first} AND {last}").coalesce(1).write.mode("append").parquet(source)

    def answer(client, at_once):
        return run_stream(spark, source, everything.schema, sink, progress, client, params, files_per_batch=at_once)

    arrive(0, 9)
    run_batch(everything.filter("customer_id BETWEEN 5 AND 6"), sink, PanelEcho, params)
    assert answer(PanelEcho, 1).count() == 10
    arrive(10, 29)
    with pytest.raises(Exception, match="server is gone"):
        answer(BreaksDown, 1)
    run_batch(everything.filter("customer_id BETWEEN 28 AND 31"), sink, PanelEcho, params)
    arrive(30, 39)
    got = answer(PanelEcho, 1)
    assert got.count() == 40 and got.select("customer_id").distinct().count() == 40
    assert got.filter("batch LIKE 'run-%'").count() == 6 and incremental.last_planned(spark, progress) >= 2
