"""Answering prompts bit by bit, and going on after an interruption.

Replies are kept long, keyed by (customer, model), in folders ``bucket=…/batch=…``: the bucket is a hash
of the customer, the batch names the run that wrote it. A run asks only for keys without an answer; nothing already
answered is rewritten. A batch run reads and stores its requests once, by bucket, then goes bucket by bucket and
commits each one when it is finished, so an interruption loses one bucket's work.

A stream keeps the keys that have been asked in its state store. Answers of other runs reach that state through a second
source, the answer files themselves, of which each is read once, all new ones in the first micro-batch planned after a
start: a micro-batch reads new prompts and the keys of new answer files, and only that first one looks at the whole sink.
The state is that of a plain removal of duplicates in the JVM. With many keys, give the session the RocksDB state store.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidewatch.functions.clients import ClientFactory
from tidewatch.operators.generate import generate_replies, requests
from tidewatch.operators.replies import apply_fallback, not_yet_answered, parse_replies
from tidewatch.schema import KEY
from tidewatch.session import drop_table, make_folder, path_exists, work_path
from tidewatch.settings import GenerationParams

ANSWER_SCHEMA = (
    f"{KEY} bigint, y_true int, model string, decision string, explanation string, "
    "recommendation string, time_sec double, attempts int, status string"
)
#: Requests that pass through a Python worker at once: what it holds does not grow with the prompts of a micro-batch.
ROWS_AT_ONCE = 500
_ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
_COLUMNS = [c.split()[0] for c in ANSWER_SCHEMA.split(", ")]


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64(KEY), F.lit(buckets)).cast("int")


def read_answers(spark: SparkSession, sink: str) -> DataFrame:
    schema = ANSWER_SCHEMA + ", bucket int, batch string"
    if not path_exists(spark, sink):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(sink)


def store_answers(
    todo: DataFrame, sink: str, batch: str, client_factory: ClientFactory, params: GenerationParams = GenerationParams()
) -> None:
    """Answer the requests and store them under the batch's name.

    Only the folders of this batch are replaced, so a repeated batch overwrites itself.
    """
    answers = apply_fallback(parse_replies(generate_replies(todo, client_factory, params))).select(*_COLUMNS)
    (
        answers.withColumns({"bucket": bucket_of(params.buckets), "batch": F.lit(batch)})
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket", "batch").parquet(sink)
    )


def answer_missing(
    wanted: DataFrame, earlier: DataFrame, sink: str, batch: str, client_factory: ClientFactory,
    params: GenerationParams = GenerationParams(),
) -> None:
    """Answer and store the requests that ``earlier`` holds no answer to."""
    store_answers(not_yet_answered(wanted, earlier, [KEY, "model"]), sink, batch, client_factory, params)


def run_batch(
    prompts: DataFrame, sink: str, client_factory: ClientFactory,
    params: GenerationParams = GenerationParams(),
) -> DataFrame:
    """One batch run over stored prompts; call it again to go on after a failure.

    ``limit`` counts customers once for the run. The prompts are read once and stored by bucket; buckets are answered
    and committed one by one, each against the sink's own folder of that bucket.
    """
    spark = prompts.sparkSession
    batch = f"run-{uuid.uuid4().hex}"
    stored = work_path(spark, "requests")
    wanted = requests(prompts, params)
    spread = wanted.withColumn("_bucket", bucket_of(params.buckets)).repartition(params.buckets * 4, "_bucket", KEY)
    spread.write.partitionBy("_bucket").parquet(stored)
    kept = StructType([*wanted.schema.fields, StructField("_bucket", IntegerType())])
    try:
        for bucket in range(params.buckets):
            earlier = read_answers(spark, sink).filter(F.col("bucket") == bucket)
            part = spark.read.schema(kept).parquet(stored).filter(F.col("_bucket") == bucket).drop("_bucket")
            answer_missing(part, earlier, sink, batch, client_factory, params)
    finally:
        drop_table(spark, stored)
    return read_answers(spark, sink)


def unasked(wanted: DataFrame, answered: DataFrame) -> DataFrame:
    """Of a stream of requests, those whose key is new to the stream and to the keys answered in earlier micro-batches.

    Of a request and an answer that come in the same micro-batch either may be the first; the caller looks at the sink then.
    """
    by = [KEY, "model"]
    both = wanted.withColumn("_answered", F.lit(False)).unionByName(
        # Not null like the models asked for: the state's key schema must not depend on whether there are answers.
        answered.select(KEY, F.coalesce("model", F.lit("")).alias("model"), F.lit(True).alias("_answered")), allowMissingColumns=True)
    return both.dropDuplicates(by).filter(~F.col("_answered")).select(*wanted.columns)


def last_planned(spark: SparkSession, checkpoint: str) -> int:
    """The last micro-batch that a checkpoint holds the plan of, done or not; -1 if there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/offsets")
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in system.listStatus(folder)] if system.exists(folder) else []
    return max((int(n) for n in names if n.isdigit()), default=-1)


def run_stream(
    spark: SparkSession, prompt_path: str, schema: StructType, sink: str, checkpoint: str,
    client_factory: ClientFactory, params: GenerationParams = GenerationParams(),
    files_per_batch: int = 100, name: str | None = None,
) -> DataFrame:
    """Answer all prompt files that have arrived, in micro-batches, then stop.

    Micro-batches are numbered per checkpoint, so their folders carry the stream's name: ``name``, or
    a hash of the checkpoint path. Several streams may share a sink. A limit has no meaning here, since
    it would cut every micro-batch.
    """
    if params.limit is not None:
        raise ValueError("limit counts customers of a batch run; filter the prompts of a stream instead")
    stream = name or hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]
    source = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(prompt_path)
    )

    make_folder(spark, sink)
    # Files that a repeated micro-batch replaces may be gone when they are listed; their keys are in the state already.
    answers = spark.readStream.schema(ANSWER_SCHEMA).option("ignoreMissingFiles", "true").parquet(sink)

    planned, done = last_planned(spark, checkpoint), []

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        own = f"stream-{stream}-{batch_id}"
        if not done or done[-1] <= planned:
            # One that broke down, planned before others answered, or the first planned now, which reads their new answers.
            batch = not_yet_answered(batch, read_answers(spark, sink).filter(F.col("batch") != own), [KEY, "model"])
        done.append(batch_id)
        store_answers(batch, sink, own, client_factory, params)

    before = int(spark.conf.get(_ROWS_SETTING))
    # A stream keeps the settings it starts with. Zero or less means no bound.
    spark.conf.set(_ROWS_SETTING, str(min(before, ROWS_AT_ONCE) if before > 0 else ROWS_AT_ONCE))
    try:
        started = (
            unasked(requests(source, params), answers).writeStream.foreachBatch(on_batch)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        spark.conf.set(_ROWS_SETTING, str(before))
    started.awaitTermination()
    return read_answers(spark, sink)
