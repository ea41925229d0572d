"""Running prompts through an injected text model, batch by batch."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.clients import ClientFactory, TextClient
from tidewatch.functions.prompts import SYSTEM_MESSAGE
from tidewatch.functions.replies import acceptable
from tidewatch.schema import KEY
from tidewatch.settings import GenerationParams


def requests(prompts: DataFrame, params: GenerationParams = GenerationParams()) -> DataFrame:
    """One request per customer and model; ``limit`` keeps the first customers for a dry run."""
    chosen = prompts if params.limit is None else prompts.orderBy(KEY).limit(params.limit)
    return chosen.withColumn("model", F.explode(F.array(*[F.lit(m) for m in params.models])))


def ask(client: TextClient, model: str, prompts: list[str], params: GenerationParams) -> list[tuple[str, int, float]]:
    """(reply, attempts, seconds) for each prompt. Only prompts without a usable reply are asked again.

    A call's time is shared evenly by its prompts. A call that raises counts as an attempt with an
    unusable reply, unless ``on_error`` says that the job should stop.
    """
    out = [("", 0, 0.0)] * len(prompts)
    open_ = list(range(len(prompts)))
    for attempt in range(1, params.attempts + 1):
        batch = [
            [{"role": "system", "content": SYSTEM_MESSAGE}, {"role": "user", "content": prompts[i]}] for i in open_
        ]
        start = time.perf_counter()
        try:
            texts = [t.strip() for t in client.generate(model, batch)]
            if len(texts) != len(batch):
                raise ValueError(f"{len(texts)} replies to {len(batch)} requests")
        except Exception as error:  # whatever the client raises concerns this batch only
            if params.on_error == "raise":
                raise
            texts = [f"client error: {error!r}"] * len(batch)
        share = (time.perf_counter() - start) / len(batch)
        for i, text in zip(open_, texts):
            out[i] = (text, attempt, out[i][2] + share)
        open_ = [i for i in open_ if not acceptable(out[i][0])]
        if not open_:
            break
    return out


def generate_replies(
    wanted: DataFrame, client_factory: ClientFactory, params: GenerationParams = GenerationParams(),
    partitions: int | None = None,
) -> DataFrame:
    """Add ``raw_reply``, ``attempts`` and ``time_sec`` to rows with ``model`` and ``prompt``.

    Rows are spread by key, so the load does not follow the input files. Each task builds one client
    and sends ``batch_size`` prompts of one model per call; only model and prompt leave the JVM.
    """
    @F.pandas_udf("raw_reply string, attempts int, time_sec double")
    def reply(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        client = client_factory()
        for models, prompts in batches:
            answers: list = [None] * len(models)
            for model, places in models.reset_index(drop=True).groupby(models.to_numpy()).groups.items():
                at = list(places)
                for a in range(0, len(at), params.batch_size):
                    part = at[a : a + params.batch_size]
                    for i, answer in zip(part, ask(client, model, [prompts.iat[i] for i in part], params)):
                        answers[i] = answer
            yield pd.DataFrame(answers, columns=["raw_reply", "attempts", "time_sec"])

    by = [KEY, "model"]
    spread = wanted.repartition(*by) if partitions is None else wanted.repartition(partitions, *by)
    made = spread.withColumn("_reply", reply.asNondeterministic()("model", "prompt"))
    return made.select(*wanted.columns, "_reply.*")
