"""Streams of text deltas, dictation events and resumable work."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def parse_sse(raw: Column) -> Column:
    """array of struct(text, done, error) from the text of a server-sent event stream, whole events only."""
    events = F.split(raw, "\n\n")
    whole = F.slice(events, F.lit(1), F.greatest(F.size(events) - 1, F.lit(0)))
    data = F.filter(F.transform(whole, lambda e: F.regexp_extract(e, r"(?m)^data:\s?(.*)$", 1)), lambda d: F.length(d) > 0)

    def event(d: Column) -> Column:
        text = F.coalesce(F.get_json_object(d, "$.text"), F.get_json_object(d, "$.choices[0].delta.content"), F.get_json_object(d, "$.candidates[0].content.parts[0].text"), F.lit(""))
        return F.struct(text.alias("text"), ((d == "[DONE]") | (F.get_json_object(d, "$.done") == "true")).alias("done"), F.get_json_object(d, "$.error").alias("error"))

    return F.transform(data, lambda d: F.struct(event(d)["text"].alias("text"), F.coalesce(event(d)["done"], F.lit(False)).alias("done"), event(d)["error"].alias("error")))


def collected(deltas: DataFrame) -> DataFrame:
    """Batch form: one row per request, its text in order of seq up to the first done or error, and its state."""
    end = F.min(F.when(F.col("done") | F.col("error").isNotNull(), F.col("seq"))).over(Window.partitionBy("request_id"))
    kept = deltas.withColumn("_end", end).filter(F.col("_end").isNull() | (F.col("seq") <= F.col("_end")))
    pieces = F.array_sort(F.collect_list(F.struct("seq", F.coalesce("text", F.lit("")).alias("text"))))
    got = kept.groupBy("request_id").agg(F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("text"), F.max(F.coalesce("done", F.lit(False))).alias("done"), F.max("error").alias("error"))
    return got.withColumn("state", F.when(F.col("error").isNotNull(), "error").when(F.col("done"), "done").otherwise("open"))


def collect_stream(deltas: DataFrame, timeout: str = "30 seconds", forget: str = "1 hour") -> DataFrame:
    """Streaming form: a request's text as it grows; it ends with done, an error, or after ``timeout`` without a delta.

    Deltas of a request must come in order from one batch to the next; within a batch they are put in order of seq. The
    text of an ended request goes at once; that it has ended is kept for ``forget``, and deltas that come meanwhile are
    dropped. After that no state is left.
    """
    seconds, later = (int(x.split()[0]) * {"second": 1, "minute": 60, "hour": 3600}[x.split()[1].rstrip("s")] * 1000 for x in (timeout, forget))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        text, ended = state.get if state.exists else ("", False)
        if state.hasTimedOut:
            if ended:
                state.remove()
                return
            state.update(("", True))
            state.setTimeoutDuration(later)
            yield pd.DataFrame({"request_id": [key[0]], "text": [text], "state": ["timeout"]})
            return
        if ended:  # deltas after the end
            for _ in batches:
                pass
            state.update(("", True))
            state.setTimeoutDuration(later)
            return
        how = "open"
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            text += r.text or ""
            if isinstance(r.error, str) and r.error:
                how = "error"
            elif r.done:
                how = "done"
            if how != "open":
                break
        state.update((text if how == "open" else "", how != "open"))
        state.setTimeoutDuration(seconds if how == "open" else later)
        yield pd.DataFrame({"request_id": [key[0]], "text": [text], "state": [how]})

    return deltas.groupBy("request_id").applyInPandasWithState(step, "request_id string, text string, state string", "text string, ended boolean", "update", "ProcessingTimeTimeout")


def merged_dictation(events: DataFrame) -> DataFrame:
    """The text of the newest session: final results in order, then its latest interim result."""
    newest = events.agg(F.max("session").alias("session"))  # a single value
    own = events.join(F.broadcast(newest), "session")
    finals = F.array_sort(F.collect_list(F.when(F.col("is_final"), F.struct("result_index", "transcript"))))
    got = own.groupBy("session").agg(
        F.array_join(F.transform(finals, lambda x: F.trim(x["transcript"])), " ").alias("final_text"),
        F.max_by(F.when(~F.col("is_final"), F.col("transcript")), F.when(~F.col("is_final"), F.col("result_index"))).alias("interim"),
    )
    return got.select("session", F.concat_ws(" ", F.nullif("final_text", F.lit("")), F.nullif(F.trim("interim"), F.lit(""))).alias("text"))


def run_resumable(source: DataFrame, work, path: str, checkpoint: str, key: str = "key", parts: int = 64) -> None:
    """Processes what a stream brings and appends results; keys already written are left out, so a repeated batch adds nothing.

    ``work`` takes and returns a DataFrame. Results lie in ``parts`` folders by a hash of their key, and a batch reads the
    keys only, of those folders that its own keys fall in.
    """

    def batch(rows: DataFrame, epoch: int) -> None:
        from quernstone.sources.readers import exists

        placed = lambda df: df.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
        todo = placed(rows.dropDuplicates([key]))
        if exists(rows.sparkSession, f"{path}/part=*"):
            own = [r["part"] for r in todo.select("part").distinct().collect()]  # at most ``parts``
            done = rows.sparkSession.read.parquet(path).filter(F.col("part").isin(own)).select(key, "part")
            todo = todo.join(done, [key, "part"], "left_anti")
        placed(work(todo.drop("part"))).write.mode("append").partitionBy("part").parquet(path)

    query = source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def keep_report(results: DataFrame, epoch: int, path: str, requested: int | None = None) -> None:
    """For foreachBatch: counts of a batch of judged results in a folder of its own, then the report over all batches so far, written again.

    A repeated batch writes its folder again, so it changes nothing; an older report is there until the new one is.
    """
    from quernstone.operators.summary import judge_partials, judge_report_of

    spark, root = results.sparkSession, path.rstrip("/")
    judge_partials(results).write.mode("overwrite").json(f"{root}/partials/batch={epoch}")
    counted = spark.read.schema("completed long, passed long, failed long, uncertain long, skipped long, batch long").option("basePath", f"{root}/partials").json(f"{root}/partials/batch=*")
    judge_report_of(counted, requested).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").json(f"{root}/report")


def run_reported(source: DataFrame, path: str, checkpoint: str, requested: int | None = None) -> None:
    """A stream of judged results whose report is current after every batch."""
    query = source.writeStream.foreachBatch(lambda rows, epoch: keep_report(rows, epoch, path, requested)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def validated(first: Column, retry: Column, sound, strip) -> Column:
    """The first attempt if sound, else the retry if sound, else the first one stripped."""
    return F.coalesce(F.when(sound(first), first), F.when(sound(retry), retry), strip(first))
