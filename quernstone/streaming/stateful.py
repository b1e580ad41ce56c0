"""Live streams with state of their own for each key: server-sent events in bytes, ordered failover, dictation.

Each has a batch form over DataFrames with the same result. State holds only what is not settled yet, as one JSON text a
key, and goes when a request ends.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quernstone.functions.chars import trim


def kept(state, start: dict) -> dict:
    return json.loads(state.get[0]) if state.exists else start


def keep(state, what: dict) -> None:
    state.update((json.dumps(what),))


# Server-sent events: chunks (request_id, seq from 0, chunk binary, last) to deltas (request_id, event_no, text, done, error)

EVENT = "request_id string, event_no int, text string, done boolean, error string"


def read_event(block: bytes) -> tuple[str, bool, str | None]:
    """Text, done and error of one event; lines that hold no data or no sound JSON count as nothing."""
    text = ""
    for line in block.decode("utf-8", "replace").split("\n"):
        line = line.strip()
        if not line.startswith("data:"):
            continue
        try:
            said = json.loads(line[5:])
        except ValueError:
            continue
        if not isinstance(said, dict):
            continue
        if said.get("error"):
            return text, False, str(said["error"])
        if isinstance(said.get("text"), str) and said["text"]:
            text += said["text"]
        else:
            try:
                text += said["choices"][0]["delta"]["content"] or ""
            except (KeyError, IndexError, TypeError):
                pass
        if said.get("done") is True:
            return text, True, None
    return text, False, None


class SseReader:
    """One request's events as its chunks come, cut anywhere (inside a character or a blank line too) and in any order."""

    def __init__(self, following: int = 0, tail: str = "", events: int = 0, held: dict | None = None) -> None:
        self.following, self.tail, self.events = following, bytes.fromhex(tail), events
        self.held = {int(k): (bytes.fromhex(c), last) for k, (c, last) in (held or {}).items()}
        self.over = False

    def state(self) -> dict:
        return {"following": self.following, "tail": self.tail.hex(), "events": self.events, "held": {k: (c.hex(), last) for k, (c, last) in self.held.items()}}

    def add(self, chunks: dict[int, tuple[bytes, bool]]) -> list[tuple]:
        """(event_no, text, done, error) of the events that are whole now; chunks after a gap wait."""
        out: list[tuple] = []
        self.held |= {k: c for k, c in chunks.items() if k >= self.following}

        def say(text: str, done: bool, error: str | None) -> None:
            if text or done or error:
                out.append((self.events, text, done, error))
                self.events += 1
            self.over = self.over or done or error is not None

        while self.following in self.held and not self.over:
            chunk, last = self.held.pop(self.following)
            self.following += 1
            *blocks, self.tail = (self.tail + chunk).split(b"\n\n")
            for block in blocks:
                if not self.over:
                    say(*read_event(block))
            if last and not self.over:
                text, done, error = read_event(self.tail)  # what no blank line ends
                say(text, done or error is None, error)
        return out


#: Groups that requests share a state in, where ended ones leave none.
GROUPS = 1024


def sse_stream(chunks: DataFrame, forget_ms: int = 3_600_000, groups: int = GROUPS) -> DataFrame:
    """Deltas as their events are whole. After done, an error or the last chunk nothing is kept but, for ``forget_ms`` (0: not at all), that the request has ended.

    With ``forget_ms`` the clock is the machine's, so batches go on while the query runs; a run over what is there takes 0.
    Then no request needs a timer of its own, and requests are dealt to ``groups``: a call for each group of a batch costs
    milliseconds, a request in it far less.
    """

    def together(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        new: dict = {}
        for pdf in batches:
            for r in pdf.itertuples():
                new.setdefault(r.request_id, {})[int(r.seq)] = (bytes(r.chunk or b""), bool(r.last))
        open_, out = dict(kept(state, {"open": []})["open"]), []
        for request, own in new.items():
            reader = SseReader(**open_.pop(request, {}))
            out += [(request, *e) for e in reader.add(own)]
            if not reader.over:
                open_[request] = reader.state()
        if open_:
            keep(state, {"open": list(open_.items())})
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["request_id", "event_no", "text", "done", "error"])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        chunks = {int(r.seq): (bytes(r.chunk or b""), bool(r.last)) for pdf in batches for r in pdf.itertuples()}
        before = kept(state, {})
        if "ended" in before:
            keep(state, before)
            state.setTimeoutDuration(forget_ms)
            return
        reader = SseReader(**before)
        out = reader.add(chunks)
        if not reader.over:
            keep(state, reader.state())
        else:
            keep(state, {"ended": True})
            state.setTimeoutDuration(forget_ms)
        if out:
            yield pd.DataFrame([(key[0], *e) for e in out], columns=["request_id", "event_no", "text", "done", "error"])

    if not forget_ms:
        return chunks.withColumn("_group", F.pmod(F.xxhash64("request_id"), F.lit(groups))).groupBy("_group").applyInPandasWithState(together, EVENT, "kept string", "append", "NoTimeout")
    return chunks.groupBy("request_id").applyInPandasWithState(step, EVENT, "kept string", "append", "ProcessingTimeTimeout")


def sse_batch(chunks: DataFrame) -> DataFrame:
    """The same deltas' text by request, from all chunks at once: request_id, text, state (done, error or closed), error."""
    whole = F.array_sort(F.collect_list(F.struct("seq", F.hex("chunk").alias("hex"))))
    body = chunks.groupBy("request_id").agg(F.decode(F.unhex(F.array_join(F.transform(whole, lambda c: c["hex"]), "")), "UTF-8").alias("body"))
    lines = body.select("request_id", F.posexplode(F.split("body", "\n")).alias("line_no", "line")).withColumn("line", trim(F.col("line"))).filter(F.col("line").startswith("data:"))
    data = lines.withColumn("data", trim(F.substring("line", 6, 1 << 30))).filter("data NOT IN ('', '[DONE]')")
    said = data.select(
        "request_id", "line_no", F.nullif(F.get_json_object("data", "$.error"), F.lit("")).alias("error"), F.coalesce(F.get_json_object("data", "$.done") == "true", F.lit(False)).alias("done"),
        F.coalesce(F.nullif(F.get_json_object("data", "$.text"), F.lit("")), F.get_json_object("data", "$.choices[0].delta.content"), F.lit("")).alias("text"),
    )
    end = F.min(F.when(F.col("done") | F.col("error").isNotNull(), F.col("line_no"))).over(Window.partitionBy("request_id"))
    kept = said.withColumn("end", end).filter("end IS NULL OR line_no <= end").withColumn("text", F.when(F.col("error").isNull(), F.col("text")).otherwise(""))
    found = kept.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("t"), F.max("error").alias("error"), F.max("done").alias("done"))
    state = F.when(F.col("error").isNotNull(), "error").when(F.coalesce("done", F.lit(False)), "done").otherwise("closed")
    return body.select("request_id").join(found, "request_id", "left").select("request_id", trim(F.coalesce(F.array_join(F.transform("t", lambda p: p["text"]), ""), F.lit(""))).alias("text"), state.alias("state"), "error")


def sse_text(deltas: DataFrame) -> DataFrame:
    """request_id, text, error of a stream's deltas."""
    found = deltas.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("event_no", "text"))).alias("t"), F.max("error").alias("error"))
    return found.select("request_id", trim(F.array_join(F.transform("t", lambda p: p["text"]), "")).alias("text"), "error")


# Failover: attempts (request_id, priority from 0, at timestamp, seq, kind, text, backends) of the backends of a request

OUTCOME = "request_id string, priority int, part int, text string, state string"


class Failover:
    """One request: it commits to the first backend, in order of priority, that answers in time; before that it moves on, after it passes errors on.

    Rows are taken in order of their time, up to the time that the clock has reached, so arrival doesn't matter.
    """

    def __init__(self, head_ms: int, inactivity_ms: int, backends: int, turn: int = 0, committed: bool = False, since: int | None = None, parts: int = 0, waiting: list | None = None) -> None:
        self.head_ms, self.inactivity_ms = head_ms, inactivity_ms
        self.backends, self.turn, self.committed, self.since, self.parts = backends, turn, committed, since, parts
        self.waiting = sorted(tuple(r) for r in waiting or [])  # at, priority, seq, kind, text
        self.over, self.out = False, []

    def state(self) -> dict:
        return {"backends": self.backends, "turn": self.turn, "committed": self.committed, "since": self.since, "parts": self.parts, "waiting": [r for r in self.waiting if r[1] >= self.turn]}

    def deadline(self) -> int | None:
        """Up to and with this time the backend in turn may be silent."""
        return None if self.since is None else self.since + (self.inactivity_ms if self.committed else self.head_ms)

    def say(self, text: str, state: str) -> None:
        self.out.append((self.turn, self.parts, text, state))
        self.parts, self.over = self.parts + 1, state != "open"

    def fail(self, text: str, state: str) -> None:
        if self.committed:
            self.say(text, state)
            return
        self.turn, self.since = self.turn + 1, None
        if self.turn >= self.backends:
            self.say("", "failed")

    def advance(self, now: int) -> None:
        while not self.over:
            own = next((r for r in self.waiting if r[1] == self.turn and r[0] <= now), None)
            limit = self.deadline()
            if limit is not None and limit < (own[0] if own else now):
                self.fail("", "timeout")
                continue
            if own is None:
                return
            self.waiting.remove(own)
            at, _, _, kind, text = own
            if kind == "start":
                self.since = at
            elif kind == "error":
                self.fail(text, "error")
            else:
                self.committed, self.since = True, at
                self.say(text, "open" if kind == "delta" else "done")

    def wake(self, now: int) -> int:
        """When there may be something to do next."""
        limit = self.deadline()
        times = [r[0] for r in self.waiting if r[0] > now and r[1] == self.turn] + ([limit + 1] if limit is not None else [])
        return max(now + 1, min(times, default=now + self.head_ms))


def failover_stream(attempts: DataFrame, head_ms: int = 30_000, inactivity_ms: int = 30_000, delay: str = "0 seconds", forget_ms: int = 3_600_000) -> DataFrame:
    """Parts of each request's answer from the backend that it commits to, and how it ends: done, error, timeout, or failed when no backend answers.

    The clock is the watermark, ``delay`` behind the newest row. That a request has ended is kept for ``forget_ms``.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = max(0, state.getCurrentWatermarkMs())
        before = kept(state, {})
        if "ended" in before:
            if state.hasTimedOut:
                state.remove()
            else:
                keep(state, before)
                state.setTimeoutTimestamp(now + forget_ms)
            return
        new = [] if state.hasTimedOut else [(int(r.at.timestamp() * 1000), int(r.priority), int(r.seq), r.kind, r.text or "", int(r.backends)) for pdf in batches for r in pdf.itertuples()]
        if not before:
            if not new:
                return
            before = {"backends": new[0][5]}
        before["waiting"] = [*before.get("waiting", []), *(r[:5] for r in new)]
        request = Failover(head_ms, inactivity_ms, **before)
        request.advance(now)
        keep(state, {"ended": True} if request.over else request.state())
        state.setTimeoutTimestamp(now + forget_ms if request.over else request.wake(now))
        if request.out:
            yield pd.DataFrame([(key[0], *o) for o in request.out], columns=["request_id", "priority", "part", "text", "state"])

    return attempts.withWatermark("at", delay).groupBy("request_id").applyInPandasWithState(step, OUTCOME, "kept string", "append", "EventTimeTimeout")


def failover_batch(attempts: DataFrame, head_ms: int = 30_000, inactivity_ms: int = 30_000) -> DataFrame:
    """request_id, priority, text, state: the same from all rows at once."""
    ms = F.unix_millis("at")
    rows = attempts.select("request_id", "priority", "seq", "kind", F.coalesce("text", F.lit("")).alias("text"), "backends", ms.alias("at"))
    own = Window.partitionBy("request_id", "priority").orderBy("at", "seq")
    rows = rows.withColumns({"gap": F.col("at") - F.lag("at").over(own), "n": F.row_number().over(own)})
    heads = rows.groupBy("request_id", "priority").agg(F.max(F.when((F.col("n") == 2) & (F.col("kind") != "error") & (F.col("gap") <= head_ms), True)).alias("answers"), F.max("backends").alias("backends"))
    chosen = heads.groupBy("request_id").agg(F.min(F.when(F.col("answers"), F.col("priority"))).alias("turn"), F.max("backends").alias("backends"))
    answer = rows.filter("n > 1").join(chosen.select("request_id", "turn"), "request_id").filter("priority = turn")
    how = F.when((F.col("n") > 2) & (F.col("gap") > inactivity_ms), "timeout").when(F.col("kind") == "delta", "open").when(F.col("kind") == "error", "error").otherwise("done")
    answer = answer.withColumn("state", how)
    end = F.min(F.when(F.col("state") != "open", F.col("n"))).over(Window.partitionBy("request_id"))
    kept = answer.withColumn("end", end).filter("end IS NULL OR n <= end")
    said = F.transform(F.array_sort(F.collect_list(F.struct("n", F.when(F.col("state").isin("open", "done"), F.col("text")).otherwise("").alias("t")))), lambda p: p["t"])
    found = kept.groupBy("request_id").agg(F.array_join(said, "").alias("text"), F.max_by("state", "n").alias("state"))
    last = F.coalesce(F.when(F.col("state") == "open", "timeout").otherwise(F.col("state")), F.lit("failed"))  # after its last row a backend stays silent
    return chosen.join(found, "request_id", "left").select("request_id", F.coalesce("turn", "backends").cast("int").alias("priority"), F.coalesce("text", F.lit("")).alias("text"), last.alias("state"))


# Dictation: events (speaker, session, event_no, result_index, is_final, transcript)

HEARD = "speaker string, session long, events long, text string"


class Dictation:
    """The newest session of a speaker: final results by their index, and the latest interim result unless it became final."""

    def __init__(self, session: int = -1, events: int = 0, finals: dict | None = None, interim: list | None = None) -> None:
        self.session, self.events, self.interim = session, events, interim
        self.finals = {int(k): tuple(v) for k, v in (finals or {}).items()}

    def state(self) -> dict:
        return {"session": self.session, "events": self.events, "finals": self.finals, "interim": self.interim}

    def add(self, session: int, no: int, index: int, is_final: bool, said: str) -> None:
        if session < self.session:
            return  # stale
        if session > self.session:
            self.session, self.events, self.finals, self.interim = session, 0, {}, None
        self.events += 1
        if not is_final:
            self.interim = max(self.interim or [-1], [no, index, said])
        elif no > self.finals.get(index, (-1,))[0]:
            self.finals[index] = (no, said)

    def text(self) -> str:
        final = " ".join(self.finals[i][1].strip(" ") for i in sorted(self.finals))
        waits = self.interim[2].strip(" ") if self.interim and self.interim[1] not in self.finals else ""
        return f"{final} {waits}" if final and waits else final or waits


def dictation_stream(events: DataFrame) -> DataFrame:
    """Each speaker's text after every batch that changes it; ``events`` counts those of the session so far."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        own = Dictation(**kept(state, {}))
        before = (own.session, own.events)
        for pdf in batches:
            for r in pdf.itertuples():
                own.add(int(r.session), int(r.event_no), int(r.result_index), bool(r.is_final), r.transcript or "")
        keep(state, own.state())
        if (own.session, own.events) != before:
            yield pd.DataFrame([(key[0], own.session, own.events, own.text())], columns=["speaker", "session", "events", "text"])

    return events.groupBy("speaker").applyInPandasWithState(step, HEARD, "kept string", "append", "NoTimeout")


def newest_text(heard: DataFrame) -> DataFrame:
    """speaker, session, text: the last that a stream said of each speaker."""
    last = heard.groupBy("speaker").agg(F.max(F.struct("session", "events", "text")).alias("h"))
    return last.select("speaker", "h.session", "h.text")


def dictation_batch(events: DataFrame) -> DataFrame:
    """The same from all events at once."""
    newest = events.groupBy("speaker").agg(F.max("session").alias("session"))
    own = events.join(newest, ["speaker", "session"])
    finals = own.filter("is_final").groupBy("speaker", "session", "result_index").agg(F.max_by("transcript", "event_no").alias("said"))
    said = F.transform(F.array_sort(F.collect_list(F.struct("result_index", F.trim(F.coalesce("said", F.lit(""))).alias("t")))), lambda p: p["t"])
    final = finals.groupBy("speaker", "session").agg(F.array_join(said, " ").alias("final"), F.collect_list("result_index").alias("settled"))
    interim = own.filter("NOT is_final").groupBy("speaker", "session").agg(F.max_by(F.struct("result_index", F.trim(F.coalesce("transcript", F.lit(""))).alias("t")), "event_no").alias("i"))
    both = newest.join(final, ["speaker", "session"], "left").join(interim, ["speaker", "session"], "left")
    open_ = F.when(~F.coalesce(F.array_contains("settled", F.col("i")["result_index"]), F.lit(False)), F.nullif(F.col("i")["t"], F.lit("")))
    return both.select("speaker", "session", F.concat_ws(" ", F.nullif("final", F.lit("")), open_).alias("text"))


def run_over_files(spark: SparkSession, rows: DataFrame, make: Callable[[DataFrame], DataFrame], files: int = 4, order: Column | None = None) -> DataFrame:
    """What a stream operator makes of rows that arrive in so many batches, dealt by ``order`` (a hash of the row by default).

    The rows are written once, by as many tasks as they come from; a batch's folder then moves to where the stream looks,
    and the stream goes on from its checkpoint over what is new there.
    """
    from quernstone.tables import new_path

    staged, source, sink, checkpoint = (new_path(spark, f"stream-{n}") for n in ("staged", "source", "sink", "checkpoint"))
    dealt = rows.withColumn("_batch", F.pmod(F.xxhash64(*rows.columns) if order is None else order, F.lit(files)))
    dealt.write.partitionBy("_batch").parquet(staged)
    at = spark._jvm.org.apache.hadoop.fs.Path
    store = at(source).getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(at(source))
    made = make(spark.readStream.schema(rows.schema).parquet(f"{source}/*"))

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={epoch}")  # a repeated batch writes its folder again

    for b in range(files):
        arrived = at(f"{staged}/_batch={b}")
        if b and not store.exists(arrived):
            continue
        if store.exists(arrived) and not store.rename(arrived, at(f"{source}/arrived-{b}")):
            raise OSError(f"{arrived} can't be moved")
        made.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).option("basePath", sink).parquet(f"{sink}/batch=*").select(made.columns)
