"""Streams with state: random cuts, shuffled and late arrival, timers by a clock that the rows' times set."""

import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from quernstone.streaming import stateful as m

RNG = random.Random(11)


def sse_requests():
    out = {}
    for n in range(30):
        words = [RNG.choice(["سلام", "hello ", "é😀", '"quoted"\n', "", "data: x", " a  b "]) for _ in range(RNG.randint(0, 9))]
        events = ["data: " + json.dumps({"text": w}, ensure_ascii=n % 2 == 0) for w in words]
        events += [RNG.choice(["data: [DONE]", ": comment", "data: {broken", 'data: {"choices": [{"delta": {"content": "c"}}]}', "event: x\ndata: " + json.dumps({"text": "two"}) + "\ndata: " + json.dumps({"text": " lines"}), "data: 5", ""])]
        RNG.shuffle(events)
        end = n % 4
        body = "\n\n".join(events) + ("\n\n" if n % 3 else "")
        if end == 1:
            body += ("" if n % 3 else "\n\n") + 'data: {"done": true, "backend": "x"}\n\ndata: {"text": "after the end"}\n\n'
        elif end == 2:
            body += ("" if n % 3 else "\n\n") + 'data: {"text": "x"}\n\ndata: {"error": "broke"}\n\ndata: {"text": "after"}'
        out[f"r{n}"] = body.encode()
    return out


def test_events_cut_anywhere(spark, tmp_path):
    rows = []
    for k, body in sse_requests().items():
        cuts = sorted({0, len(body), *(RNG.randint(0, len(body)) for _ in range(RNG.randint(0, 12)))})
        pieces = [body[a:b] for a, b in zip(cuts, cuts[1:])] or [b""]
        rows += [(k, i, bytearray(p), i == len(pieces) - 1) for i, p in enumerate(pieces)]
    RNG.shuffle(rows)
    chunks = spark.createDataFrame(rows, "request_id string, seq long, chunk binary, last boolean")
    want = {r["request_id"]: (r["text"], r["error"]) for r in m.sse_batch(chunks).collect()}
    assert len(want) == 30 and {e for _, e in want.values()} == {None, "broke"}
    got = m.run_over_files(spark, chunks, lambda s: m.sse_stream(s, 0), 5)
    assert {r["request_id"]: (r["text"], r["error"]) for r in m.sse_text(got).collect()} == want
    ends = got.groupBy("request_id").agg(F.count_if(F.col("done") | F.col("error").isNotNull()).alias("n")).collect()
    assert {r["n"] for r in ends} == {1} and len(ends) == 30


def test_state_is_empty_after_the_end(spark, tmp_path):
    rows = [("a", 0, bytearray(b'data: {"te'), False), ("a", 1, bytearray(b'xt": "x"}\n\ndata: {"done": true}\n\n'), False), ("a", 2, bytearray(b"late"), True), ("b", 0, bytearray(b"data: {}"), True)]
    spark.createDataFrame(rows, "request_id string, seq long, chunk binary, last boolean").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("request_id string, seq long, chunk binary, last boolean").parquet(f"{tmp_path}/in")
    q = m.sse_stream(stream, 0).writeStream.format("memory").queryName("sse_end").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 0
    assert [(r["request_id"], r["text"], r["done"]) for r in spark.sql("SELECT * FROM sse_end ORDER BY request_id, event_no").collect()] == [("a", "x", False), ("a", "", True), ("b", "", True)]


T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def attempts(n: int):
    """Backends that answer, fail, stay silent or stop in the middle, by chance; times in seconds."""
    rows = []
    for k in range(n):
        backends, at = RNG.randint(1, 3), RNG.randint(0, 50)
        for p in range(backends):
            t, seq = at + 40 * p, 0
            if RNG.random() < 0.1:
                continue  # never began
            rows.append((f"q{k}", p, T0 + timedelta(seconds=t), seq, "start", None, backends))
            for _ in range(RNG.randint(0, 5)):
                t, seq = t + RNG.choice([0, 1, 5, 30, 31]), seq + 1
                kind = RNG.choice(["delta"] * 5 + ["error", "end"])
                rows.append((f"q{k}", p, T0 + timedelta(seconds=t), seq, kind, f"{p}.{seq} ", backends))
                if kind != "delta":
                    break
    return rows


SCHEMA = "request_id string, priority int, at timestamp, seq int, kind string, text string, backends int"


def failed_over_by_hand(rows):
    out = {}
    for k in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == k]
        out[k] = (own[0][6], "", "failed")
        for p in range(own[0][6]):
            log = sorted((r for r in own if r[1] == p), key=lambda r: (r[2], r[3]))
            if len(log) < 2 or log[1][4] == "error" or (log[1][2] - log[0][2]).total_seconds() > 30:
                if not log:  # its turn never ends
                    pass
                continue
            text, state = "", "timeout"
            for before, r in zip(log, log[1:]):
                if (r[2] - before[2]).total_seconds() > 30 and r is not log[1]:
                    break
                if r[4] == "error":
                    state = "error"
                    break
                text += r[5]
                if r[4] == "end":
                    state = "done"
                    break
            out[k] = (p, text, state)
            break
    return out


def test_failover_by_batch(spark):
    rows = attempts(200)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["request_id"]: (r["priority"], r["text"], r["state"]) for r in m.failover_batch(df).collect()}
    assert got == failed_over_by_hand(rows) and {s for *_, s in got.values()} == {"done", "error", "timeout", "failed"}


def test_failover_stream_with_a_clock(spark):
    """Rows arrive shuffled within the watermark; the clock is the rows' own time, moved on by a last row far ahead."""
    from quernstone.operators.matching import first_success

    rows = [r for r in attempts(60)]
    began = {(r[0], r[1]) for r in rows}
    rows = [r for r in rows if all((r[0], p) in began for p in range(r[6]))]  # each backend is at least tried
    df = spark.createDataFrame([*rows, *(("clock", 0, T0 + timedelta(hours=h), h, "start", None, 1) for h in (2, 3))], SCHEMA)
    got = m.run_over_files(spark, df, lambda s: m.failover_stream(s, delay="1 hour"), 5, F.when(F.col("request_id") == "clock", F.col("seq") + 1).otherwise(F.pmod(F.xxhash64("request_id", "priority", "seq"), F.lit(3)))).filter("request_id <> 'clock'")
    parts = {}
    for r in sorted(got.collect(), key=lambda r: r["part"]):
        p, text, _ = parts.get(r["request_id"], (0, "", ""))
        parts[r["request_id"]] = (r["priority"], text + (r["text"] if r["state"] in ("open", "done") else ""), r["state"])
    want = failed_over_by_hand(rows)
    assert parts == want
    heads = df.filter("request_id <> 'clock'").groupBy("request_id", "priority").agg(F.min_by(F.struct("kind", "at"), F.when(F.col("kind") != "start", F.col("seq"))).alias("f"), F.min("at").alias("began"))
    ok = (F.col("f.kind") != "error") & (F.unix_millis("f.at") - F.unix_millis("began") <= 30_000)
    assert {r["request_id"]: r["priority"] for r in first_success(heads, "request_id", "priority", "priority", F.coalesce(ok, F.lit(False))).collect()} == {k: p if s != "failed" else None for k, (p, _, s) in want.items()}


def dictated(n: int):
    rows = []
    for k in range(n):
        for session in range(RNG.randint(1, 3)):
            no, index = 0, 0
            for _ in range(RNG.randint(1, 12)):
                final = RNG.random() < 0.5
                rows.append((f"s{k}", session, no, index, final, RNG.choice([" سلام ", "one", "two  words", "", None])))
                no, index = no + 1, index + final
    RNG.shuffle(rows)
    return rows


@pytest.mark.parametrize("files", [1, 6])
def test_dictation_in_any_order(spark, files):
    rows = dictated(25)
    df = spark.createDataFrame(rows, "speaker string, session long, event_no long, result_index int, is_final boolean, transcript string")
    want = {r["speaker"]: (r["session"], r["text"]) for r in m.dictation_batch(df).collect()}
    for k in want:  # by plain loops
        newest = max(r[1] for r in rows if r[0] == k)
        own = sorted((r for r in rows if r[:2] == (k, newest)), key=lambda r: r[2])
        finals = {r[3]: (r[5] or "").strip() for r in own if r[4]}
        interim = [r for r in own if not r[4]]
        text = " ".join(finals[i] for i in sorted(finals))
        open_ = (interim[-1][5] or "").strip() if interim and interim[-1][3] not in finals else ""
        assert want[k] == (newest, f"{text} {open_}" if text and open_ else text or open_)
    got = m.run_over_files(spark, df, m.dictation_stream, files)
    assert {r["speaker"]: (r["session"], r["text"]) for r in m.newest_text(got).collect()} == want


def test_requests_share_groups(spark):
    """Requests of one group with gaps over batches, one without an id, ended ones; the function is called once a group and batch."""
    body = lambda k: b"".join(b'data: {"text": "%d-%d "}\n\n' % (k, i) for i in range(5)) + (b'data: {"done": true}\n\n' if k % 2 else b"")
    rows = []
    for k in range(40):
        cut = [body(k)[i : i + 9] for i in range(0, len(body(k)), 9)]
        rows += [(None if k == 7 else f"r{k}", i, c, i == len(cut) - 1) for i, c in enumerate(cut)]
    chunks = spark.createDataFrame(rows, "request_id string, seq long, chunk binary, last boolean").repartition(3)
    stream = m.run_over_files(spark, chunks, lambda s: m.sse_stream(s, 0, groups=3), 3)
    got = {r["request_id"]: r["text"] for r in m.sse_text(stream).collect()}
    assert got == {None if k == 7 else f"r{k}": " ".join(f"{k}-{i}" for i in range(5)) for k in range(40)}
