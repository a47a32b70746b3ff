"""Asking a service: one call a chunk, bounded requests, retries, failures, resumed runs."""

import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from io import BytesIO
from urllib.error import HTTPError, URLError

import pytest
from pyspark.sql import functions as F

from leafmill.packs import LanguagePack, Settings
from leafmill.sources import asking, models, writers

SCHEMA = "chunk_id string, source string, pdf_page int, section_ids array<string>, section_path array<string>, chunk_type string, text string"
PACK = LanguagePack(entity_types=["disease"])
QUICK = asking.Asking(in_flight=3, attempts=3, wait=0.01)


class Service:
    """A chat-completions service that counts; texts say how it behaves."""

    def __init__(self):
        self.calls, self.open, self.most, self.lock = Counter(), 0, 0, threading.Lock()
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                text = body["messages"][1]["content"].split("---\n")[1].strip()
                with outer.lock:
                    outer.calls[text] += 1
                    outer.open += 1
                    outer.most = max(outer.most, outer.open)
                    n = outer.calls[text]
                time.sleep(0.02)
                with outer.lock:
                    outer.open -= 1
                code = 503 if "busy" in text and n < 3 or "dead" in text else 400 if "bad" in text else 200
                said = "sorry, no" if "prose" in text else "{}" if "none" in text else json.dumps({"disease": [text.upper()]})
                answer = json.dumps({"choices": [{"message": {"content": said}}]}).encode() if code == 200 else b"{}"
                self.send_response(code)
                self.send_header("Content-Length", str(len(answer)))
                self.end_headers()
                self.wfile.write(answer)

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def client(self):
        url = f"http://127.0.0.1:{self.server.server_port}"
        return lambda: models.ChatClient(url, "m", PACK.entity_types)


@pytest.fixture
def service():
    found = Service()
    yield found
    found.server.shutdown()


def chunks(spark, texts):
    return spark.createDataFrame([(f"c{k:03}", "s", 1, ["i"], ["p"], "paragraph", x) for k, x in enumerate(texts)], SCHEMA)


def test_forty_chunks_are_forty_calls(spark, service):
    held = chunks(spark, [f"term {k}" if k % 4 else f"none {k}" for k in range(40)]).repartition(2)
    found = models.extracted(held, service.client(), PACK, how=QUICK)
    assert found.count() == 30 and len(found.where("size(entities['disease']) > 0").collect()) == 30
    assert sum(service.calls.values()) == 40 and set(service.calls.values()) == {1}
    assert service.most <= 2 * QUICK.in_flight


def test_the_call_stands_in_the_plan_once(spark, service, capsys):
    models.records(models.extraction(chunks(spark, ["a"]), service.client(), PACK, how=QUICK)).explain()
    plan = capsys.readouterr().out
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan


def test_retries_and_failures_as_rows(spark, service):
    texts = ["term", "busy term", "bad term", "dead term", "prose", "none", None]
    found = {r.chunk_id: r for r in models.extraction(chunks(spark, texts), service.client(), PACK, how=QUICK).collect()}
    told = [(found[f"c{k:03}"].status, found[f"c{k:03}"].attempts) for k in range(7)]
    assert told == [("kept", 1), ("kept", 3), ("failed", 1), ("failed", 3), ("unreadable", 1), ("no entity", 1), ("no entity", 1)]
    assert "400" in found["c002"].failure and "503" in found["c003"].failure and found["c000"].failure is None
    assert found["c001"].entities == {"disease": ["busy term"]}


def test_only_the_first_characters_are_asked_about(spark, service):
    models.extracted(chunks(spark, ["x" * 50]), service.client(), PACK, Settings(extractor_chars=7), QUICK)
    assert dict(service.calls) == {"x" * 7: 1}


def test_waits_double_and_follow_the_service():
    waits = []

    def failing(error):
        def ask(text):
            raise error

        return ask

    how = asking.Asking(attempts=5, wait=1, most_wait=5)
    assert asking.answered(failing(URLError("down")), "x", how, waits.append)[1] == 5 and waits == [1, 2, 4, 5]
    waits.clear()
    busy = HTTPError("u", 429, "busy", {"Retry-After": "3"}, BytesIO())
    answer, attempts, why = asking.answered(failing(busy), "x", how, waits.append)
    assert (answer, attempts, waits) == (None, 5, [3, 3, 3, 3]) and "429" in why
    waits.clear()
    for error, attempts in ((ValueError("odd"), 1), (HTTPError("u", 401, "who", None, BytesIO()), 1), (asking.Passing("later"), 5), (TimeoutError(), 5)):
        assert asking.answered(failing(error), "x", how, lambda s: None)[1] == attempts


def test_a_killed_run_goes_on_from_its_last_bucket(spark, service, tmp_path):
    held = chunks(spark, [f"term {k}" for k in range(40)])
    path, lost = str(tmp_path / "log"), F.col("status") == models.FAILED
    begun = []

    def killed(rows):
        begun.append(1)
        if len(begun) == 4:
            raise KeyboardInterrupt
        return models.extraction(rows, service.client(), PACK, how=QUICK)

    with pytest.raises(KeyboardInterrupt):
        writers.run_resumed(held, killed, path, buckets=8, again=lost)
    first = sum(service.calls.values())
    assert 0 < first < 40 and writers.finished(spark, path).count() == first
    told = writers.run_resumed(held, lambda rows: models.extraction(rows, service.client(), PACK, how=QUICK), path, buckets=8, again=lost)
    assert models.records(told).count() == 40 and sum(service.calls.values()) == 40
    # nothing is left to do, and what comes later is done alone
    more = held.union(chunks(spark, ["late"]).withColumn("chunk_id", F.lit("z")))
    assert writers.run_resumed(more, lambda rows: models.extraction(rows, service.client(), PACK, how=QUICK), path, buckets=8, again=lost).count() == 41
    assert sum(service.calls.values()) == 41


def test_failed_chunks_are_asked_again(spark, tmp_path):
    held, path, lost = chunks(spark, ["a", "b", "c"]), str(tmp_path / "log"), F.col("status") == models.FAILED

    def client(down):
        def ask(text):
            if text in down:
                raise ValueError("down")
            return json.dumps({"disease": [text]})

        return lambda: ask

    for down, done in ((("a", "b"), ["c"]), (("a",), ["b", "c"]), ((), ["a", "b", "c"])):
        told = writers.run_resumed(held, lambda rows, down=down: models.extraction(rows, client(down), PACK, how=QUICK), path, buckets=2, again=lost)
        assert sorted(r.entities["disease"][0] for r in models.records(told).collect()) == done
        assert writers.failed(spark, path).count() == len(down)


def test_a_bucket_that_broke_in_its_writes_is_done_again(spark, tmp_path, monkeypatch):
    rows, path = spark.range(20).withColumnRenamed("id", "chunk_id"), str(tmp_path / "log")
    whole, times = writers._finish_bucket, []

    def breaks(held, process, where, key, place, again):
        times.append(place)
        if len(times) == 3:  # rows are there, the mark is not
            process(held).write.mode("overwrite").parquet(f"{where}/rows/{place}")
            raise OSError("lost")
        whole(held, process, where, key, place, again)

    monkeypatch.setattr(writers, "_finish_bucket", breaks)
    with pytest.raises(OSError):
        writers.run_resumed(rows, lambda x: x.withColumn("run", F.lit(1)), path, buckets=5)
    monkeypatch.setattr(writers, "_finish_bucket", whole)
    found = writers.run_resumed(rows, lambda x: x.withColumn("run", F.lit(2)), path, buckets=5).collect()
    assert sorted(r.chunk_id for r in found) == list(range(20)) and {r.run for r in found} == {1, 2}
    assert writers.run_resumed(rows, lambda x: x.withColumn("run", F.lit(3)), path, buckets=5).where("run = 3").count() == 0


def test_empty_and_null_keys(spark, tmp_path):
    none = spark.createDataFrame([], "chunk_id string, n int")
    assert writers.run_resumed(none, lambda x: x, str(tmp_path / "a")).count() == 0
    rows = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "chunk_id string, n int")
    for k in range(1, 3):
        found = writers.run_resumed(rows, lambda x: x, str(tmp_path / "b")).collect()
        assert sorted(r.n for r in found) == [1, 2, *[3] * k]
