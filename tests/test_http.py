"""The HTTP backend against a service of this machine, and the command line."""

import json
import sys
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from leafmill.__main__ import main
from leafmill.plans import translate
from leafmill.plans.http import http_chat, request_body
from leafmill.plans.rounds import Limits, ServiceError
from leafmill.sources import books, sinks
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture
def service():
    """(address, list of request bodies, a dict whose "how" tells the service what to do)."""
    seen, state = [], {"how": "ok"}

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append(body)
            how = state["how"]
            if how == "no json" and "response_format" in body:
                return self.reply(400, {"error": "response_format: not supported"})
            if how in ("429", "402"):
                return self.reply(int(how), {"error": "later"})
            if how == "late":
                threading.Event().wait(1.5)
            if how == "odd":
                return self.reply(200, {"nothing": 1})
            prompt = body["messages"][0]["content"]
            items = json.loads(prompt[prompt.index('{"items"') :])["items"]
            text = json.dumps({"translations": [{"id": x["id"], "text": "T" + x["text"]} for x in items]})
            self.reply(200, {"choices": [{"message": {"content": text}, "finish_reason": "stop"}], "usage": {"completion_tokens": 7, "details": {"completion_tokens": 99}}})

        def reply(self, code, body):
            data = json.dumps(body).encode()
            try:
                self.send_response(code)
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)
            except OSError:  # the other side has gone
                pass

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1", seen, state
    server.shutdown()


@pytest.mark.parametrize(("how", "sent", "why"), [("ok", 1, None), ("no json", 2, None), ("429", 3, "failures"), ("402", 1, "auth"), ("late", 1, "failures")])
def test_service(how, sent, why, service, spark):
    url, seen, state = service
    state["how"] = how
    segs = spark.createDataFrame([(i, f"text {i}") for i in range(5)], "seg_id long, text string")
    out, run = translate.translate_run(segs, spark.createDataFrame([], "k string, t string"), "en", http_chat(url, "key", "m", timeout=0.7), Limits(pause=0, attempts=3, failure_limit=1))
    assert (len(seen), run.why) == (sent, why)
    assert out.where("ok and out = concat('T', text)").count() == (5 if why is None else 0)
    if why is None:
        assert run.tokens == 7 and seen[0]["response_format"] == {"type": "json_object"} and seen[0]["thinking"] == {"type": "disabled"}


def test_requests_and_odd_replies(service):
    assert request_body("p", "m", {"thinking": "auto", "json": False}) == {"model": "m", "messages": [{"role": "user", "content": "p"}], "temperature": 0.3}
    url, _, state = service
    state["how"] = "odd"
    with pytest.raises(ServiceError, match="unexpected"):
        http_chat(url, "key", "m").call('{"items": []}', {})
    with pytest.raises(ConnectionError):
        http_chat("http://127.0.0.1:9", "key", "m").call("p", {})
    with pytest.raises(ValueError, match="key"):
        http_chat(url, "", "m")


def test_command_line(spark, tmp_path, capsys):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_bytes("第一段。\n\nSecond かな.\r\n\r\n  \n".encode("gb18030"))
    (folder / "b.epub").write_bytes(sinks.package([("META-INF/container.xml", b'<rootfile full-path="c.opf"/>'), ("c.opf", b"<dc:language>ja</dc:language>"), ("x.xhtml", "<p>one<ruby>二<rt>に</rt></ruby></p>".encode())]))
    assert main([str(folder), "--dry-run"]) == 0
    plan = dict(line.split(": ") for line in capsys.readouterr().out.splitlines())
    assert (plan["segments"], plan["pieces"], plan["batches"]) == ("3", "3", "2")
    out = f"file://{tmp_path}/out"
    assert main([str(folder), "--out", out, "--translate", "中文"]) == 0
    assert (tmp_path / "out/texts/txt/a.txt").read_text() == f"a\n====\nsource: {folder}\nlanguage: 中文\n\n【译】第一段。\n\n【译】Second **.\n"
    assert "skipped: 0" in capsys.readouterr().out
    made = books.read_epubs(spark, f"{out}/texts/epub").where("name like '%chap%'").first()
    assert "<p>【译】第一段。</p>" in bytes(made["data"]).decode()
    copy = {r["name"]: bytes(r["data"]).decode() for r in books.read_epubs(spark, f"{out}/packages/epub/b.epub").collect()}
    assert copy["x.xhtml"] == "<p>【译】one二<ruby></ruby></p>" and copy["c.opf"] == "<dc:language>zh-CN</dc:language>"
    (tmp_path / "empty.txt").write_text("\n\n")
    assert main([str(tmp_path / "empty.txt"), "--out", out]) == 1
