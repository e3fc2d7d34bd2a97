"""Requests in rounds: batches across segments, limits of a whole job, errors as rows, follow-ups, chat models, jobs."""

import json
import re
import sys
import time

import pytest
from leafmill.operators import chunking
from leafmill.plans import jobs, rounds, translate
from leafmill.plans.rounds import Chat, Limits, ServiceError
from leafmill.sources import books, files, sinks, tables
from pyspark import cloudpickle
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # backends go to the executors
CALLS = "calls.txt"


def counting(folder, answer):
    """A backend that writes a line for each request it gets, and answers by answer(texts)."""
    path = f"{folder}/{CALLS}"

    def backend(texts):
        with open(path, "a") as f:
            f.write(json.dumps(texts) + "\n")
        return answer(texts)

    return backend


def calls(folder):
    try:
        with open(f"{folder}/{CALLS}") as f:
            return [json.loads(line) for line in f]
    except FileNotFoundError:
        return []


def segments(spark, n, text="text {}"):
    return spark.createDataFrame([(i, text.format(i)) for i in range(n)], "seg_id long, text string").repartition(8)


def known(spark):
    return spark.createDataFrame([], "k string, t string")


QUICK = {"pause": 0.0}


def test_short_segments_share_requests(spark, tmp_path):
    out, run = translate.translate_run(segments(spark, 96), known(spark), "en", counting(tmp_path, lambda t: [x.upper() for x in t]))
    assert out.where("ok and out = upper(text)").count() == 96
    assert run.requests == 4 and [len(c) for c in calls(tmp_path)] == [24] * 4 and run.filled == 96


def test_batches_are_those_of_the_loop_and_keep_to_documents(spark):
    import random

    r = random.Random(4)
    rows = [(d, i, "x" * r.choice([3, 50, 700, 1200])) for d in range(6) for i in range(r.randrange(1, 60))]
    df = spark.createDataFrame(rows, "doc long, seg_id long, text string").withColumn("k", F.lit(0)).repartition(5)
    got = [[(x["seg_id"], x["text"]) for x in b["items"]] for b in chunking.batched(df, ["doc", "seg_id"]).orderBy("part", "nth").collect()]
    want = []
    for d in range(6):
        mine = [(i, t) for e, i, t in rows if e == d]
        for number, item in zip(chunking.batch_numbers([len(t) for _, t in mine]), mine, strict=True):
            if number == 0 and item is mine[0] or number != last:
                want.append([])
            want[-1].append(item)
            last = number
    assert got == want


@pytest.mark.parametrize("partitions", [1, 9])
def test_batches_of_one_long_document_in_many_ranges(partitions, spark):
    import random

    r = random.Random(partitions)
    sizes = [r.choice([0, 1, 5, 30, 75, 200, 900, 1799, 1800, 1801, 5000]) if r.random() < 0.7 else 3 for _ in range(30_000)]
    docs = [(0 if i < 20_000 else i // 7 if i < 22_000 else 9_000_000, i) for i in range(len(sizes))]
    df = spark.createDataFrame([(d, i, n) for (d, i), n in zip(docs, sizes, strict=True)], "doc long, seg_id long, n int").selectExpr("doc", "seg_id", "0 as k", "repeat('x', n) as text").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = chunking.batched(df, ["doc", "seg_id"]).select("nth", F.transform("items", lambda x: x["seg_id"]).alias("ids"))
        got = [r["ids"] for r in made.orderBy("nth").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, used = [], 0
    for k, ((d, i), n) in enumerate(zip(docs, sizes, strict=True)):
        if not k or d != docs[k - 1][0] or used + n > 1800 or len(want[-1]) >= 24:
            want.append([])
            used = 0
        want[-1].append(i)
        used += n
    assert got == want


def test_next_and_last_starts_equal_the_loop():
    import random

    import numpy as np

    r = random.Random(8)
    for _ in range(300):
        sizes = [r.randint(0, 9) for _ in range(r.randint(1, 40))]
        new = [r.random() < 0.1 for _ in sizes]
        nexts = chunking.next_starts(np.array(sizes), np.array(new), 12, 4)
        to, count = chunking.last_starts(nexts)
        for i in range(len(sizes)):
            at, starts, used, held = i, [i], 0, 0
            for k in range(i, len(sizes)):
                if k > at and (new[k] or used + sizes[k] > 12 or held >= 4):
                    at, used, held = k, 0, 0
                    starts.append(k)
                used, held = used + sizes[k], held + 1
            assert nexts[i] == (starts[1] if len(starts) > 1 else len(sizes)) and (to[i], count[i]) == (starts[-1], len(starts))


def test_requests_carry_what_stands_before(spark, tmp_path):
    page = "<p>one <b>two</b></p><p>three<br/>four" + "x" * 500 + "<i>five</i></p>"
    book = sinks.package([("a.opf", b"<dc:language>en</dc:language>"), ("c.xhtml", page.encode())])
    path = f"{tmp_path}/{CALLS}"

    def call(prompt, fields):
        with open(path, "a") as f:
            f.write(json.dumps(prompt) + "\n")
        sent = json.loads(prompt[prompt.index('{"items"'):])["items"]
        return json.dumps({"translations": [{"id": x["id"], "text": x["text"].upper()} for x in sent]}), 5, "stop"

    jobs.run_epubs(spark.createDataFrame([("b.epub", book)], "path string, content binary"), "en", f"file://{tmp_path}/out", Chat(call))
    sent = [x for prompt in calls(tmp_path) for x in json.loads(prompt[prompt.index('{"items"'):])["items"]]
    assert {x["text"][:5]: x.get("context") for x in sent} == {"one t": "", "three": "", "fourx": "three"}


@pytest.mark.parametrize("most", [1, 3])
def test_request_limit_holds_over_the_whole_job(most, spark, tmp_path):
    long = segments(spark, 20, "{} " + "x" * 1000)
    out, run = translate.translate_run(long, known(spark), "en", counting(tmp_path, lambda t: [x.upper() for x in t]), Limits(max_requests=most))
    assert len(calls(tmp_path)) == run.requests == most and run.why == "requests"
    assert out.where("ok").count() == most and out.where("not ok and out = text and why = '未译'").count() == 20 - most


def test_token_stall_and_failure_limits(spark, tmp_path):
    long = segments(spark, 20, "{} " + "x" * 1000)

    def run_with(name, answer, **limits):
        (folder := tmp_path / name).mkdir()
        _, run = translate.translate_run(long, known(spark), "en", counting(folder, answer), Limits(**QUICK, **limits))
        return len(calls(folder)), run.why

    def raises(error):
        def answer(texts):
            raise error

        return answer

    n, why = run_with("tokens", lambda t: ([x.upper() for x in t], 1000), max_tokens=2500)
    assert n <= 4 and why == "output_tokens"
    n, why = run_with("stall", lambda t: [""] * len(t), stall_limit=4)
    assert n <= 12 and why == "stall"
    assert run_with("down", raises(ConnectionError("x")), failure_limit=2, attempts=1) == (2, "failures")
    assert run_with("busy", raises(ServiceError(429, "slow")), failure_limit=2, attempts=3) == (6, "failures")
    assert run_with("late", raises(TimeoutError("x")), failure_limit=1) == (1, "failures")
    assert run_with("refused", raises(ServiceError(402, "Insufficient Balance"))) == (1, "auth")
    assert run_with("denied", raises(PermissionError("no"))) == (1, "auth")


def test_missing_answers_are_asked_for_again_in_halves(spark, tmp_path):
    answer = lambda t: [None if "13" in x or "7" in x and len(t) > 1 else x.upper() for x in t]
    out, run = translate.translate_run(segments(spark, 24), known(spark), "en", counting(tmp_path, answer), Limits(**QUICK))
    asked = calls(tmp_path)
    assert asked[0] == [f"text {i}" for i in range(24)] and sorted(asked[1:3]) == [["text 13", "text 17"], ["text 7"]]  # sent together, so either may be first
    got = {r["seg_id"]: (r["out"], r["ok"], r["why"]) for r in out.collect()}
    assert got[7] == ("TEXT 7", True, None) and got[13] == ("text 13", False, "返回缺失或为空") and got[2][1]
    assert run.why is None and len(asked) <= 2.5 * 24


def test_errors_are_rows(spark, tmp_path):
    def answer(texts):
        if any("5" in x for x in texts):
            raise RuntimeError("broken")
        return [x.upper() for x in texts]

    out, run = translate.translate_run(segments(spark, 10), known(spark), "en", counting(tmp_path, answer), Limits(**QUICK))
    assert {r["seg_id"] for r in out.where("not ok").collect()} == {5} and run.why is None


def reply(items, **more):
    return json.dumps({"translations": items} | more, ensure_ascii=False)


def items_of(prompt):
    return json.loads(prompt[prompt.index('{"items"') :])["items"]


def test_chat_model_by_id_place_and_without_json_mode(spark, tmp_path):
    path = str(tmp_path / "log")

    def call(prompt, fields):
        with open(path, "a") as f:
            f.write(json.dumps(fields) + "\n")
        if fields["json"]:
            raise ServiceError(400, "response_format is not supported")
        if "items" not in prompt:
            return (f"<{prompt.splitlines()[-1]}>" if fields["thinking"] == "enabled" else "I cannot do this"), 5, "stop"
        items = items_of(prompt)
        told = [{"id": x["id"], "text": x["text"].upper()} for x in items if "5" not in x["text"]]
        return f"```json\n{reply(told[::-1])}\n```", 7, "stop"

    out, run = translate.translate_run(segments(spark, 6), known(spark), "en", Chat(call), Limits(**QUICK))
    got = {r["seg_id"]: r["out"] for r in out.collect()}
    # by id, whatever the order; the missing one has no answer at its place either (the last of six), so it is asked alone, then with thinking
    assert got == {i: f"TEXT {i}" for i in range(5)} | {5: "<text 5>"}
    fields = [json.loads(x) for x in open(path)]
    assert fields[0]["json"] and not any(f["json"] for f in fields[1:]) and run.requests == len(fields)
    assert [f.get("thinking") for f in fields][-2:] == ["disabled", "enabled"]


def test_cut_answers_halve_the_batch(spark, tmp_path):
    path = str(tmp_path / "log")

    def call(prompt, fields):
        items = items_of(prompt) if "items" in prompt else [{"id": "x", "text": prompt.splitlines()[-1]}]
        with open(path, "a") as f:
            f.write(f"{len(items)}\n")
        if len(items) > 3:
            return reply([]), 10, "length"
        if "items" not in prompt:
            return items[0]["text"].upper(), 1, "stop"
        return reply([{"id": x["id"], "text": x["text"].upper()} for x in items]), 1, "stop"

    out, run = translate.translate_run(segments(spark, 12), known(spark), "en", Chat(call), Limits(**QUICK))
    assert out.where("out = upper(text)").count() == 12
    assert sorted(int(x) for x in open(path)) == [3, 3, 3, 3, 6, 6, 12] and run.tokens == 34


def test_job_writes_what_is_done_before_it_stops_and_goes_on_later(spark, tmp_path):
    rows = [(d, i, f"doc {d} seg {i} " + "x" * 1000) for d in range(3) for i in range(3)]
    segs = spark.createDataFrame(rows, "doc long, seg_id long, text string")
    out = f"file://{tmp_path}/out"
    upper = lambda t: [x.upper() for x in t]
    with pytest.raises(translate.Stopped, match="requests"):
        jobs.run_texts(segs, "en", out, counting(tmp_path, upper), Limits(max_requests=4), formats=("txt", "epub"), title="T & co")
    texts = lambda: {int(f.stem): f.read_text().split("\n\n", 1) for f in (tmp_path / "out/txt").iterdir() if f.suffix == ".txt"}
    assert texts()[0][0] == "T & co 0\n========\nlanguage: en" and len(texts()) == 3
    got = {d: body.removesuffix("\n") for d, (_, body) in texts().items()}
    assert got[0] == "\n\n".join(t.upper() for d, _, t in rows if d == 0)
    assert got[1] == "\n\n".join(t for d, _, t in rows if d == 1)  # unfinished: as it was
    assert spark.read.json(f"{out}/cache").count() == 4 and spark.read.json(f"{out}/failed").count() == 5
    summary = jobs.run_texts(segs, "en", out, counting(tmp_path, upper), formats=("txt",), api_key="secret")
    assert (summary["requests"], summary["cached"], summary["skipped"]) == (5, 4, 0) and len(calls(tmp_path)) == 9
    assert {body.removesuffix("\n") for _, body in texts().values()} == {"\n\n".join(t.upper() for e, _, t in rows if e == d) for d in range(3)}
    meta = spark.read.text(f"{out}/meta").first()[0]
    assert "secret" not in meta and '"requests":5.0' in meta
    names = {(r["path"].rsplit("/", 1)[1], r["name"]) for r in books.read_epubs(spark, f"{out}/epub").collect()}
    assert ("0.epub", "OEBPS/chap0001.xhtml") in names and ("2.epub", "META-INF/container.xml") in names


def test_epub_job(spark, tmp_path):
    opf = '<package><metadata><dc:language>ja</dc:language></metadata><manifest><item id="a" href="a.xhtml"/></manifest></package>'
    entries = [("META-INF/container.xml", '<rootfile full-path="c.opf"/>'), ("c.opf", opf), ("a.xhtml", '<p>say "hi" <b>it\'s</b></p><script>x</script><p>& 1 < 2</p>'), ("p.png", "\x00ANIM")]
    book = sinks.package([(n, d.encode()) for n, d in entries])
    packages = spark.createDataFrame([("b.epub", bytearray(book))], "path string, content binary")
    jobs.run_epubs(packages, "en", f"file://{tmp_path}/out", lambda t: [f"<{x}>" for x in t])
    made = next((tmp_path / "out/epub").glob("*.epub")).read_bytes()
    got = {n: d.decode() for _, n, d in files.entries(made)}
    assert list(got)[0] == "mimetype" and got["p.png"] == "\x00ANIM" and "<dc:language>en</dc:language>" in got["c.opf"]
    assert got["a.xhtml"] == '<p>&lt;say "hi" it\'s&gt; <b></b></p><script>x</script><p>& 1 < 2</p>'


def test_page_job_keeps_what_came_before_an_error(spark, tmp_path):
    pages = spark.createDataFrame([(f"k{i}", bytearray([i])) for i in range(6)], "key string, data binary")
    out = f"file://{tmp_path}/out"

    def ask(data):
        if data[0] == 4:
            raise ValueError("unreadable")
        return f"page {data[0]}"

    with pytest.raises(translate.Stopped, match="k4"):
        jobs.run_pages(pages, ask, out)
    assert spark.read.json(f"{out}/checkpoint").count() == 5
    again = jobs.run_pages(pages, lambda data: f"new {data[0]}", out)
    assert {r["key"]: r["answer"] for r in again.collect()} == {f"k{i}": f"{'new' if i == 4 else 'page'} {i}" for i in range(6)}


def test_books_have_all_parts(spark):
    pages = spark.createDataFrame([(1, i, f"<p>{i}</p>") for i in range(1, 12)] + [(2, 1, "<p>x</p>")], "book long, page_no int, html string")
    books = spark.createDataFrame([(1, 'A "b" & c', "zh-CN", "s<1>", "2020-01-01T00:00:00Z"), (2, "B", "en", None, "2020-01-01T00:00:00Z")], "book long, title string, lang string, source string, modified string")
    assets = spark.createDataFrame([(1, "img1", "figures/a&b.png", "image/png", bytearray(b"png"))], "book long, id string, href string, media_type string, data binary")
    made = sinks.packages(sinks.book_entries(pages, books, assets)).select(F.col("book").cast("string").alias("path"), "content")
    got = {}
    for r in files.epub_entries(made).orderBy("path", "ord").collect():
        got.setdefault(r["path"], {})[r["name"]] = bytes(r["data"]).decode()
    one = got["1"]
    assert list(one) == ["mimetype", "META-INF/container.xml", "OEBPS/content.opf", "OEBPS/nav.xhtml", "OEBPS/toc.ncx", "OEBPS/style.css", "OEBPS/chap0001.xhtml", "OEBPS/chap0002.xhtml", "OEBPS/figures/a&b.png"]
    assert "<dc:title>A &quot;b&quot; &amp; c</dc:title>" in one["OEBPS/content.opf"] and 'content="s&lt;1&gt;"' in one["OEBPS/content.opf"]
    assert re.findall('idref="([^"]+)"', one["OEBPS/content.opf"]) == ["chapter-1", "chapter-2"]
    assert 'href="figures/a&amp;b.png" media-type="image/png"' in one["OEBPS/content.opf"]
    assert "<p>8</p>" in one["OEBPS/chap0001.xhtml"] and "<p>9</p>\n<p>10</p>\n<p>11</p>" in one["OEBPS/chap0002.xhtml"]
    import xml.etree.ElementTree as ET

    for book in got.values():
        for name, text in book.items():
            if name.endswith((".xml", ".opf", ".ncx", ".xhtml")):
                ET.fromstring(text.replace("<!DOCTYPE html>\n", "").encode())
    uids = [re.search("urn:uuid:[0-9a-f-]{36}", got[b][f]).group(0) for b in ("1", "2") for f in ("OEBPS/content.opf", "OEBPS/toc.ncx")]
    assert uids[0] == uids[1] != uids[2] == uids[3]


def test_json_lines_are_appended(spark, tmp_path):
    out = f"file://{tmp_path}/log"
    for i in range(2):
        sinks.append_json(spark.createDataFrame([(f"k{i}", 'a "b"\n')], "k string, t string"), out)
    got = files.json_lines(spark.read.text(out), "k string, t string").collect()
    assert sorted((r["k"], r["t"]) for r in got) == [("k0", 'a "b"\n'), ("k1", 'a "b"\n')]


def test_rounds_send_each_request_once_while_many_run_together(spark, tmp_path):
    out, run = translate.translate_run(segments(spark, 60, "{} " + "x" * 1100), known(spark), "en", counting(tmp_path, lambda t: [x.upper() for x in t]), Limits(together=16))
    sent = [x for c in calls(tmp_path) for x in c]
    assert len(sent) == len(set(sent)) == 60 == run.requests and out.where("ok").count() == 60 and rounds.DEPTH == 4


def test_the_first_line_of_a_key_counts(spark, tmp_path):
    def lines(name, *rows):
        (tmp_path / name).write_text("".join(json.dumps({"k": k, "t": t, "v": v}) + "\n" for k, t, v in rows))

    lines("part-b.json", ("k", "good answer", 1), ("k", "As an AI I cannot", 1), ("m", "i cannot", 1), ("m", "zz later", 1), ("o", "old version", 0), ("o", "new", 1))
    got = {r["k"]: r["t"] for r in jobs.saved_cache(spark, f"file://{tmp_path}", "en").collect()}
    assert got == {"k": "good answer", "o": "new"}  # m's first line is not usable and hides its second
    time.sleep(0.05)
    lines("part-a.json", ("k", "a later answer", 1), ("n", "of the later file", 1))
    got = {r["k"]: r["t"] for r in jobs.saved_cache(spark, f"file://{tmp_path}", "en").collect()}
    assert got == {"k": "good answer", "o": "new", "n": "of the later file"}


@pytest.mark.parametrize("thinking, fails, sent", [("enabled", False, 2), ("disabled", False, 3), ("disabled", True, 2)])
def test_single_texts_are_asked_again_only_as_judged(thinking, fails, sent, spark, tmp_path):
    path = f"{tmp_path}/{CALLS}"

    def call(prompt, fields):
        with open(path, "a") as f:
            f.write(json.dumps(fields["thinking"]) + "\n")
        if fails:
            raise ServiceError(0, "no such model")
        return "As an AI I cannot", 5, "stop"

    out, run = translate.translate_run(segments(spark, 1), known(spark), "en", Chat(call, thinking), Limits(pause=0.0))
    assert run.requests == sent == len(calls(tmp_path)) and not out.first()["ok"]
    assert calls(tmp_path)[-1] == ("enabled" if sent == 3 else thinking)
    assert run.stalled == (2 if not fails else 2)


def test_rounds_leave_few_tables(spark, tmp_path):
    before = len(tables._made)
    translate.translate_run(segments(spark, 60, "{} " + "x" * 1100), known(spark), "en", counting(tmp_path, lambda t: [x.upper() for x in t]), Limits(together=8))
    assert len(calls(tmp_path)) == 60 and len(tables._made) - before <= 4


@pytest.mark.parametrize("bad, sent", [(0, 1), (3, 7)])
def test_page_job_stops_at_its_first_error(bad, sent, spark, tmp_path):
    pages = spark.createDataFrame([(f"k{i:03d}", bytearray([i])) for i in range(100)], "key string, data binary").repartition(8)
    path, out = f"{tmp_path}/{CALLS}", f"file://{tmp_path}/out"

    def ask(data):
        with open(path, "a") as f:
            f.write(f"{data[0]}\n")
        if data[0] == bad:
            raise ValueError("unreadable")
        return f"page {data[0]}", 10

    with pytest.raises(translate.Stopped, match=f"k{bad:03d}"):
        jobs.run_pages(pages, ask, out)
    assert len(calls(tmp_path)) == sent and sorted(calls(tmp_path)) == list(range(sent))
    with pytest.raises(translate.Stopped, match="requests"):
        jobs.run_pages(pages, lambda data: ask(data + b"x") if data[0] != bad else "now", out, Limits(max_requests=20))
    done = {r["key"]: r["answer"] for r in spark.read.json(f"{out}/checkpoint").collect()}
    assert len(done) == sent - 1 + 20 and done[f"k{bad:03d}"] == "now"
    assert jobs.run_pages(pages, lambda data: "later", out).count() == 100


def test_page_job_tries_again_and_tells_refused_accounts(spark, tmp_path):
    pages = spark.createDataFrame([("a", bytearray(b"a")), ("b", bytearray(b"b"))], "key string, data binary")
    path = f"{tmp_path}/{CALLS}"

    def busy(data):
        with open(path, "a") as f:
            f.write("1\n")
        raise ServiceError(503, "busy")

    with pytest.raises(translate.Stopped, match="503"):
        jobs.run_pages(pages, busy, f"file://{tmp_path}/o1", Limits(attempts=3, pause=0.0))
    assert len(calls(tmp_path)) == 3
    assert jobs.run_pages(pages.where("false"), busy, f"file://{tmp_path}/o2").count() == 0


def test_a_saved_cache_is_cleaned_in_place(spark, tmp_path):
    lines = [("a", "good", 1), ("a", "second", 1), ("b", "i cannot", 1), ("b", "hidden", 1), ("c", "old", 0), ("d", "かなだけ", 1), ("e", "", 1), ("f", "fine", 1)]
    for n in range(2):
        (tmp_path / "cache").mkdir(exist_ok=True)
        (tmp_path / f"cache/part-{n}.json").write_text("".join(json.dumps({"k": k, "t": t, "v": v}) + "\n" for k, t, v in lines[4 * n : 4 * n + 4]))
        time.sleep(0.05)
    out = f"file://{tmp_path}/cache"
    before = {r["k"]: r["t"] for r in jobs.saved_cache(spark, out, "中文").collect()}
    assert jobs.clean_cache(spark, out, "中文") == {"before": 8, "after": 2}
    assert {r["k"]: r["t"] for r in jobs.saved_cache(spark, out, "中文").collect()} == {"a": "good", "f": "fine"} == before
    assert spark.read.json(f"{out}.bak").count() == 8
    assert jobs.clean_cache(spark, out, "中文") == {"before": 2, "after": 2}
