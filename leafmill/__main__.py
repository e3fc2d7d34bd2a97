"""Command line: python -m leafmill INPUT --out FOLDER --translate LANGUAGE.

INPUT is a text, an EPUB package, or a folder of either. Texts come out in FOLDER/texts, packages in FOLDER/packages, each with its cache, by
which a further run asks for the rest only. Without --base-url the offline model answers; the service's key comes from LEAFMILL_API_KEY.
Exit codes: 0 done, 1 stopped or failed, 130 interrupted."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.text import KANA, blocks
from .operators import chunking, xhtml
from .plans import estimate, jobs
from .plans.http import TIMEOUT, http_chat
from .plans.rounds import Limits
from .plans.translate import Stopped
from .sources import files, tables

#: Fixed value: the language that texts are translated into where none is named.
TARGET = "简体中文"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="leafmill", description="Translate texts and EPUB packages.")
    p.add_argument("input")
    p.add_argument("--out", action="append", default=None, help="output folder; several are tried in order")
    p.add_argument("--translate", default=TARGET)
    p.add_argument("--format", choices=["txt", "epub", "both"], default="both")
    p.add_argument("--base-url", default=os.environ.get("LEAFMILL_BASE_URL", ""))
    p.add_argument("--model", default="")
    p.add_argument("--timeout", type=float, default=TIMEOUT)
    p.add_argument("--max-requests", type=int, default=0)
    p.add_argument("--max-output-tokens", type=int, default=0)
    p.add_argument("--stall-limit", type=int, default=25)
    p.add_argument("--failure-limit", type=int, default=5)
    p.add_argument("--together", type=int, default=0, help="requests sent together at most")
    p.add_argument("--keep-ruby", action="store_true")
    p.add_argument("--no-resume", action="store_true")
    p.add_argument("--dry-run", action="store_true", help="say what a run would take, and ask nothing")
    return p


def dry_run(texts, epubs) -> dict:
    """A4: the plan of both kinds of input together."""
    docs = epubs.where(files.is_document(F.col("name"))).select(F.struct("path", "name").alias("id"), F.decode("data", "UTF-8").alias("html"))
    units = xhtml.units(xhtml.tokens(docs, "id", F.col("html")), "id").select(F.to_json("id").alias("doc"), F.col("unit").alias("seg_id"), "text")
    segments = texts.select(F.col("path").alias("doc"), F.col("page_no").alias("seg_id"), "text").unionByName(units)
    pieces = segments.select("doc", "seg_id", F.posexplode(chunking.split_long(F.col("text"))).alias("k", "text"))
    batches = chunking.batched(pieces, ["doc", "seg_id"]).select("part", "nth", F.explode("items").alias("x"))
    numbered = batches.select(F.concat_ws(":", "part", "nth").alias("doc"), F.lit(0).alias("batch"), F.col("x.k").alias("k"), F.col("x.text").alias("text"))
    return estimate.plan(numbered, "doc").first().asDict() | {"segments": segments.count()}


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    found = files.scan(spark, args.input)
    raw = found.where("kind = 'txt'").select("path", files.decoded(F.col("content")).alias("text"))
    texts = chunking.block_pages(raw, "path", blocks(F.col("text")))
    packages = found.where("kind = 'epub'").select("path", "content")  # by what they are, whatever their names
    if args.dry_run:
        for name, value in dry_run(texts, files.epub_entries(packages)).items():
            print(f"{name}: {value}")
        return 0
    backend = http_chat(args.base_url, os.environ.get("LEAFMILL_API_KEY", ""), args.model, args.timeout) if args.base_url else offline
    limits = Limits(max_requests=args.max_requests or 1 << 60, max_tokens=args.max_output_tokens or 1 << 60, stall_limit=args.stall_limit, failure_limit=args.failure_limit, together=args.together or None)
    formats = ("txt", "epub") if args.format == "both" else (args.format,)
    out = args.out or [args.input.rstrip("/").rsplit(".", 1)[0] + "_out"]
    try:
        if packages.limit(1).count():
            jobs.run_epubs(packages, args.translate, f"{tables.first_writable(spark, out)[0]}/packages", backend, limits, args.keep_ruby)
        if texts.limit(1).count():
            segments = texts.select(F.col("path").alias("doc"), F.col("page_no").alias("seg_id"), "text")
            done = jobs.run_texts(segments, args.translate, [f"{o}/texts" for o in out], backend, limits, formats, not args.no_resume, source=args.input)
            print(", ".join(f"{k}: {v}" for k, v in done.items()))
        elif raw.limit(1).count():
            raise ValueError("the text has nothing to translate")
    except KeyboardInterrupt:
        return 130
    except (Stopped, ValueError, PermissionError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


def offline(texts: list[str]) -> list[str]:
    """The offline model as a backend: functions.text.stub_translation's rule for texts in Python."""
    import re

    return ["【译】" + re.sub("[぀-ゟ゠-ヿ]", "*", t) for t in texts]


if __name__ == "__main__":
    sys.exit(main())
