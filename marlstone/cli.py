"""Command line: ``python -m marlstone.cli --storage DIR COMMAND``; one Spark session per call."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import EngineConfig
from .engine import Engine
from .functions.formats import table, text_bytes, text_usd
from .operators import routing
from .operators.cost import CostModel
from .session import spark_session
from .sources.manifests import file_contents, read_eval_set, read_examples, read_manifest, read_texts, scan_images
from .tools import call_tool


def _print(data) -> None:
    print(json.dumps(data, indent=2, default=str, ensure_ascii=False))


def _text_of(args, engine: Engine) -> str:
    if args.text is not None:
        return args.text
    if args.file:
        return "\n".join(r["text"] for r in read_texts(engine.spark, args.file).collect())
    return sys.stdin.read()


def _ask(p: argparse.ArgumentParser, k: int | None) -> None:
    p.add_argument("query")
    p.add_argument("-k", type=int, default=k)
    p.add_argument("--modality", choices=("text", "vision", "hybrid"))
    p.add_argument("--rerank", action=argparse.BooleanOptionalAction)
    p.add_argument("--fusion", choices=("rrf", "calibrated"))


def _asked(args) -> dict:
    given = {"query": args.query, "top_k": args.k, "modality": args.modality, "rerank": args.rerank, "fusion": args.fusion}
    return {k: v for k, v in given.items() if v is not None}


def _add_text(args, e):
    _print({"chunks": e.add_text(args.doc_id, _text_of(args, e), args.title, replace=args.replace), "version": e.save()})


def _ingest_batch(args, e):
    rows = read_manifest(e.spark, args.manifest)
    rows = rows.repartition(args.workers) if args.workers > 1 else rows
    _print(e.add_documents(rows, args.replace) | {"version": e.save()})


def _with_selection(args, e: Engine) -> Engine:
    if args.vision_selection:
        e.config = e.config.with_settings(pixel_selection=args.vision_selection)
    return e


def _ingest_url(args, e):
    _print(_with_selection(args, e).ingest_url(args.id, args.url) | {"version": e.save()})


def _ingest_pdf(args, e):
    _print(_with_selection(args, e).ingest_pdf(args.id, args.pdf, not args.no_text, not args.no_vision) | {"version": e.save()})


def _show_cost(rows: DataFrame) -> None:
    own = [r.asDict() for r in rows.collect()]
    if own and "total_bytes" in own[0]:
        print(table([(f"{r['pages']:,}", r["mode"], text_bytes(r["bytes_per_page"]), text_bytes(r["total_bytes"]), text_usd(r["storage_usd_month"])) for r in own], ("pages", "mode", "a page", "total", "storage a month")))
    else:
        print(table([(r["mode"], text_bytes(r["vector_bytes"]), text_bytes(r["artifact_bytes"]), text_usd(r["storage_usd_month"]), text_usd(r["index_usd"]), text_usd(r["query_usd"])) for r in own], ("mode", "vectors", "artifacts", "storage a month", "indexing", "a query")))


def _eval(args, e):
    docs, queries, qrels = read_eval_set(e.spark, args.dataset)
    rows = docs.select("doc_id", "text", "title", "page", F.when(F.col("image_path").isNotNull(), F.array("image_path")).otherwise(F.array().cast("array<string>")).alias("image_paths"))
    full = rows.selectExpr("doc_id", "text", "CAST(NULL AS string) html", "coalesce(title, '') title", "coalesce(page, 0) page", "image_paths", "false apply_selection", "CAST(map() AS map<string,string>) meta", "monotonically_increasing_id() seq")
    e.add_documents(full)
    found = e.evaluate_timed(queries, qrels, tuple(int(k) for k in args.k.split(",")), tuple(args.modes.split(",")))
    if args.json:
        _print(found)
    else:
        head = ("mode", "k", "recall", "precision", "ndcg", "hit", "mrr", "ms/query", "note")
        print(table([(r["mode"], r["k"], *(f"{r[n]:.3f}" for n in ("recall", "precision", "ndcg", "hit", "mrr")), f"{r['ms_per_query']:.2f}", r["note"]) for r in found], head))
    if args.cost:
        _show_cost(e.cost())
        _show_cost(e.cost(args.project_pages))


def _cost(args, e):
    model = CostModel()
    if args.cost_model:
        with open(args.cost_model, encoding="utf-8") as f:
            model = CostModel.from_dict(json.load(f))
    parts = [e.cost(model=model)] + ([e.cost(args.project_pages, model)] if args.project_pages else [])
    if args.json:
        _print([[r.asDict() for r in p.collect()] for p in parts])
    else:
        for p in parts:
            _show_cost(p)


def _dedup(args, e):
    if args.dir:
        files = scan_images(e.spark, args.dir)
    elif args.images:
        files = file_contents(e.spark, args.images)
    else:
        print("dedup needs --dir or --images", file=sys.stderr)
        raise SystemExit(2)
    _print(e.dedup_stats(files.withColumn("seq", F.monotonically_increasing_id()), args.scope, args.method, args.tile_bytes))


def _train_router(args, e):
    if args.examples:
        rows = read_examples(e.spark, args.examples)
    else:
        rows = e.spark.createDataFrame(routing.SEED, "query string, label double")
    weights = routing.fit_router(rows, args.iterations, args.lr)
    routing.save_router(weights, args.out)
    _print({"examples": rows.count(), "weights": weights})


def _serve(args, e):
    """GET /health, GET /search?q=&k=&modality=&rerank=&fusion=, POST /search with the same names in JSON."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, code: int, data) -> None:
            body = json.dumps(data, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def _search(self, a: dict) -> None:
            given = {"query": a.get("q") or a.get("query"), "top_k": a.get("k") and int(a["k"]), "modality": a.get("modality"), "rerank": a.get("rerank"), "fusion": a.get("fusion")}
            try:
                self._send(200, call_tool("search", {k: v for k, v in given.items() if v is not None}, e))
            except ValueError as error:
                self._send(400, {"error": str(error)})

        def do_GET(self):
            at = urlparse(self.path)
            if at.path == "/health":
                self._send(200, {"status": "ok", **e.stats()})
            elif at.path == "/search":
                self._search({k: v[0] for k, v in parse_qs(at.query).items()})
            else:
                self._send(404, {"error": "not found"})

        def do_POST(self):
            if self.path == "/search":
                self._search(json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))) or b"{}"))
            else:
                self._send(404, {"error": "not found"})

    e.text_units.persist()
    e.vision_units.persist()
    HTTPServer((args.host, args.port), Handler).serve_forever()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="marlstone")
    top.add_argument("--storage", default=EngineConfig().storage.folder)
    top.add_argument("--config")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, run: Callable) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        return p

    p = command("add-text", _add_text)
    p.add_argument("doc_id")
    p.add_argument("--text")
    p.add_argument("--file")
    p.add_argument("--title", default="")
    p.add_argument("--replace", action="store_true")
    p = command("delete", lambda a, e: _print(e.delete([a.doc_id]) | {"version": e.save()}))
    p.add_argument("doc_id")
    command("list-docs", lambda a, e: _print(e.doc_ids()))
    p = command("ingest-url", _ingest_url)
    p.add_argument("url")
    p.add_argument("--id", required=True)
    p.add_argument("--vision-selection", choices=("auto", "always", "never"))
    p = command("ingest-pdf", _ingest_pdf)
    p.add_argument("pdf")
    p.add_argument("--id", required=True)
    p.add_argument("--vision-selection", choices=("auto", "always", "never"))
    p.add_argument("--no-text", action="store_true")
    p.add_argument("--no-vision", action="store_true")
    p = command("ingest-batch", _ingest_batch)
    p.add_argument("manifest")
    p.add_argument("--batch-size", type=int, default=128, help="has no effect: Spark's tasks are the batches")
    p.add_argument("--workers", type=int, default=1, help="number of tasks that prepare documents")
    p.add_argument("--replace", action="store_true")
    p = command("richness", lambda a, e: _print(e.richness(a.text, a.html)))
    p.add_argument("--text")
    p.add_argument("--html")
    _ask(command("search", lambda a, e: _print(call_tool("search", _asked(a), e))), 10)
    _ask(command("answer", lambda a, e: _print(call_tool("answer", _asked(a), e))), 5)
    command("stats", lambda a, e: _print(e.stats()))
    p = command("eval", _eval)
    p.add_argument("dataset")
    p.add_argument("-k", default="1,3,5,10")
    p.add_argument("--modes", default="text,vision,hybrid")
    p.add_argument("--json", action="store_true")
    p.add_argument("--cost", action="store_true")
    p.add_argument("--project-pages", type=int, default=10_000_000)
    p = command("cost", _cost)
    p.add_argument("--cost-model")
    p.add_argument("--json", action="store_true")
    p.add_argument("--project-pages", type=int)
    p = command("dedup", _dedup)
    p.add_argument("--dir")
    p.add_argument("--images", nargs="*")
    p.add_argument("--method", default="exact", choices=("exact", "ahash"))
    p.add_argument("--scope", default="doc", choices=("doc", "global"))
    p.add_argument("--tile-bytes", type=int)
    p = command("route", lambda a, e: _print(e.route(a.query, a.model, a.weights).first().asDict()))
    p.add_argument("query")
    p.add_argument("--weights")
    p.add_argument("--model", choices=("heuristic", "learned"))
    p = command("train-router", _train_router)
    p.add_argument("--examples")
    p.add_argument("--out", default="router.json")
    p.add_argument("--iterations", type=int, default=4_000)
    p.add_argument("--lr", type=float, default=0.5)
    p = command("serve", _serve)
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=8000)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    config = EngineConfig.from_file(args.config) if args.config else None
    args.run(args, Engine(spark_session(), config, args.storage))


if __name__ == "__main__":
    main()
