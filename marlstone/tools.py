"""The engine as tools: names, argument schemas, and one dispatcher that takes and returns plain data."""

from __future__ import annotations

from typing import Any

from .engine import Engine
from .plans.search import result_rows
from .sources.manifests import file_contents

_S, _I, _B = {"type": "string"}, {"type": "integer"}, {"type": "boolean"}
_ASK = {"query": _S, "top_k": _I, "modality": {"type": "string", "enum": ["text", "vision", "hybrid"]}, "rerank": _B, "fusion": {"type": "string", "enum": ["rrf", "calibrated"]}}
#: name: (what it does, arguments, required ones)
TOOLS: dict[str, tuple[str, dict, tuple[str, ...]]] = {
    "search": ("Find documents for a question.", _ASK, ("query",)),
    "answer": ("Answer a question with citations.", _ASK, ("query",)),
    "add_text": ("Index a text.", {"doc_id": _S, "text": _S, "title": _S}, ("doc_id", "text")),
    "add_html": ("Index a page.", {"doc_id": _S, "html": _S, "title": _S}, ("doc_id", "html")),
    "add_batch": ("Index many documents.", {"documents": {"type": "array", "items": {"type": "object"}}, "replace": _B}, ("documents",)),
    "delete": ("Remove a document.", {"doc_id": _S}, ("doc_id",)),
    "update_text": ("Replace a document's text.", {"doc_id": _S, "text": _S, "title": _S}, ("doc_id", "text")),
    "list_docs": ("Name all documents.", {}, ()),
    "stats": ("Count what is indexed.", {}, ()),
    "cost": ("Estimate storage and price.", {"pages": _I}, ()),
    "route": ("Weigh the modalities for a question.", {"query": _S, "model": _S}, ("query",)),
    "dedup": ("Find equal tiles among files.", {"images": {"type": "array", "items": _S}, "scope": _S, "method": _S}, ("images",)),
    "richness": ("Judge whether a page needs pixels.", {"text": _S, "html": _S}, ()),
}
CHANGES = {"add_text", "add_html", "add_batch", "delete", "update_text"}


def schemas() -> list[dict]:
    return [
        {"name": n, "description": what, "inputSchema": {"type": "object", "properties": args, "required": list(need)}} for n, (what, args, need) in TOOLS.items()
    ]


def _rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def call_tool(name: str, args: dict[str, Any] | None, engine: Engine) -> dict:
    """Run a tool. An unknown name is a KeyError, a missing or empty argument a ValueError; changes are saved."""
    _, known, need = TOOLS[name]
    args = dict(args or {})
    for a in need:
        if not args.get(a):
            raise ValueError(f"{name} needs {a}")
    if unknown := set(args) - set(known):
        raise ValueError(f"{name} takes no {', '.join(sorted(unknown))}")
    ask = dict(top_k=args.get("top_k"), modality=args.get("modality"), reranked=args.get("rerank"), method=args.get("fusion"))
    if name == "search":
        out = {"results": _rows(result_rows(engine.search(args["query"], **ask)).orderBy("pos"))}
    elif name == "answer":
        said, cited = engine.answer(args["query"], **ask)
        out = {"answer": said.first()["answer"], "citations": _rows(cited.orderBy("marker"))}
    elif name in ("add_text", "update_text"):
        out = {"chunks": engine.add_text(args["doc_id"], args["text"], args.get("title", ""), replace=name == "update_text")}
    elif name == "add_html":
        out = {"chunks": engine.add_html(args["doc_id"], args["html"], args.get("title", ""))}
    elif name == "add_batch":
        for d in args["documents"]:
            if not (d.get("doc_id") or d.get("id")) or not (d.get("text") or d.get("html")):
                raise ValueError("each document needs a doc_id and a text or html")
        out = engine.add_documents(args["documents"], bool(args.get("replace")))
    elif name == "delete":
        out = engine.delete([args["doc_id"]])
    elif name == "list_docs":
        ids = engine.doc_ids()
        out = {"doc_ids": ids, "count": len(ids)}
    elif name == "stats":
        out = engine.stats()
    elif name == "cost":
        out = {"modes": _rows(engine.cost(args.get("pages")))}
    elif name == "route":
        row = engine.route(args["query"], args.get("model")).first().asDict()
        out = {k: round(v, 4) if isinstance(v, float) else v for k, v in row.items() if k != "query_id"}
    elif name == "dedup":
        paths = engine.spark.createDataFrame(list(enumerate(args["images"])), "seq long, image_path string")
        out = engine.dedup_stats(paths.join(file_contents(engine.spark, args["images"]), "image_path", "left"), args.get("scope", "doc"), args.get("method"))
    else:
        out = engine.richness(args.get("text"), args.get("html"))
    if name in CHANGES:
        engine.save()
    return out
