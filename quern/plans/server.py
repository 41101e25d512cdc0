"""A small HTTP front: health, collections, query (with limit and offset), import and batch.

One request at a time, as the session has one state; for many users Spark
Connect or the Thrift server are the better front.
"""

from __future__ import annotations

import json
from dataclasses import asdict
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlsplit

from quern.operators.relational import cut

from .batch import run_batch
from .session import Session


def health(session: Session) -> dict:
    return {"status": "ok", "db": session.database, "collections": len(session.state().collections) + len(session.tables)}


def collections(session: Session) -> dict:
    return {"ok": True, "collections": [{"name": n, "count": c.rows, "next_id": c.next_id} for n, c in session.state().collections.items()]}


def answer(session: Session, method: str, target: str, body: str) -> tuple[int, str]:
    """Status and JSON for one request."""
    url = urlsplit(target)
    if method == "GET" and url.path in ("/", "/health"):
        return 200, json.dumps(health(session))
    if method == "GET" and url.path == "/collections":
        return 200, json.dumps(collections(session))
    if method == "POST" and url.path == "/query":
        result, page = session.execute(body), parse_qs(url.query)
        if result.df is not None and ("limit" in page or "offset" in page):
            numbers = [page.get(k, [v])[0] for k, v in (("limit", ""), ("offset", "0"))]
            if not all(x.isdigit() for x in numbers if x):
                return 400, json.dumps({"ok": False, "err_code": "SYNTAX", "err_msg": "limit and offset are whole numbers"})
            result.df = cut(result.df, int(numbers[0]) if numbers[0] else None, int(numbers[1] or 0))
        return 200, result.json()
    if method == "POST" and url.path == "/import":
        name = parse_qs(url.query).get("coll", [""])[0]
        if not name:
            return 400, json.dumps({"ok": False, "err_code": "SYNTAX", "err_msg": "coll is missing"})
        return 200, json.dumps({"ok": True, **asdict(session.load(name, text=body))})
    if method == "POST" and url.path == "/batch":
        done = run_batch(session, body)
        return 200, json.dumps({k: v for k, v in vars(done).items() if k != "results"} | {"total": done.total})
    return 404, json.dumps({"ok": False, "err_code": "NOT_FOUND", "err_msg": url.path})


def serve(session: Session, port: int = 8080) -> None:
    class Handler(BaseHTTPRequestHandler):
        def _do(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            status, text = answer(session, self.command, self.path, self.rfile.read(size).decode())
            data = text.encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _do

    HTTPServer(("127.0.0.1", port), Handler).serve_forever()
