"""A small HTTP front of ``serve``: JSON over the standard library's server.

GET /cases/{id}, /cases/{id}/links?scope=&limit=, /clusters/{id}; POST /feedback, /pii-requests.
The caller's name comes in the header X-Actor.  Every call leaves a row in the audit table.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession

from fslink import serve


@dataclass(frozen=True)
class Tables:
    """What the service reads, and the folders it appends to."""

    cases: DataFrame
    links: DataFrame
    clusters: DataFrame
    pii: DataFrame
    feedback: str
    audit: str


def _rows(df: DataFrame) -> list[dict]:
    return [json.loads(r) for r in df.toJSON().collect()]


def answer(spark: SparkSession, tables: Tables, method: str, target: str, body: dict | None = None, actor: str = "anonymous") -> tuple[int, object]:
    """(status, reply) of one call; a reply is small: one case, its links (at most 50) or its cluster."""
    parts = urlsplit(target)
    path, asked = [unquote(p) for p in parts.path.strip("/").split("/")], {k: v[-1] for k, v in parse_qs(parts.query).items()}
    body = body or {}
    if method == "POST" and path == ["pii-requests"]:
        status, found = serve.request_pii(spark, tables.pii, tables.audit, actor, body.get("pii_ref"), body.get("reason"))
        return (status, _rows(found)) if found is not None else (status, {"error": "a reason is required"})
    serve.audit(spark, tables.audit, actor, f"{method} /{path[0]}", target)
    if method == "POST" and path == ["feedback"]:
        return serve.post_feedback(spark, tables.feedback, actor, body)
    if method == "GET" and len(path) == 2 and path[0] == "cases":
        status, found = serve.get_case(tables.cases, path[1])
        return (status, _rows(found)[0]) if found is not None else (status, {"error": "no such case"})
    if method == "GET" and len(path) == 3 and (path[0], path[2]) == ("cases", "links"):
        limit = asked.get("limit", "10")
        if not limit.isdecimal():
            return 400, {"error": "limit must be a number"}
        scope = asked.get("scope", "same")
        status, found = serve.get_links(tables.cases, tables.links, path[1], scope, int(limit))
        return (status, {"case_id": path[1], "scope": scope, "links": _rows(found)}) if found is not None else (status, {"error": "no such case" if status == 404 else "scope or limit is wrong"})
    if method == "GET" and len(path) == 2 and path[0] == "clusters":
        found = _rows(serve.clusters_of(tables.clusters, path[1]))
        return (200, found[0]) if found else (404, {"error": "in no cluster"})
    return 404, {"error": "no such resource"}


def server(spark: SparkSession, tables: Tables, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server that is bound and not yet running: call ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self, method: str) -> None:
            try:
                raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                body = json.loads(raw) if raw else {}
                if not isinstance(body, dict):
                    raise ValueError("an object is expected")
            except ValueError as e:
                status, reply = 400, {"error": str(e)}
            else:
                status, reply = answer(spark, tables, method, self.path, body, self.headers.get("X-Actor", "anonymous"))
            data = json.dumps(reply).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self._reply("GET")

        def do_POST(self) -> None:
            self._reply("POST")

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
