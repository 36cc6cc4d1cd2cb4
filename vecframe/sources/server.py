"""A JSON interface over HTTP: collections, rows, searches and snapshots.

Paths: /healthz, /collections[/name[/upsert, upsert_batch, upsert_hybrid, search, search_hybrid, delete, count,
snapshots[/restore or /snapshot]]]. Answers carry an open CORS header; bad requests get 400, unknown names 404, taken
names 409. One request is handled at a time, which makes the server the collections' only writer.
"""

from __future__ import annotations

import argparse
import json
from http.server import BaseHTTPRequestHandler, HTTPServer
from typing import Any

from pyspark.sql import SparkSession

from .. import errors
from .store import Client

LARGEST = 64 << 20


def respond(client: Client, method: str, path: str, body: dict) -> tuple[int, dict]:
    """The status and answer of one request."""
    parts = [p for p in path.split("?")[0].split("/") if p]
    try:
        return _route(client, method, parts, body)
    except KeyError as e:
        if isinstance(e, (errors.CollectionNotFound, errors.SnapshotNotFound)):
            return 404, {"error": f"{e.args[0]} isn't there"}
        if isinstance(e, (errors.CollectionExists, errors.SnapshotExists, errors.DuplicateId)):
            return 409, {"error": f"{e.args[0]} exists"}
        return 400, {"error": f"{e.args[0]} is missing"}
    except (ValueError, TypeError) as e:
        return 400, {"error": str(e)}


def _route(client: Client, method: str, parts: list[str], body: dict) -> tuple[int, dict]:
    match method, parts:
        case "GET", ["healthz"]:
            return 200, {"status": "ok"}
        case "GET", ["collections"]:
            return 200, {"collections": client.list_collections()}
        case "POST", ["collections"]:
            options = {k: body[k] for k in ("metric", "index_type") if k in body}
            client.create_collection(body["name"], int(body["dimensions"]), **options)
            return 201, {"created": body["name"]}
        case "DELETE", ["collections", name]:
            if not client.delete_collection(name):
                raise errors.CollectionNotFound(name)
            return 200, {"deleted": True}
    if len(parts) < 3 or parts[0] != "collections":
        return 404, {"error": "no such path"}
    c = client.get_collection(parts[1])
    match method, parts[2:]:
        case "GET", ["count"]:
            return 200, {"count": c.count}
        case "POST", ["upsert"]:
            c.upsert(int(body["id"]), body["vector"], body.get("payload"))
            return 200, {"upserted": body["id"]}
        case "POST", ["upsert_batch"]:
            c.upsert_batch([(int(e["id"]), e["vector"], e.get("payload")) for e in body["entries"]])
            return 200, {"upserted": len(body["entries"])}
        case "POST", ["upsert_hybrid"]:
            c.upsert_hybrid(int(body["id"]), body["vector"], _numbers(body.get("sparse_vector")), body.get("payload"))
            return 200, {"upserted": body["id"]}
        case "POST", ["search"]:
            return 200, {"results": c.search(body["query"], int(body.get("k", 10)), body.get("filter"))}
        case "POST", ["search_hybrid"]:
            weights = {k: float(body[k]) for k in ("dense_weight", "sparse_weight") if k in body}
            return 200, {"results": c.search_hybrid(body["dense_query"], _numbers(body["sparse_query"]) or {}, int(body.get("k", 10)), filter=body.get("filter"), **weights)}
        case "POST", ["delete"]:
            return 200, {"deleted": c.delete(int(body["id"]))}
        case "GET", ["snapshots"]:
            return 200, {"snapshots": c.list_snapshots()}
        case "POST", ["snapshots"]:
            return 201, c.create_snapshot(body["name"])
        case "POST", ["snapshots", "restore"]:
            c.restore_snapshot(body["name"])
            return 200, {"restored": body["name"]}
        case "DELETE", ["snapshots", name]:
            c.delete_snapshot(name)
            return 200, {"deleted": True}
    return 404, {"error": "no such path"}


def _numbers(sparse: dict | None) -> dict | None:
    return None if sparse is None else {int(k): float(v) for k, v in sparse.items()}


def create_server(spark: SparkSession, path: str, host: str = "127.0.0.1", port: int = 8080) -> HTTPServer:
    client = Client(spark, path)

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, status: int, data: Any) -> None:
            body = json.dumps(data).encode() if data is not None else b""
            self.send_response(status)
            for k, v in (("Content-Type", "application/json"), ("Content-Length", str(len(body))), ("Access-Control-Allow-Origin", "*"), ("Access-Control-Allow-Methods", "GET, POST, DELETE, OPTIONS"), ("Access-Control-Allow-Headers", "Content-Type")):
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(body)

        def _handle(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            try:
                if size > LARGEST:
                    raise ValueError("the request is too large")
                body = json.loads(self.rfile.read(size)) if size else {}
                if not isinstance(body, dict):
                    raise ValueError("an object is expected")
            except ValueError as e:
                return self._answer(400, {"error": str(e)})
            return self._answer(*respond(client, self.command, self.path, body))

        do_GET = do_POST = do_DELETE = _handle

        def do_OPTIONS(self) -> None:
            self._answer(204, None)

        def log_message(self, *args: Any) -> None:
            pass

    return HTTPServer((host, port), Handler)


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=8080)
    p.add_argument("--data", default="./data")
    a = p.parse_args()
    create_server(SparkSession.builder.getOrCreate(), a.data, a.host, a.port).serve_forever()


if __name__ == "__main__":
    main()
