"""Tool server: JSON-RPC over standard input and output, or over HTTP at /mcp."""

from __future__ import annotations

import json
import sys
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import TextIO

from semdex import __version__
from semdex.service import Internal, InvalidParams, Service

DEFAULT_BIND = "127.0.0.1:7920"
PROTOCOL = "2025-03-26"
STRING, NUMBER = {"type": "string"}, {"type": "number"}
TOOLS = [
    {
        "name": "search",
        "description": "Search an index by meaning.",
        "inputSchema": {
            "type": "object",
            "required": ["query"],
            "properties": {"query": STRING, "index": STRING, "limit": {"type": "integer"}, "rerank": {"type": "boolean"}, "path_contains": STRING, "after": STRING, "before": STRING, "min_similarity": NUMBER},
        },
    },
    {"name": "stats", "description": "Statistics of an index.", "inputSchema": {"type": "object", "properties": {"index": STRING}}},
    {"name": "list_indexes", "description": "Registered indexes.", "inputSchema": {"type": "object", "properties": {}}},
]


def answer(service: Service, message: dict) -> dict | None:
    """The reply to one message; none to a notification."""
    if "id" not in message:
        return None
    reply: dict = {"jsonrpc": "2.0", "id": message["id"]}
    method, params = message.get("method"), message.get("params") or {}
    try:
        if method == "initialize":
            reply["result"] = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "semdex", "version": __version__}, "instructions": service.instructions}
        elif method == "ping":
            reply["result"] = {}
        elif method == "tools/list":
            reply["result"] = {"tools": TOOLS}
        elif method == "tools/call":
            name = params.get("name")
            if name not in {t["name"] for t in TOOLS}:
                raise InvalidParams(f"unknown tool '{name}'")
            try:
                value = getattr(service, name)(**(params.get("arguments") or {}))
            except TypeError as e:
                raise InvalidParams(str(e)) from None
            reply["result"] = {"content": [{"type": "text", "text": json.dumps(value, ensure_ascii=False)}]}
        else:
            reply["error"] = {"code": -32601, "message": f"unknown method '{method}'"}
    except InvalidParams as e:
        reply["error"] = {"code": -32602, "message": str(e)}
    except Internal as e:
        reply["error"] = {"code": -32603, "message": str(e)}
    return reply


def serve_stdio(service: Service, source: TextIO = sys.stdin, sink: TextIO = sys.stdout) -> None:
    for line in source:
        if line.strip():
            try:
                reply = answer(service, json.loads(line))
            except ValueError as e:
                reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
            if reply is not None:
                print(json.dumps(reply, ensure_ascii=False), file=sink, flush=True)


def http_server(service: Service, bind: str = DEFAULT_BIND) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:
            if self.path != "/mcp":
                self.send_error(404)
                return
            try:
                reply = answer(service, json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0)))))
            except ValueError as e:
                reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
            body = b"" if reply is None else json.dumps(reply, ensure_ascii=False).encode()
            self.send_response(202 if reply is None else 200)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args) -> None:
            pass

    host, _, port = bind.rpartition(":")
    return ThreadingHTTPServer((host, int(port)), Handler)
