"""Tool server: JSON-RPC over standard input and output, with tools to search and to list indexes."""

from __future__ import annotations

import contextlib
import io
import json
import sys
from typing import Any

from vectrine import __version__, cli

TOOLS = [
    {"name": "search", "description": "Find passages of an index that are close to a text.", "inputSchema": {"type": "object", "properties": {"index": {"type": "string"}, "text": {"type": "string"}, "top_k": {"type": "integer", "default": 5}, "complexity": {"type": "integer", "default": 64}}, "required": ["index", "text"]}},
    {"name": "list", "description": "Name the indexes there are.", "inputSchema": {"type": "object", "properties": {}}},
]


def call(name: str, given: dict[str, Any]) -> str:
    arguments = {
        "list": lambda: ["list"],
        "search": lambda: [
            "search", given["index"], given["text"], "--top-k", str(given.get("top_k", 5)), "--complexity", str(given.get("complexity", 64))
        ]
    }
    if name not in arguments:
        raise ValueError(f"unknown tool {name!r}")
    with contextlib.redirect_stdout(io.StringIO()) as out:
        cli.main(arguments[name]())
    return out.getvalue()


def answer(request: dict[str, Any]) -> dict[str, Any] | None:
    """The response to a request; None to a notification."""
    if "id" not in request:
        return None
    head = {"jsonrpc": "2.0", "id": request["id"]}
    given = request.get("params") or {}
    match request.get("method"):
        case "initialize":
            return head | {
                "result": {
                    "protocolVersion": "2024-11-05",
                    "capabilities": {"tools": {}},
                    "serverInfo": {"name": "vectrine", "version": __version__}
                }
            }
        case "tools/list":
            return head | {"result": {"tools": TOOLS}}
        case "tools/call":
            try:
                return head | {"result": {"content": [{"type": "text", "text": call(given.get("name", ""), given.get("arguments") or {})}]}}
            except (Exception, SystemExit) as error:
                return head | {"result": {"content": [{"type": "text", "text": str(error)}], "isError": True}}
        case other:
            return head | {"error": {"code": -32601, "message": f"unknown method {other!r}"}}


def main() -> None:
    for text in sys.stdin:
        if text.strip() and (out := answer(json.loads(text))) is not None:
            print(json.dumps(out), flush=True)


if __name__ == "__main__":
    main()
