"""Tables as JSON over HTTP: routes to queries, and what becomes of their errors.

A route is a function from its parameters to a DataFrame (its rows are the answer, so it should be small) or to a plain value.
An unknown route, or a KeyError, is 404; NotReady is 503; any other error 500.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qsl, unquote, urlsplit

from pyspark.sql import DataFrame


class NotReady(RuntimeError):
    """What is asked for is not there yet."""


class Api:
    """route("/workers/{worker_id}")(function); get("/workers/17?limit=5") -> (status, JSON text)."""

    def __init__(self) -> None:
        self.routes: list[tuple[re.Pattern, Callable[..., Any]]] = []

    def route(self, path: str) -> Callable:
        pattern = re.compile("/".join(f"(?P<{p[1:-1]}>[^/]+)" if p.startswith("{") else re.escape(p) for p in path.split("/")))

        def add(f: Callable) -> Callable:
            self.routes.append((pattern, f))
            return f

        return add

    def get(self, url: str) -> tuple[int, str]:
        parts = urlsplit(url)
        for pattern, f in self.routes:
            m = pattern.fullmatch(parts.path.rstrip("/") or "/")
            if m:
                try:
                    value = f(**{k: unquote(v) for k, v in m.groupdict().items()}, **dict(parse_qsl(parts.query)))
                    if isinstance(value, DataFrame):
                        value = [r.asDict(recursive=True) for r in value.collect()]
                    return 200, json.dumps(value, default=str)
                except KeyError as e:
                    return 404, json.dumps({"error": f"not found: {e.args[0] if e.args else ''}"})
                except NotReady as e:
                    return 503, json.dumps({"error": str(e)})
                except Exception as e:  # noqa: BLE001  a server goes on
                    return 500, json.dumps({"error": f"{type(e).__name__}: {e}"})
        return 404, json.dumps({"error": f"no such path: {parts.path}"})

    def server(self, port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
        """A server for GET requests; serve_forever() runs it."""
        api = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self) -> None:
                status, text = api.get(self.path)
                body = text.encode()
                self.send_response(status)
                self.send_header("Content-Type", "application/json")
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *_: Any) -> None:
                pass

        return ThreadingHTTPServer((host, port), Handler)
