"""The service on a socket, with the standard library's threading server."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .app import CHUNK_BYTES, Refused, Service


def server(service: Service, host: str = "127.0.0.1", port: int = 8787, behind_tls: bool = False) -> ThreadingHTTPServer:
    """Bound and ready for ``serve_forever``. A cleartext bind beyond this machine is refused unless TLS ends before it."""
    if host not in ("127.0.0.1", "localhost", "::1") and not behind_tls:
        raise ValueError("bind to loopback, or say that a TLS proxy stands before the service")

    class Handler(BaseHTTPRequestHandler):
        def _reply(self, status: int, body: dict) -> None:
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _handle(self) -> None:
            if self.command == "GET" and self.path.startswith("/exports/"):
                return self._download(self.path.split("/", 2)[2])
            length = int(self.headers.get("Content-Length") or 0)
            if length > max(service.config.max_body_bytes, CHUNK_BYTES):
                return self._reply(413, {"error": "the body is too large"})
            self._reply(*service.handle(self.command, self.path, {k.lower(): v for k, v in self.headers.items()}, self.rfile.read(length)))
            return None

        def _download(self, token: str) -> None:
            lines = service.download(token)
            try:
                first = next(lines, "")
            except Refused as e:
                return self._reply(e.status, {"error": str(e)})
            self.send_response(200)
            self.send_header("Content-Type", "text/plain; charset=utf-8")
            self.end_headers()
            self.wfile.write(first.encode())
            for line in lines:
                self.wfile.write(line.encode())
            return None

        do_GET = do_POST = do_PUT = _handle  # noqa: N815

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
