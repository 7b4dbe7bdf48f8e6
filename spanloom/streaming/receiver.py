"""A thin HTTP landing shim: POST /v1/traces writes span lines into the folder that the stream reads."""

from __future__ import annotations

import gzip
import json
import os
import uuid
import zlib
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

from ..sources.spans import SpanError, normalize, spread

MAX_BYTES = 4 << 20


class Refused(Exception):
    def __init__(self, status: int, said: str):
        super().__init__(said)
        self.status = status


def body_of(raw: bytes, encoding: str | None, most: int = MAX_BYTES) -> bytes:
    if len(raw) > most:
        raise Refused(413, f"body exceeds {most} bytes")
    if not encoding or encoding == "identity":
        return raw
    if encoding not in ("gzip", "deflate"):
        raise Refused(415, f"content-encoding {encoding} is not supported")
    try:
        unpacker = zlib.decompressobj(31 if encoding == "gzip" else 15)
        out = unpacker.decompress(raw, most + 1)
    except (zlib.error, gzip.BadGzipFile) as e:
        raise Refused(400, f"body is not valid {encoding}: {e}") from e
    if len(out) > most:
        raise Refused(413, f"body exceeds {most} bytes")
    return out


def accept(raw: bytes, headers: dict[str, str], token: str | None = None) -> tuple[list[dict], int]:
    """(spans, rejected) of one request, or the refusal."""
    if token and headers.get("authorization") != f"Bearer {token}":
        raise Refused(401, "a bearer token is needed")
    if headers.get("content-type", "").split(";")[0].strip() != "application/json":
        raise Refused(415, "only application/json is accepted")
    try:
        found = json.loads(body_of(raw, headers.get("content-encoding")))
        spans = list(spread(found))
    except (ValueError, SpanError) as e:
        raise Refused(400, f"body is not a span export: {e}") from e
    good, rejected = [], 0
    for span in spans:
        try:
            normalize(span)
            good.append(span)
        except SpanError:
            rejected += 1
    return good, rejected


def land(folder: str, spans: list[dict]) -> None:
    """One file a request; the rename makes it appear whole."""
    if spans:
        name = uuid.uuid4().hex
        Path(folder, f".{name}").write_text("".join(json.dumps(s, ensure_ascii=False, separators=(",", ":")) + "\n" for s in spans))
        os.replace(Path(folder, f".{name}"), Path(folder, f"{name}.jsonl"))


def serve(folder: str, port: int = 4318, token: str | None = None) -> ThreadingHTTPServer:
    """A server on the loopback interface; the caller runs ``serve_forever``."""
    Path(folder).mkdir(parents=True, exist_ok=True)

    class Handler(BaseHTTPRequestHandler):
        def answer(self, status: int, body: dict) -> None:
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("content-type", "application/json")
            self.send_header("content-length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_POST(self) -> None:  # noqa: N802
            if self.path.split("?")[0] != "/v1/traces":
                self.answer(404, {"error": "only /v1/traces is served"})
                return
            size = int(self.headers.get("content-length") or 0)
            try:
                if size > MAX_BYTES:
                    raise Refused(413, f"body exceeds {MAX_BYTES} bytes")
                spans, rejected = accept(self.rfile.read(size), {k.lower(): v for k, v in self.headers.items()}, token)
            except Refused as e:
                self.answer(e.status, {"error": str(e)})
                return
            land(folder, spans)
            self.answer(200, {"partialSuccess": {"rejectedSpans": str(rejected), "errorMessage": "spans without a trace id"}} if rejected else {})

        def do_GET(self) -> None:  # noqa: N802
            if self.path == "/health":
                self.answer(200, {"ok": True})
            else:
                self.answer(405 if self.path == "/v1/traces" else 404, {"error": "POST /v1/traces"})

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
