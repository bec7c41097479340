"""The registry over HTTP, by the standard library's server."""

from __future__ import annotations

import email.parser
import email.policy
import hashlib
import hmac
import io
import json
import re
import secrets
import time
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from millrace.plans.errors import ValidationError
from millrace.plans.validate import parse_and_validate
from millrace.registry import Conflict, NotFound, Registry

ORIGINS = ("http://localhost:5173", "http://localhost:3000")
SAFE = {"X-Content-Type-Options": "nosniff", "X-Frame-Options": "DENY", "Referrer-Policy": "no-referrer"}
LINK_SECONDS = 15 * 60
ROUTES: list[tuple[str, re.Pattern, str]] = []


def route(method: str, path: str):
    def keep(f):
        ROUTES.append((method, re.compile(re.sub(r":(\w+)", r"(?P<\1>[^/]+)", path) + "/?$"), f.__name__))
        f.path = path
        return f

    return keep


def _id(text: str) -> int:
    if not text.isdecimal() or int(text) < 1:
        raise ValueError("id must be a positive integer")
    return int(text)


def _number(query: dict, name: str) -> int | None:
    if name not in query:
        return None
    try:
        return int(query[name])
    except ValueError as e:
        raise ValueError(f"{name} must be an integer") from e


class Service:
    """What each route does: (query, body, parameters) to (status, JSON)."""

    def __init__(self, registry: Registry):
        self.registry, self.key = registry, secrets.token_bytes(32)

    @route("GET", "/healthz")
    def health(self, query, body):
        return 200, {"status": "ok"}

    @route("GET", "/pipelines")
    def pipelines(self, query, body):
        return 200, {"items": self.registry.pipelines(_number(query, "limit"), _number(query, "offset"), query.get("status"), query.get("name"))}

    @route("POST", "/pipelines/validate")
    def validate(self, query, body):
        try:
            spec = parse_and_validate(body.get("spec", body))
        except ValidationError as e:
            return 400, {"valid": False, "error": str(e), "issues": [i.as_dict() for i in e.issues]}
        return 200, {"valid": True, "pipeline_id": spec.pipeline_id, "version": spec.version, "nodes": len(spec.nodes), "sinks": len(spec.sinks)}

    @route("POST", "/pipelines")
    def create_pipeline(self, query, body):
        return 201, self.registry.create_pipeline(body.get("spec"), body.get("name") or "")

    @route("GET", "/pipelines/:id")
    def pipeline(self, query, body, id):
        return 200, self.registry.pipeline(_id(id))

    @route("PATCH", "/pipelines/:id")
    def update_pipeline(self, query, body, id):
        return 200, self.registry.update_pipeline(_id(id), body.get("spec"), body.get("name"))

    @route("DELETE", "/pipelines/:id")
    def delete_pipeline(self, query, body, id):
        self.registry.delete_pipeline(_id(id))
        return 204, None

    @route("POST", "/pipelines/:id/activate")
    def activate(self, query, body, id):
        try:
            return 200, self.registry.activate(_id(id))
        except ValidationError as e:
            return 400, {"error": str(e), "issues": [i.as_dict() for i in e.issues]}

    @route("POST", "/input-files/register")
    def register_file(self, query, body):
        return 201, self.registry.register_file(body.get("object_key") or "", body.get("format") or "", body.get("name") or "", body.get("metadata"))

    @route("POST", "/input-files/upload")
    def upload_file(self, query, body):
        if "file" not in body:
            raise ValueError("file is required")
        filename, data = body["file"]
        return 201, self.registry.upload_file(io.BytesIO(data), filename, body.get("format") or filename.rsplit(".", 1)[-1], body.get("name") or "", body.get("object_key") or "", json.loads(body.get("metadata") or "{}"))

    @route("GET", "/input-files")
    def files(self, query, body):
        return 200, {"items": self.registry.files(_number(query, "limit"), _number(query, "offset"), query.get("bucket"), query.get("format"), query.get("name"))}

    @route("GET", "/input-files/:id")
    def file(self, query, body, id):
        return 200, self.registry.file(_id(id))

    @route("PATCH", "/input-files/:id")
    def update_file(self, query, body, id):
        return 200, self.registry.update_file(_id(id), body.get("name"), body.get("metadata"))

    @route("DELETE", "/input-files/:id")
    def delete_file(self, query, body, id):
        self.registry.delete_file(_id(id))
        return 204, None

    def _sign(self, id: int, until: int) -> str:
        return hmac.new(self.key, f"{id}:{until}".encode(), hashlib.sha256).hexdigest()

    @route("GET", "/input-files/:id/download")
    def download(self, query, body, id):
        key, until = self.registry.file(_id(id))["id"], int(time.time()) + LINK_SECONDS
        return 200, {"url": f"/objects/{key}?until={until}&signature={self._sign(key, until)}", "expires_in": LINK_SECONDS}

    @route("GET", "/objects/:id")
    def object(self, query, body, id):
        until = _number(query, "until") or 0
        if until < time.time() or not hmac.compare_digest(query.get("signature", ""), self._sign(_id(id), until)):
            raise NotFound("link not found or no longer valid")
        with open(self.registry.object_path(_id(id)), "rb") as f:
            return 200, f.read()

    @route("GET", "/swagger/doc.json")
    def document(self, query, body):
        paths: dict = {}
        for method, _, name in ROUTES:
            path = re.sub(r":(\w+)", r"{\1}", getattr(Service, name).path)
            paths.setdefault(path, {})[method.lower()] = {"operationId": name, "responses": {"default": {"description": "JSON"}}}
        return 200, {"openapi": "3.0.3", "info": {"title": "millrace registry", "version": "1"}, "paths": paths}


def status_of(e: Exception) -> int:
    return 409 if isinstance(e, Conflict) else 404 if isinstance(e, NotFound) else 400 if isinstance(e, ValueError) else 500


def _body(kind: str, raw: bytes) -> dict:
    if kind.startswith("multipart/form-data"):
        message = email.parser.BytesParser(policy=email.policy.HTTP).parsebytes(b"Content-Type: " + kind.encode() + b"\r\n\r\n" + raw)
        out: dict = {}
        for part in message.iter_parts():
            name, filename = part.get_param("name", header="content-disposition"), part.get_filename()
            data = part.get_payload(decode=True)
            out[name] = (filename, data) if filename else data.decode()
        return out
    if not raw:
        return {}
    try:
        found = json.loads(raw)
    except ValueError as e:
        raise ValueError("request body is invalid JSON") from e
    if not isinstance(found, dict):
        raise ValueError("request body must be an object")
    return found


def handler(service: Service) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def _answer(self, status: int, value) -> None:
            data = b"" if value is None else value if isinstance(value, bytes) else json.dumps(value).encode()
            self.send_response(status)
            for k, v in {**SAFE, "X-Request-Id": self.headers.get("X-Request-Id") or uuid.uuid4().hex, "Content-Length": str(len(data)), "Content-Type": "application/octet-stream" if isinstance(value, bytes) else "application/json"}.items():
                self.send_header(k, v)
            if (origin := self.headers.get("Origin")) in ORIGINS:
                self.send_header("Access-Control-Allow-Origin", origin)
                self.send_header("Access-Control-Allow-Methods", "GET, POST, PATCH, DELETE, OPTIONS")
                self.send_header("Access-Control-Allow-Headers", "Content-Type, X-Request-Id")
            self.end_headers()
            self.wfile.write(data)

        def _serve(self) -> None:
            url = urlsplit(self.path)
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            for method, pattern, name in ROUTES:
                if method == self.command and (m := pattern.match(url.path)):
                    try:
                        query = {k: v[-1] for k, v in parse_qs(url.query).items()}
                        self._answer(*getattr(service, name)(query, _body(self.headers.get("Content-Type") or "", raw), **m.groupdict()))
                    except Exception as e:
                        self._answer(status_of(e), {"error": str(e)})
                    return
            self._answer(404, {"error": "not found"})

        do_GET = do_POST = do_PATCH = do_DELETE = _serve

        def do_OPTIONS(self) -> None:
            self._answer(204, None)

        def log_message(self, *args) -> None:
            pass

    return Handler


def server(registry: Registry, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    return ThreadingHTTPServer((host, port), handler(Service(registry)))
