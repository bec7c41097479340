"""A registry of pipelines and input files, in SQLite, with objects in a folder."""

from __future__ import annotations

import json
import os
import shutil
import sqlite3
import threading
from datetime import UTC, datetime

from millrace.plans.errors import ValidationError
from millrace.plans.validate import parse_and_validate

_SCHEMA = """
CREATE TABLE IF NOT EXISTS input_files (
  id INTEGER PRIMARY KEY AUTOINCREMENT, name TEXT NOT NULL, bucket TEXT NOT NULL, object_key TEXT NOT NULL, uri TEXT NOT NULL UNIQUE,
  format TEXT NOT NULL CHECK (format IN ('csv', 'parquet')), size_bytes INTEGER NOT NULL, metadata TEXT NOT NULL, created_at TEXT NOT NULL, updated_at TEXT NOT NULL,
  UNIQUE (bucket, object_key));
CREATE TABLE IF NOT EXISTS pipelines (
  id INTEGER PRIMARY KEY AUTOINCREMENT, pipeline_id TEXT NOT NULL UNIQUE, name TEXT NOT NULL, spec TEXT NOT NULL,
  status TEXT NOT NULL CHECK (status IN ('draft', 'active')), validation_error TEXT, activated_at TEXT, created_at TEXT NOT NULL, updated_at TEXT NOT NULL);
"""


class NotFound(LookupError):
    pass


class Conflict(ValueError):
    pass


def _now() -> str:
    return datetime.now(UTC).isoformat(timespec="microseconds")


def _page(limit: int | None, offset: int | None) -> tuple[int, int]:
    limit, offset = 50 if limit is None else limit, offset or 0
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    if offset < 0:
        raise ValueError("offset must be >= 0")
    return limit, offset


class Registry:
    def __init__(self, database: str = ":memory:", objects: str = "objects", bucket: str = "inputs"):
        self.objects, self.bucket = objects, bucket
        self.lock = threading.RLock()
        self.db = sqlite3.connect(database, check_same_thread=False)
        self.db.row_factory = sqlite3.Row
        self.db.executescript(_SCHEMA)

    def _one(self, table: str, key: int) -> dict:
        with self.lock:
            row = self.db.execute(f"SELECT * FROM {table} WHERE id = ?", (key,)).fetchone()
        if row is None:
            raise NotFound(f"{table[:-1].replace('_', ' ')} {key} not found")
        found = dict(row)
        for name in ("spec", "metadata"):
            if name in found:
                found[name] = json.loads(found[name])
        return found

    def _insert(self, table: str, what: str, **values) -> dict:
        values |= {"created_at": _now(), "updated_at": _now()}
        try:
            with self.lock, self.db:
                made = self.db.execute(f"INSERT INTO {table} ({', '.join(values)}) VALUES ({', '.join('?' * len(values))})", tuple(values.values()))
        except sqlite3.IntegrityError as e:
            if "CHECK" in str(e):
                raise ValueError("format must be csv or parquet") from e
            raise Conflict(f"{what} already exists") from e
        return self._one(table, made.lastrowid)

    def _update(self, table: str, key: int, **values) -> dict:
        self._one(table, key)
        values["updated_at"] = _now()
        try:
            with self.lock, self.db:
                self.db.execute(f"UPDATE {table} SET {', '.join(f'{k} = ?' for k in values)} WHERE id = ?", (*values.values(), key))
        except sqlite3.IntegrityError as e:
            raise Conflict(f"{table[:-1]} already exists") from e
        return self._one(table, key)

    def _list(self, table: str, limit: int | None, offset: int | None, equal: dict, name: str | None) -> list[dict]:
        limit, offset = _page(limit, offset)
        equal = {k: v for k, v in equal.items() if v}
        where = [f"{k} = ?" for k in equal] + (["name LIKE ?"] if name else [])
        sql = f"SELECT id FROM {table}" + (f" WHERE {' AND '.join(where)}" if where else "") + " ORDER BY id DESC LIMIT ? OFFSET ?"
        with self.lock:
            rows = self.db.execute(sql, (*equal.values(), *([f"%{name}%"] if name else []), limit, offset)).fetchall()
        return [self._one(table, r["id"]) for r in rows]

    def _delete(self, table: str, key: int) -> None:
        self._one(table, key)
        with self.lock, self.db:
            self.db.execute(f"DELETE FROM {table} WHERE id = ?", (key,))

    # Pipelines: drafts hold any JSON object; activation validates.

    @staticmethod
    def _identity(spec) -> str:
        if not isinstance(spec, dict):
            raise ValueError("spec must be a JSON object")
        name = str(spec.get("pipeline_id") or "").strip()
        if not name:
            raise ValueError("pipeline_id is required")
        return name

    def create_pipeline(self, spec: dict, name: str = "") -> dict:
        own = self._identity(spec)
        return self._insert("pipelines", f"pipeline {own}", pipeline_id=own, name=name.strip() or own, spec=json.dumps(spec), status="draft")

    def pipeline(self, key: int) -> dict:
        return self._one("pipelines", key)

    def pipelines(self, limit=None, offset=None, status=None, name=None) -> list[dict]:
        if status and status not in ("draft", "active"):
            raise ValueError("status must be draft or active")
        return self._list("pipelines", limit, offset, {"status": status}, name)

    def update_pipeline(self, key: int, spec: dict | None = None, name: str | None = None) -> dict:
        """A changed pipeline is a draft again."""
        values = {} if name is None else {"name": name.strip()}
        if spec is not None:
            values |= {"pipeline_id": self._identity(spec), "spec": json.dumps(spec)}
        return self._update("pipelines", key, **values, status="draft", validation_error=None, activated_at=None)

    def delete_pipeline(self, key: int) -> None:
        self._delete("pipelines", key)

    def activate(self, key: int) -> dict:
        """Validates and activates; a pipeline that isn't valid stays a draft and keeps the error."""
        found = self._one("pipelines", key)
        try:
            parse_and_validate(found["spec"])
        except ValidationError as e:
            self._update("pipelines", key, validation_error=str(e))
            raise
        return self._update("pipelines", key, status="active", activated_at=_now(), validation_error=None)

    # Input files: rows about objects.

    def _path(self, key: str) -> str:
        path = os.path.realpath(os.path.join(self.objects, self.bucket, key))
        if not path.startswith(os.path.realpath(os.path.join(self.objects, self.bucket)) + os.sep):
            raise ValueError("object_key is invalid")
        return path

    def _file(self, key: str, name: str, kind: str, metadata: dict | None) -> dict:
        if kind not in ("csv", "parquet"):
            raise ValueError("format must be csv or parquet")
        path = self._path(key)
        if not os.path.isfile(path):
            raise NotFound(f"object {key} not found")
        return self._insert("input_files", f"input file {key}", name=name.strip() or os.path.basename(key), bucket=self.bucket, object_key=key, uri=f"s3://{self.bucket}/{key}", format=kind, size_bytes=os.path.getsize(path), metadata=json.dumps(metadata or {}))

    def register_file(self, object_key: str, kind: str, name: str = "", metadata: dict | None = None) -> dict:
        if not (object_key or "").strip():
            raise ValueError("object_key is required")
        return self._file(object_key.strip(), name, kind, metadata)

    def upload_file(self, data, filename: str, kind: str, name: str = "", object_key: str = "", metadata: dict | None = None) -> dict:
        """data: a binary stream; it is copied in pieces."""
        key = object_key.strip() or os.path.basename(filename)
        if not key:
            raise ValueError("file is required")
        path = self._path(key)
        if os.path.exists(path):
            raise Conflict(f"object {key} already exists")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as out:
            shutil.copyfileobj(data, out)
        try:
            return self._file(key, name, kind, metadata)
        except Exception:
            os.remove(path)
            raise

    def file(self, key: int) -> dict:
        return self._one("input_files", key)

    def files(self, limit=None, offset=None, bucket=None, format=None, name=None) -> list[dict]:
        return self._list("input_files", limit, offset, {"bucket": bucket, "format": format}, name)

    def update_file(self, key: int, name: str | None = None, metadata: dict | None = None) -> dict:
        values = {} if name is None else {"name": name.strip()}
        return self._update("input_files", key, **values, **({} if metadata is None else {"metadata": json.dumps(metadata)}))

    def delete_file(self, key: int) -> None:
        """The row goes; the object stays."""
        self._delete("input_files", key)

    def object_path(self, key: int) -> str:
        return self._path(self._one("input_files", key)["object_key"])
