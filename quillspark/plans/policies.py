"""Sealed cursors: where a listing stopped, for the request that goes on with it."""

from __future__ import annotations

import hashlib
import hmac
import json
from dataclasses import dataclass


@dataclass(frozen=True)
class Cursor:
    """Where a listing stopped, and what it was a listing of."""

    query: str
    generation: int
    principal: str
    score: float
    chunk_id: int
    expires: float


def seal(cursor: Cursor, key: bytes) -> str:
    body = json.dumps(cursor.__dict__, sort_keys=True)
    return hmac.new(key, body.encode(), hashlib.sha256).hexdigest() + "." + body


def open_cursor(sealed: str, key: bytes, query: str, generation: int, principal: str, now: float) -> Cursor:
    """The cursor, if it is genuine, not expired and of the same query, generation and principal."""
    mark, _, body = sealed.partition(".")
    if not hmac.compare_digest(mark, hmac.new(key, body.encode(), hashlib.sha256).hexdigest()):
        raise ValueError("forged cursor")
    cursor = Cursor(**json.loads(body))
    if now > cursor.expires:
        raise ValueError("expired cursor")
    if (cursor.query, cursor.generation, cursor.principal) != (query, generation, principal):
        raise ValueError("cursor of another listing")
    return cursor
