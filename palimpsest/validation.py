"""Checks made on the driver before any job runs."""

from __future__ import annotations

import json
import math
from typing import Any

import numpy as np

from .errors import StoreError


def scope(tenant: Any, namespace: Any, agent: Any = None, user: Any = None) -> tuple[str, str, str | None, str | None]:
    out = []
    for name, value in (("tenant_id", tenant), ("namespace", namespace)):
        if not isinstance(value, str) or not value.strip():
            raise StoreError("INVALID_SCOPE", f"{name} must not be empty")
        out.append(value.strip())
    for name, value in (("agent_id", agent), ("user_id", user)):
        if value is not None and (not isinstance(value, str) or not value.strip()):
            raise StoreError("INVALID_SCOPE", f"{name} must not be empty if given")
        out.append(value)
    return tuple(out)


def vector(value: Any, dims: int | None = None) -> list[float]:
    """A list of numbers or a contiguous one-dimensional float32 array, finite, of ``dims`` elements."""
    if isinstance(value, np.ndarray):
        if value.dtype != np.float32 or value.ndim != 1:
            raise TypeError("an array must be one-dimensional float32")
        if not value.flags["C_CONTIGUOUS"]:
            raise ValueError("an array must be contiguous")
        value = value.tolist()
    if not isinstance(value, (list, tuple)):
        raise TypeError("a vector is a list of numbers or a float32 array")
    out = [float(x) for x in value]
    if dims is not None and len(out) != dims:
        raise StoreError("DIMENSION_MISMATCH", f"Dimension mismatch: expected {dims}, got {len(out)}")
    if not all(map(math.isfinite, out)):
        raise StoreError("INVALID_INPUT", "a vector must be finite")
    return out


def content(value: Any) -> str:
    if not isinstance(value, str) or not value.strip():
        raise StoreError("INVALID_INPUT", "content must not be blank")
    return value


def importance(value: Any) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not 0 <= value <= 1:
        raise StoreError("INVALID_INPUT", "importance must be within 0 and 1")
    return float(value)


def limit(value: Any) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
        raise StoreError("INVALID_INPUT", "limit must be greater than 0")
    return value


def mmr_lambda(value: Any) -> float | None:
    if value is not None and not 0 <= value <= 1:
        raise StoreError("INVALID_INPUT", "mmr_lambda must be within 0 and 1")
    return value


def identifier(value: Any) -> str:
    if not isinstance(value, str) or not value.strip():
        raise StoreError("INVALID_INPUT", "id must not be blank")
    return value.strip()


def metadata(value: dict | None) -> str:
    """The JSON text of scalar metadata."""
    value = value or {}
    for k, v in value.items():
        if not isinstance(k, str) or not isinstance(v, (bool, int, float, str)):
            raise StoreError("INVALID_FILTER", f"metadata {k!r} must be a bool, number or string")
    return json.dumps(value, ensure_ascii=False)


def config(dims: Any, model: Any, max_recall_limit: Any) -> None:
    if isinstance(dims, bool) or not isinstance(dims, int) or dims <= 0:
        raise StoreError("INVALID_INPUT", "dimensions must be greater than 0")
    if not isinstance(model, str) or not model.strip():
        raise StoreError("INVALID_INPUT", "embedding_model must not be blank")
    limit(max_recall_limit)
