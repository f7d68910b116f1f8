"""Settings from the environment, and the URLs among them."""

from __future__ import annotations

import os
from pathlib import Path
from urllib.parse import urlparse

from reportlake.operators.ocr import OcrConfig


def load_env_file(path: str | os.PathLike) -> bool:
    """Set what a file of ``NAME=value`` lines names, without overriding what is set."""
    file = Path(path)
    if not file.is_file():
        return False
    for line in file.read_text(encoding="utf-8").splitlines():
        name, eq, value = line.strip().partition("=")
        if eq and name and not name.startswith("#"):
            os.environ.setdefault(name.strip(), value.strip().strip("'\""))
    return True


def required(name: str) -> str:
    value = os.environ.get(name, "").strip()
    if not value:
        raise RuntimeError(f"required environment variable {name} is not set")
    return value


def service_url(value: str) -> str:
    """An absolute HTTP(S) URL that is no placeholder, without slashes at the end."""
    value = value.rstrip("/")
    parsed = urlparse(value)
    host = (parsed.hostname or "").casefold()
    if parsed.scheme not in ("http", "https") or not host:
        raise RuntimeError("must be an absolute HTTP(S) URL")
    if host == "example.com" or host.endswith(".example.com"):
        raise RuntimeError(f"still contains the example placeholder {host}")
    return value


def ocr_config(prefix: str = "REPORTLAKE_OCR_") -> OcrConfig | None:
    """The OCR settings, or nothing where neither URL nor model is set."""
    get = lambda name, default: os.environ.get(prefix + name, default)
    if not get("BASE_URL", "").strip() and not get("MODEL", "").strip():
        return None
    return OcrConfig(
        base_url=service_url(required(prefix + "BASE_URL")),
        model=required(prefix + "MODEL"),
        api_key=get("API_KEY", ""),
        timeout_seconds=float(get("TIMEOUT_SECONDS", "180")),
        max_pages=int(get("MAX_PAGES", "500")),
        batch_pages=int(get("BATCH_PAGES", "20")),
        max_parallel_pages=int(get("MAX_PARALLEL_PAGES", "8")),
        render_dpi=int(get("RENDER_DPI", "144")),
        cache_version=get("CACHE_VERSION", "v1"),
    )


def valid_url(url: str) -> str:
    """SQL: whether ``service_url`` would accept the value."""
    host = f"lower(try_parse_url({url}, 'HOST'))"
    return f"coalesce({url} rlike '^https?://' and {host} <> 'example.com' and {host} not like '%.example.com', false)"
