"""Settings: a frozen value made from the environment, passed on explicitly."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from .functions.split import check_window


_LINE = re.compile(r"""\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_.]*)\s*=\s*(?:'([^']*)'|"((?:[^"\\]|\\.)*)"|([^\s#][^#]*?|))\s*(?:#.*)?$""")


def read_env(path: str) -> dict[str, str]:
    """``NAME=value`` lines of a file, empty if there is none: values may be quoted, ``#`` begins a comment, other lines are skipped."""
    if not os.path.isfile(path):
        return {}
    out = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            if m := _LINE.match(line.rstrip("\n")):
                name, single, double, bare = m.groups()
                out[name] = single if single is not None else re.sub(r"\\(.)", lambda c: {"n": "\n", "t": "\t"}.get(c[1], c[1]), double) if double is not None else bare or ""
    return out


@dataclass(frozen=True)
class Settings:
    provider: str = "hashing"
    provider_settings: dict = field(default_factory=dict)
    dimensions: int = 1536
    batch: int = 32
    max_chars: int = 2000
    overlap: int = 200
    index_path: str = "index"
    output_dir: str = "output"

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None, file: str = ".env") -> "Settings":
        """Settings of the environment, and of ``file`` where it has none."""
        e = read_env(file) | dict(os.environ) if env is None else env
        dims = int(e.get("EMBEDDING_DIMENSIONS", "1536"))
        names = {"api_key": "EMBEDDING_API_KEY", "endpoint": "EMBEDDING_ENDPOINT", "api_version": "EMBEDDING_API_VERSION", "deployment": "EMBEDDING_DEPLOYMENT", "model": "EMBEDDING_MODEL"}
        options = {k: e[v] for k, v in names.items() if v in e} | {"dimensions": dims}
        return cls(e.get("EMBEDDING_PROVIDER", "hashing"), options, dims, int(e.get("EMBED_BATCH_SIZE", "32")), int(e.get("CHUNK_MAX_CHARS", "2000")), int(e.get("CHUNK_OVERLAP_CHARS", "200")), e.get("INDEX_PATH", "index"), e.get("OUTPUT_DIR", "output"))

    def validate(self) -> None:
        """ValueError for sizes that can't work, or a provider without its credentials."""
        check_window(self.max_chars, self.overlap)
        need = {"openai": ["api_key", "model"], "azure": ["api_key", "endpoint", "deployment"]}.get(self.provider, [])
        if missing := [k for k in need if not self.provider_settings.get(k)]:
            raise ValueError(f"provider {self.provider} needs {', '.join(missing)}")
