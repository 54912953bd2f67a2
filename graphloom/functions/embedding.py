"""Hashed text embeddings in plain Python, for Arrow batches and as the model the SQL form is tested against."""

from __future__ import annotations

import math
import re
from functools import lru_cache


def _hash(text: str) -> int:
    h = 2166136261
    for c in text:
        x = h ^ ord(c)
        if x >= 1 << 31:
            x -= 1 << 32
        h = int(float(x) * 16777619.0) % (1 << 32)
    return h


@lru_cache(maxsize=200_000)
def places(gram: str, dim: int) -> tuple[int, int]:
    return _hash(gram) % dim, _hash(gram + "_2") % dim


def embed_one(text: str, dim: int = 256) -> list[float]:
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", re.sub(r"[^a-z0-9_ \t\n\x0b\f\r]", " ", text.lower())) if len(w) > 1]
    v = [0.0] * dim
    for g in words + [f"{a}_{b}" for a, b in zip(words, words[1:], strict=False)]:
        p, q = places(g, dim)
        v[p] += 1.0
        v[q] += 0.5
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else v
