"""Vector helpers that run inside Arrow batches (numpy)."""

from __future__ import annotations

import re
import zlib

import numpy as np

_TOKEN = re.compile(r"[A-Za-z_][A-Za-z0-9_]*|\d+|[^\sA-Za-z0-9_]")
_CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


def tokens(text: str) -> list[str]:
    """Identifier-aware tokens: whole identifiers plus their snake/camel parts."""
    out: list[str] = []
    for tok in _TOKEN.findall(text or ""):
        low = tok.lower()
        out.append(low)
        if len(tok) > 1 and (tok[0].isalpha() or tok[0] == "_"):
            parts = [p.lower() for piece in tok.split("_") for p in _CAMEL.findall(piece)]
            if len(parts) > 1:
                out.extend(parts)
    return out


def hash_embed(texts, dim: int = 256) -> np.ndarray:
    """Deterministic signed feature hashing + L2 norm (one row per text).

    Stands in for a pretrained sentence model, which is not available here;
    any embedder with the same batch signature can be plugged in instead.
    """
    out = np.zeros((len(texts), dim), dtype=np.float32)
    for i, t in enumerate(texts):
        for tok in tokens(t):
            h = zlib.crc32(tok.encode("utf-8"))
            out[i, h % dim] += 1.0 if (h >> 31) & 1 == 0 else -1.0
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    np.divide(out, norms, out=out, where=norms > 0)
    return out


def topk_cosine(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int):
    """Exact cosine-distance top-k of every row of ``q`` against ``c``.

    Returns (query_idx, corpus_idx, distance) arrays holding at most k rows per
    query, ordered by (distance asc, corpus id asc); zero vectors give NaN
    distance and sort last.  Work is one matrix product per block.
    """
    q = q.astype(np.float64, copy=False)
    c = c.astype(np.float64, copy=False)
    qn = np.linalg.norm(q, axis=1)
    cn = np.linalg.norm(c, axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        sim = (q @ c.T) / np.outer(qn, cn)
    dist = 1.0 - sim
    dist[~np.isfinite(dist)] = np.nan
    key = np.where(np.isnan(dist), np.inf, dist)
    m, n = key.shape
    kk = min(k, n)
    qi, ci, dd = [], [], []
    if kk == 0:
        return np.array([], dtype=np.int64), np.array([], dtype=np.int64), np.array([])
    # candidates: everything not worse than the k-th smallest key (keeps ties)
    part = np.partition(key, kk - 1, axis=1)[:, kk - 1:kk]
    for r in range(m):
        cand = np.nonzero(key[r] <= part[r, 0])[0]
        order = np.lexsort((c_ids[cand], key[r, cand]))[:kk]
        sel = cand[order]
        qi.append(np.full(len(sel), r, dtype=np.int64))
        ci.append(sel)
        dd.append(dist[r, sel])
    return np.concatenate(qi), np.concatenate(ci), np.concatenate(dd)
