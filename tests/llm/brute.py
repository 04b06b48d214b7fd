"""Plain versions of the corpus operators, for comparison on small tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets(text: str | None) -> tuple[int, int, int, str]:
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    said = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return *(sum(k == n for _, k, _ in spans) for n in range(3)), hashlib.sha256(said.encode()).hexdigest()


def tail(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) / 2


def tested(found: str) -> tuple[int, float, float]:
    """Length class, p-value of randomness, p-value of written text of a candidate string."""
    core = found.replace("-", "+").replace("_", "/").rstrip("=")
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", core):
        kind, letters, core = 0, "0123456789abcdef", core.lower()
    elif re.fullmatch("[A-Z2-7]+", core):
        kind, letters = 1, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    else:
        kind, letters = 2, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    x, a, n = [letters.index(c) for c in core], len(letters), len(core)
    chi, df, mean = sum(c * c for c in Counter(x).values()) * a / n - n, a - 1, sum(x) / n
    up = [2 * c >= a for c in x]
    high, low = sum(up), n - sum(up)
    p_chi = tail(((max(chi, 0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    expected = 1 + 2 * high * low / n
    runs = 1 + sum(b != c for b, c in zip(up, up[1:]))
    z_runs = abs(runs - expected) / math.sqrt(max((expected - 1) * (expected - 2) / (n - 1), 1e-9)) if high and low else 9
    var = sum((c - mean) ** 2 for c in x)
    z_lag = abs(sum((b - mean) * (c - mean) for b, c in zip(x, x[1:])) / var) * math.sqrt(n) if var else 9
    uneven = a * (0.12, 0.065, 0.065)[kind] - 1
    p_text = tail(-(chi - (df + n * uneven)) / math.sqrt(2 * (df + 2 * n * uneven)))
    kinds = ["0" if c.isdigit() else "A" if c.isupper() else "a" for c in core if c not in "+/"]
    changes = sum(b != c for b, c in zip(kinds, kinds[1:]))
    p_changes = tail(2 * (math.sqrt(changes) - math.sqrt((0.12, 0.08, 0.35)[kind] * (n - 1))))
    digits = sum(c.isdigit() for c in core)
    fits = (-math.log(0.35) * sum(c.isalpha() for c in core), -math.log(0.6) * digits, 0)[kind]
    h = -math.log(max(p_text, 1e-12)) - math.log(max(p_changes, 1e-12)) + min(fits, 27.6)
    size = next((k for k, end in enumerate((24, 32, 48, 64, 96, 128, 256)) if n <= end), 7)
    return size, min(1, 3 * min(p_chi, 2 * tail(z_runs), 2 * tail(z_lag))), math.exp(-h) * (1 + h + h * h / 2)


def random_spans(texts: list[str | None], rate: float = 0.01, level: float = 0.001) -> list[list[tuple[int, int]]]:
    """Random strings of each text, with Benjamini and Hochberg's rule within length classes; p-values in tenths of their logarithm."""
    found = [[(m.start(), m.end(), *tested(m[0])) for m in re.finditer("[A-Za-z0-9+/_-]{20,}={0,2}", t or "") if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])] for t in texts]
    step = lambda p: min(200, math.floor(-math.log10(max(p, 1e-20)) * 10))
    limit = {}
    for k in range(8):
        own = sorted((10 ** (-step(f[4]) / 10) for fs in found for f in fs if f[2] == k))
        limit[k] = max((p for i, p in enumerate(own, 1) if p <= rate * sum(q <= p for q in own) / len(own)), default=-1)
    base = [[(m.start(), m.end()) for m in ASSIGN.finditer(t or "") if len(m[2]) >= 8] + [(m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}", t or "")] for t in texts]
    ok = lambda f, spans: f[4] <= limit[f[2]] and f[3] >= level and not any(a < f[1] and f[0] < b for a, b in spans)
    return [[f[:2] for f in fs if ok(f, b)] for fs, b in zip(found, base)]


def line_repeats(docs: list[tuple[int | None, str | None]], least: int, order) -> list[set[int]]:
    """Lines of every run of at least ``least`` words that equals an earlier run of lines, by row; rows go by id (null first), then by ``order`` of the text, then as given."""
    rows = [[(i, " ".join(s.split())) for i, s in enumerate((t or "").split("\n")) if s.split()] for _, t in docs]
    by = sorted(range(len(docs)), key=lambda r: (docs[r][0] is not None, docs[r][0] or 0, order(docs[r][1])))
    out: list[set[int]] = [set() for _ in docs]
    seen: dict[str, list[tuple[int, int]]] = {}
    for d in by:
        for p, (_, s) in enumerate(rows[d]):
            for e, q in seen.get(s, []):
                if p and q and rows[d][p - 1][1] == rows[e][q - 1][1]:
                    continue  # not the start of this run
                n = 0
                while p + n < len(rows[d]) and q + n < len(rows[e]) and rows[d][p + n][1] == rows[e][q + n][1]:
                    n += 1
                if sum(len(x.split()) for _, x in rows[d][p : p + n]) >= least:
                    out[d] |= {i for i, _ in rows[d][p : p + n]}
            seen.setdefault(s, []).append((d, p))
    return out
