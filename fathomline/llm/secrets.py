"""Secret scans: known forms of credentials, and strings that pass a battery of randomness tests.

Base spans are leftmost and non-overlapping for each kind. Beside them every other run of key characters is
given the narrowest encoding it fits (hexadecimal, base 32, base 64) and put to a battery against that
alphabet: chi-squared uniformity of its symbols, runs of symbol classes (lower case, upper case, digits,
marks), and serial correlation. A run that any of the three rejects at REJECT is not random.

The battery also says how far a run is from ordinary strings. The sum of the three statistics is chi-squared
for a random run; for an ordinary one, whose symbols keep to a class as those of words and numbers do, it is
noncentral, the more so the longer the run. The chance that an ordinary string of that length departs from
randomness as little as the run does is its p-value, so long runs may be convincing and short ones hardly.
p-values are weighted by length (weights are scaled to a mean of one over all tested runs) and controlled for
false discoveries over the whole corpus by Benjamini and Hochberg's procedure, taken at bins of the p-values
so that the counts that decide it stay few whatever the corpus; a bin passes only as a whole, which can but
lose discoveries.

Null text counts as empty: no spans. Repeated rows get repeated results, and each counts in the control. A
very long text is scanned whole. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, trimmed

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: Where an assignment may begin, by its first letters: cheap to look for.
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: A whole run of key characters; an equals sign belongs to it as padding at its end, not between name and value.
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{20,}+(?:=++(?![A-Za-z0-9+/_-]))?+|[A-Za-z0-9+/_-]{1,19}+=++(?![A-Za-z0-9+/_-]))")
#: Least length of a run, padding included.
LEAST = 20
#: Kinds in the order of their spans; the battery adds those of the second row.
KINDS = ("assign", "access", "hex")
ADDED = {"hex": "random_hex", "base32": "random_base32", "base64": "random_base64"}
#: Significance at which one test of the battery rejects randomness, false discovery rate, the length at which
#: a run has weight one before scaling, and the most that it has; bins of p-values in a power of ten.
REJECT, DISCOVERY, LENGTH, HEAVIEST, BINS = 0.001, 0.001, 32, 2.0, 64
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
_URL = str.maketrans("-_", "+/")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the known forms; a match that fails its condition is dropped, not retried."""
    out = []
    low = text.lower() if any(k in text for k in "=:") else ""
    if any(k in low for k in _KEYWORDS) or (low and not text.isascii()):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    return out + [("hex", *m.span()) for m in _HEX.finditer(text)]


def infer_encoding(run: str) -> tuple[str, str] | None:
    """The narrowest alphabet that a run fits, and the run in its symbols, padding removed."""
    body = run.rstrip("=")
    if "=" in body:
        return None
    for kind, symbols in (("hex", body.lower() if body in (body.lower(), body.upper()) else body), ("base32", body), ("base64", body.translate(_URL))):
        if set(symbols) <= set(ALPHABETS[kind]):
            return kind, symbols
    return None


def _class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


#: An ordinary string's moves between lower case, upper case, digits and marks: words, capitals, numbers.
_MOVES = np.array(((0.82, 0.08, 0.04, 0.06), (0.45, 0.45, 0.05, 0.05), (0.08, 0.06, 0.78, 0.08), (0.45, 0.25, 0.25, 0.05)))
_CLASSES = {kind: np.array([_class(c) for c in symbols]) for kind, symbols in ALPHABETS.items()}
_PLACE = {kind: {c: i for i, c in enumerate(symbols)} for kind, symbols in ALPHABETS.items()}


def _groups(kind: str, n: int) -> int:
    """Groups of symbols that chi-squared compares: at least five symbols expected in each."""
    return min(len(ALPHABETS[kind]), max(2, n // 5))


def _changes(shares: np.ndarray) -> tuple[float, float]:
    """Chance that neighbouring random symbols differ in class, and the variance of the number of such
    changes for each symbol of a long run."""
    mean = 1 - float((shares**2).sum())
    both = float((shares * (1 - shares) ** 2).sum())
    return mean, mean * (1 - mean) + 2 * (both - mean * mean)


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi_below(x: float, degrees: float) -> float:
    """P(chi-squared <= x), by Wilson and Hilferty's cube root."""
    if x <= 0:
        return 0.0
    z = ((x / degrees) ** (1 / 3) - (1 - 2 / (9 * degrees))) / math.sqrt(2 / (9 * degrees))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def statistics(symbols: str, kind: str) -> tuple[float, float, float]:
    """Chi-squared over groups of the alphabet, and the normal deviates of class changes and of serial
    correlation."""
    x = np.array([_PLACE[kind][c] for c in symbols])
    n, k, groups = len(x), len(ALPHABETS[kind]), _groups(kind, len(x))
    share = np.bincount(np.arange(k) * groups // k, minlength=groups) / k
    seen = np.bincount(x * groups // k, minlength=groups)
    chi = float(((seen - n * share) ** 2 / (n * share)).sum())
    classes = _CLASSES[kind][x]
    mean, spread = _changes(np.bincount(_CLASSES[kind]) / k)
    runs = (int((classes[1:] != classes[:-1]).sum()) - mean * (n - 1)) / math.sqrt(spread * (n - 1))
    c = x - x.mean()
    power = float((c * c).sum())
    serial = float((c[1:] * c[:-1]).sum()) / power * math.sqrt(n) if power else math.sqrt(n)
    return chi, runs, serial


def battery(symbols: str, kind: str) -> tuple[float, float, float]:
    """p-values of uniformity, runs and serial correlation for a random run."""
    chi, runs, serial = statistics(symbols, kind)
    return 1 - _chi_below(chi, _groups(kind, len(symbols)) - 1), _normal_tail(runs), _normal_tail(serial)


@cache
def departure(kind: str, groups: int) -> float:
    """What each symbol of an ordinary string adds to the expected sum of the three statistics: the strings
    move between the classes of the alphabet by _MOVES, and symbols are even within a class."""
    of = _CLASSES[kind]
    k, have = len(of), np.unique(of)
    moves = _MOVES[np.ix_(have, have)]
    moves = moves / moves.sum(1, keepdims=True)
    long_run = np.linalg.matrix_power(moves, 200)[0]
    x = np.arange(k)
    each = [x[of == h] for h in have]
    p = np.zeros(k)
    for share, places in zip(long_run, each, strict=True):
        p[places] = share / len(places)
    share = np.bincount(x * groups // k, minlength=groups) / k
    uneven = float(((np.bincount(x * groups // k, p, groups) - share) ** 2 / share).sum())
    mean, spread = _changes(np.bincount(of)[have] / k)
    changes = float((long_run * (1 - np.diag(moves))).sum())
    at = np.array([places.mean() for places in each])
    centre = float(long_run @ at)
    variance = float(sum(s * (places**2).mean() for s, places in zip(long_run, each, strict=True))) - centre**2
    serial = (float(at @ (long_run[:, None] * moves) @ at) - centre**2) / variance
    return uneven + (changes - mean) ** 2 / spread + serial**2


def ordinary(symbols: str, kind: str) -> float:
    """The chance that an ordinary string of that length departs from randomness as little: a noncentral
    chi-squared tail, by Patnaik's two moments."""
    chi, runs, serial = statistics(symbols, kind)
    groups = _groups(kind, len(symbols))
    degrees, away = groups + 1, len(symbols) * departure(kind, groups)
    scale = (degrees + 2 * away) / (degrees + away)
    return _chi_below((chi + runs**2 + serial**2) / scale, (degrees + away) ** 2 / (degrees + 2 * away))


def weight(length: int) -> float:
    return min(HEAVIEST, length / LENGTH)


def tested_runs(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str | None, int, int, float]]:
    """(kind, start, end, p) of the runs beside the taken spans; no kind where the battery rejects the run."""
    out = []
    for m in _RUN.finditer(text):
        start, end = m.span()
        if end - start < LEAST or any(s < end and start < e for _, s, e in taken):
            continue
        inferred = infer_encoding(m[0])
        if inferred and min(battery(inferred[1], inferred[0])) >= REJECT:
            out.append((ADDED[inferred[0]], start, end, ordinary(inferred[1], inferred[0])))
        else:
            out.append((None, start, end, 1.0))
    return out


def bin_of(p: float, w: float) -> int:
    """The bin of a weighted p-value, whose lower end is open."""
    return math.ceil(BINS * (math.log10(max(p, 1e-300)) - math.log10(w)))


def last_bin(counts: dict[int, int], runs: int, weights: float) -> int | None:
    """The last bin that the control lets pass: counts of candidates by bin, all tested runs, and the sum of
    their weights before scaling."""
    if not runs:
        return None
    scale, upto, found = math.log10(weights / runs), 0, None
    for k in sorted(counts):
        upto += counts[k]
        if k / BINS + scale <= math.log10(DISCOVERY * upto / runs):
            found = k
    return found


def _joined(spans: list[tuple[str, int, int]]) -> str:
    order = {k: i for i, k in enumerate((*KINDS, *ADDED.values()))}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], order[x[0]])))


def scan(text: str | None) -> tuple[list, list]:
    """Base spans and tested runs of a text."""
    if not text:
        return [], []
    base = base_spans(text)
    return base, tested_runs(text, base)


_CANDIDATE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("bin", pa.int32())])


def scan_runs(docs: DataFrame) -> DataFrame:
    """Of each row: counts of the base kinds, the digest of their spans, the spans, the runs that the battery
    lets pass with the bin of their weighted p-value, and the number and weights of all tested runs."""

    def scanned(batches):
        for b in batches:
            n: dict[str, list] = {k: [] for k in KINDS}
            digests, spans, runs, tested, weights = [], [], [], [], []
            for text in b.column(1).to_pylist():
                base, found = scan(text)
                for k in KINDS:
                    n[k].append(sum(x[0] == k for x in base))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append([{"start": s, "end": e, "kind": k, "bin": None} for k, s, e in base])
                runs.append([{"start": s, "end": e, "kind": k, "bin": bin_of(p, weight(e - s))} for k, s, e, p in found if k])
                tested.append(len(found))
                weights.append(sum(weight(e - s) for _, s, e, _ in found))
            arrays = [pa.array(n[k], pa.int64()) for k in KINDS] + [pa.array(digests, pa.string()), pa.array(spans, pa.list_(_CANDIDATE)), pa.array(runs, pa.list_(_CANDIDATE))]
            arrays += [pa.array(tested, pa.int64()), pa.array(weights, pa.float64())]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "runs", "tested", "weights"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    listed = "array<struct<start:long,end:long,kind:string,bin:int>>"
    return rows.mapInArrow(trimmed(scanned), f"doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base {listed}, runs {listed}, tested long, weights double")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans, of each row. Texts are read once;
    what is kept of them is written, and the control over the corpus needs one row a bin of p-values."""
    rows = materialise(scan_runs(docs), "secrets")
    runs, weights = rows.agg(F.coalesce(F.sum("tested"), F.lit(0)), F.coalesce(F.sum("weights"), F.lit(0.0))).first()
    counts = rows.select(F.explode("runs.bin").alias("bin")).groupBy("bin").agg(F.count("*").alias("n")).collect()
    last = last_bin({r.bin: r.n for r in counts}, runs, weights)
    added = F.filter("runs", lambda x: x["bin"] <= last) if last is not None else F.slice("runs", 1, 0)
    order = F.create_map(*(F.lit(v) for i, k in enumerate((*KINDS, *ADDED.values())) for v in (k, i)))
    every = F.array_sort(F.transform(F.concat("base", added), lambda x: F.struct(x["start"].alias("start"), order[x["kind"]].alias("order"), x["end"].alias("end"), x["kind"].alias("kind"))))
    written = F.array_join(F.transform(every, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return rows.select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", written.alias("spans"))
