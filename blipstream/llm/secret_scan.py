"""Secret scan: fixed patterns, and randomness tests on encoded tokens with false-discovery control."""

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bound_batches, materialise

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?((?-i:[A-Za-z0-9+/_.=-]+))", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}")
#: A token needs a digit and a letter; base64 needs letters of both cases, the others (by the first alphabet that holds the token: hex, base32, base36) are of one case, either one.
ALPHABETS = {
    "random_hex": "0123456789abcdef",
    "random_base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "random_base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "random_base36": "0123456789abcdefghijklmnopqrstuvwxyz",
}
KINDS = ("assign", "access", "hex", *ALPHABETS)
#: p-values are kept as whole hundredths, rounded down.
CELLS = 100
SPAN = "struct<start:int,rank:int,kind:string,end:int>"
CANDIDATE = "struct<start:int,rank:int,kind:string,end:int,band:int,cell:int>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of the fixed patterns."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def encoding(token: str) -> str | None:
    if not any(c.isdigit() for c in token):
        return None
    upper, lower = token.upper(), token.lower()
    if token not in (upper, lower):
        return None if {"+", "/"} & set(token) and {"-", "_"} & set(token) else "random_base64"
    if upper != lower:
        for kind in ("random_hex", "random_base32", "random_base36"):
            if set(lower) <= set(ALPHABETS[kind].lower()):
                return kind
    return None


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def randomness_p(token: str, kind: str) -> float:
    """Fisher's combination of three tests of 'each symbol is uniform and independent'; small means not random."""
    alphabet = ALPHABETS[kind]
    token = token.replace("-", "+").replace("_", "/") if kind == "random_base64" else token.upper() if kind == "random_base32" else token.lower()
    x = np.array([alphabet.index(c) for c in token], float)
    n, k = len(x), len(alphabet)
    chi = float(((np.bincount(x.astype(int), minlength=k) - n / k) ** 2).sum() * k / n)
    uniform = normal_tail(((chi / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1))))
    high = x >= k / 2
    a, b = float(high.sum()), float(n - high.sum())
    mean, spread = 1 + 2 * a * b / n, max(1e-9, 2 * a * b * (2 * a * b - n) / (n * n * (n - 1)))
    runs = 2 * normal_tail(abs(1 + float((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(spread))
    centred = x - (k - 1) / 2
    serial = 2 * normal_tail(abs(float((centred[1:] * centred[:-1]).sum())) / (math.sqrt(n - 1) * (k * k - 1) / 12))
    half = -sum(math.log(max(p, 1e-300)) for p in (uniform, min(1.0, runs), min(1.0, serial)))
    return math.exp(-half) * (1 + half + half * half / 2)


def candidates(text: str) -> list[dict]:
    """All encoded tokens, with the length band (powers of two) and the cell of their p-value."""
    found = []
    for m in TOKEN.finditer(text):
        if kind := encoding(m[0]):
            cell = min(CELLS - 1, int(randomness_p(m[0], kind) * CELLS))
            found.append({"start": m.start(), "rank": KINDS.index(kind), "kind": kind, "end": m.end(), "band": len(m[0]).bit_length(), "cell": cell})
    return found


def least_cell(counts: np.ndarray, rate: float, clear: float, least: float = 0.01) -> int:
    """The lowest cell from which tokens are reported: at most ``rate`` of them are then expected not to be random.

    Random tokens have uniform p-values and others small ones, so the cells from ``clear`` on tell how many random
    tokens there are (Storey's estimate), and 1 - t of those are reported from a p of t on; what is reported beyond
    them is false, up to two standard errors of that difference. No token with a p below ``least`` is reported, however few there are; CELLS: none at all.
    """
    above = np.append(np.cumsum(counts[::-1])[::-1], 0)
    random = min(float(above[0]), above[round(clear * CELLS)] / (1 - clear))
    for cell in range(math.ceil(least * CELLS), CELLS):
        t = cell / CELLS
        error = 2 * math.sqrt(random * max(0.0, clear - t) * (1 - t) / (1 - clear))
        if above[cell] and above[cell] - random * (1 - t) <= rate * above[cell] + error + 1e-9:
            return cell
    return CELLS


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.05, clear: float = 0.2) -> DataFrame:
    """One row per input row: id, base and spans (arrays of SPAN by start, then kind; code points, end exclusive).

    base has the fixed patterns. spans adds every token of 20 and more symbols, within a base span or not, whose
    inferred encoding passes a battery for randomness: chi-squared uniformity over the alphabet, runs about the
    middle, and lag-one serial correlation, combined by Fisher. The p-values of all tokens of the table are counted
    per encoding and length band, as the tests of longer tokens are sharper; in each band the tokens reported are
    those from the lowest p at which at most ``rate`` of them are expected to be false (see least_cell).

    Null text counts as empty. Null ids and repeated rows pass, each row on its own. An empty table gives an
    empty result. Other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            base, found = [], []
            for text in batch.column(names.index(text_col)).to_pylist():
                base.append([{"start": a, "rank": r, "kind": KINDS[r], "end": b} for a, r, b in base_spans(text or "")])
                found.append(candidates(text or ""))
            span = [("start", pa.int32()), ("rank", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(names.index(id_col)), pa.array(base, pa.list_(pa.struct(span))), pa.array(found, pa.list_(pa.struct([*span, ("band", pa.int32()), ("cell", pa.int32())])))],
                ["__id", "base", "found"],
            )

    bound_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    scanned = materialise(df.select(id_col, text_col).mapInArrow(run, f"__id {kind}, base array<{SPAN}>, found array<{CANDIDATE}>"), "secret-spans")
    # One row per encoding, power of two and hundredth: at most 4 * 32 * CELLS.
    bands: dict[str, np.ndarray] = {}
    for r in scanned.select(F.explode("found").alias("c")).groupBy("c.kind", "c.band", "c.cell").count().collect():
        bands.setdefault(f"{r['kind']}:{r['band']}", np.zeros(CELLS, np.int64))[r["cell"]] = r["count"]
    cuts = F.create_map(*[F.lit(x) for name in sorted(bands) for x in (name, least_cell(bands[name], rate, clear))]) if bands else None

    def kept(c):
        return F.lit(False) if cuts is None else c["cell"] >= F.try_element_at(cuts, F.concat_ws(":", c["kind"], c["band"].cast("string")))

    random = F.transform(F.filter("found", kept), lambda c: F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["kind"].alias("kind"), c["end"].alias("end")))
    return scanned.select(F.col("__id").alias(id_col), "base", F.array_sort(F.concat("base", random)).alias("spans"))
