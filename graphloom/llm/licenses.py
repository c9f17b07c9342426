"""License scans: MinHash bands over overlapping windows retrieve templates, containment verifies.

Words are runs of a-z and 0-9 of the lower-cased text; shingles are five words running. For each
template length n (in shingles) windows of n + stride - 1 shingles start every stride = n // 2
shingles (1 at least), so that some window holds any passage of n shingles whole. If a window
holds a share CONTAINMENT of a template's shingles, the Jaccard similarity J of both is at least
CONTAINMENT * n / (n + stride - 1 + (1 - CONTAINMENT) * n), and one of the BANDS bands of one row
agrees with a probability of 1 - (1 - J)**BANDS: 0.999997 at the least J of all templates
(`collision_bound`). An index of the templates' bands finds candidates; then some n shingles running
in the window or next to it, inside its document, must hold CONTAINMENT of the template's shingles.

Templates are short licenses whole, and of long ones the notices and headers that go into files; what
isn't among them isn't found. Other templates can be given.

Null and empty texts, and texts of fewer than five words, hold no license. Repeated rows are
scanned one by one; other columns are left out. Very long texts are scanned whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import LOWER, UPPER, read, small_batches
from graphloom.llm.features import Words
from graphloom.llm.license_texts import TEXTS as TEMPLATES
from graphloom.llm.neardup import _word, mixed

SHINGLE, CONTAINMENT, BANDS = 5, 0.8, 20
TOKEN = re.compile(rb"[a-z0-9]+")
_WORDS = Words(_word)
_NONE = np.uint64(2**64 - 1)


def _stride(n: int) -> int:
    return max(1, n // 2)


def collision_bound(n: int) -> float:
    """Least probability that a passage holding CONTAINMENT of n shingles shares a band."""
    j = CONTAINMENT * n / (n + _stride(n) - 1 + (1 - CONTAINMENT) * n)
    return 1 - (1 - j) ** BANDS


def _shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of all texts, of the shingle that starts there, and the word's text."""
    words = [[*map(_WORDS.__getitem__, TOKEN.findall(t.lower()))] for t in texts]
    flat = np.array([x for w in words for x in w], np.int64).view(np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(w) for w in words])
    out = np.full(len(flat), _NONE)
    if len(flat) >= SHINGLE:
        total = np.zeros(len(flat) - SHINGLE + 1, np.uint64)
        for j in range(SHINGLE):
            total = mixed(total + flat[j : len(flat) - SHINGLE + 1 + j] * np.uint64(2 * j + 3))
        inside = owner[: len(total)] == owner[SHINGLE - 1 :]
        out[: len(total)][inside] = np.minimum(total[inside], _NONE - np.uint64(1))
    return out, owner


def most_running(template: np.ndarray, hashes: np.ndarray) -> int:
    """The most of the template's n different shingles that stand in n running ones."""
    n = len(template)
    at = np.flatnonzero(np.isin(hashes, template))
    if len(np.unique(hashes[at])) <= 1 or at[-1] - at[0] < n:
        return len(np.unique(hashes[at]))
    kinds = np.searchsorted(template, hashes[at]).tolist()
    counts, most, start = Counter(), 0, 0
    for place, kind in zip(at.tolist(), kinds):
        counts[kind] += 1
        while place - at[start] >= n:
            counts[kinds[start]] -= 1
            if not counts[kinds[start]]:
                del counts[kinds[start]]
            start += 1
        most = max(most, len(counts))
    return most


def _row(hashes: np.ndarray, band: int) -> np.ndarray:
    """The hashes in the band's order; places without a shingle stay last."""
    x = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * (band + 1) % 2**64)) * np.uint64(2 * band + 0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return np.where(hashes == _NONE, _NONE, x)


class Index:
    """The templates' bands by length."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.sets = []
        for name in self.names:
            hashes, _ = _shingles([templates[name].encode()])
            self.sets.append(np.unique(hashes[hashes != _NONE]))
            if not len(self.sets[-1]):
                raise ValueError(f"template {name} has fewer than {SHINGLE} words")
        self.by_length: dict[int, list[int]] = {}
        for i, own in enumerate(self.sets):
            self.by_length.setdefault(len(own), []).append(i)
        # for each length and band: smallest values of its templates, and a table of their low bits
        self.bands = {n: [{int(_row(self.sets[i], b).min()): [] for i in own} for b in range(BANDS)] for n, own in self.by_length.items()}
        self.low = {n: np.zeros((BANDS, 1 << 12), bool) for n in self.by_length}
        for n, own in self.by_length.items():
            for b in range(BANDS):
                for i in own:
                    value = int(_row(self.sets[i], b).min())
                    self.bands[n][b][value].append(i)
                    self.low[n][b, value & 0xFFF] = True

    def scan(self, texts: list[str | None]) -> list[list[str]]:
        """The names of the licenses in each text."""
        hashes, owner = _shingles([(t or "").encode("utf-8", "surrogatepass") for t in texts])
        candidates: set[tuple[int, int]] = set()
        for b in range(BANDS if len(hashes) else 0):
            row = _row(hashes, b)
            for n, bands in self.bands.items():
                stride = _stride(n)
                padded = np.append(row, np.full(-len(row) % stride, _NONE)).reshape(-1, stride).min(1)
                least = padded
                for k in range(1, -(-(n + stride - 1) // stride)):
                    least = np.minimum(least, np.append(padded[k:], np.full(min(k, len(padded)), _NONE))[: len(padded)])
                for w in np.flatnonzero(self.low[n][b][(least & np.uint64(0xFFF)).astype(np.int64)]).tolist():
                    for i in bands[b].get(int(least[w]), ()):
                        candidates.add((i, w))
        found: list[set[str]] = [set() for _ in texts]
        for i, w in candidates:
            n = len(self.sets[i])
            at = slice(max(0, w * _stride(n) - n), w * _stride(n) + 3 * n + _stride(n))
            own, region = owner[at], hashes[at]
            for text in np.unique(own).tolist():
                if self.names[i] not in found[text] and most_running(self.sets[i], region[own == text]) >= CONTAINMENT * n:
                    found[text].add(self.names[i])
        return [sorted(x) for x in found]


_INDEXES: dict[tuple, Index] = {}


def scan(docs: DataFrame, *keep: str, templates: dict[str, str] | None = None) -> DataFrame:
    """The kept columns and the names of the licenses each document's text holds."""
    templates = TEMPLATES if templates is None else templates
    small_batches(docs.sparkSession)
    chosen = docs.select(*[docs[c] for c in keep], docs["text"].cast("string").alias("_text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in chosen.dtypes if c != "_text") + ", licenses array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = tuple(sorted(templates.items()))
        if key not in _INDEXES:
            _INDEXES[key] = Index(templates)
        index = _INDEXES[key]
        for batch in batches:
            found = index.scan(batch.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, pa.list_(pa.string()))], names=[*keep, "licenses"])

    return chosen.mapInArrow(run, schema)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_licenses and licenses (names joined by commas) of every document."""
    found = scan(read(spark, sf_dir, "documents"), "doc_id")
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses", ",").alias("licenses"))


def _oracle() -> str:
    """Brute force: all shingles of all templates against all windows of n shingles of every text."""
    rows = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in TEMPLATES.items())
    cut = lambda w, i: f"array_to_string({w}[{i}:{i} + {SHINGLE - 1}], ' ')"
    norm = lambda t: f"regexp_extract_all(translate({t}, '{UPPER}', '{LOWER}'), '[a-z0-9]+')"
    return f"""
WITH tw AS (SELECT name, {norm("t")} AS w FROM (VALUES {rows}) v(name, t)),
ts AS (SELECT DISTINCT name, {cut("w", "i")} AS s FROM (SELECT name, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM tw)),
tn AS (SELECT name, count(*) AS n FROM ts GROUP BY name),
d AS (SELECT row_number() OVER () AS rid, doc_id, {norm("coalesce(text, '')")} AS w FROM documents),
ds AS (SELECT rid, i, {cut("w", "i")} AS s FROM (SELECT rid, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM d)),
hit AS (SELECT rid, name, n, i, s FROM ds JOIN ts USING (s) JOIN tn USING (name)),
best AS (SELECT a.rid, a.name, count(DISTINCT b.s) AS k, any_value(a.n) AS n FROM hit a JOIN hit b ON a.rid = b.rid AND a.name = b.name AND b.i BETWEEN a.i AND a.i + a.n - 1 GROUP BY a.rid, a.name, a.i),
ok AS (SELECT DISTINCT rid, name FROM best WHERE k >= {CONTAINMENT} * n),
l AS (SELECT rid, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM ok GROUP BY rid)
SELECT doc_id, coalesce(l.n, 0)::BIGINT AS n_licenses, coalesce(names, '') AS licenses FROM d LEFT JOIN l USING (rid)"""


QUERIES = {"op4_licenses": op4_licenses}
ORACLE = {"op4_licenses": _oracle()}
