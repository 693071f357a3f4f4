"""Finds secrets and links the parts of credentials.

Strong parts are reported by themselves: `assign` (a named value), `access` (access key ids) and
`hex` (long hexadecimal strings). Weak parts are not: `user` (a named account), `short` (a named
value too short to be strong), `blob` (a long mixed string) and `endpoint` (a host with a port or
an address with a scheme). A weak part is reported if a part that completes a credential with it
stands in the same scope: at most SCOPE characters away and not beyond an empty line.

Roles: access and user are identifiers, assign, hex, short and blob secrets, endpoint the place.
A weak part needs a part of each of the two other roles, or a strong part of one of them.

The link is an interval join: parts are dealt to bins of SCOPE characters of their scope, those
asked about meet the others of their bin and the neighbours. For each part and role only the
nearest on either side matters, so a crowded bin is scanned in order by a window, not by pairs.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearpair.llm.tables import written

SCOPE = 200  # characters
KINDS = ("assign", "access", "hex", "user", "short", "blob", "endpoint")
_BASE = ("assign", "access", "hex")

_VALUE = r"[A-Za-z0-9+/_.=-]+"
_ASSIGN = re.compile(rf"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?({_VALUE})", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_USER = re.compile(rf"\b(?:user(?:name)?|login|account|client_?id)[\"']?\x20*[:=]\x20*[\"']?({_VALUE})", re.A | re.I)
_BLOB = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(r"[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]+|(?<![\w.@-])(?:[a-z0-9-]+\.)+[a-z]{2,}:\d{2,5}(?!\d)", re.A)
_BREAK = re.compile(r"\n[ \t\r]*\n")


def find_parts(text: str) -> list[tuple[str, int, int]]:
    """`kind, start, end` (code points, end exclusive) of all parts, strong and weak."""
    out, short = [], []
    for m in _ASSIGN.finditer(text):
        (out if m.end(2) - m.start(2) >= 12 else short).append((m.start(), m.end()))
    parts = [("assign", a, b) for a, b in out] + [("short", a, b) for a, b in short]
    if "AKIA" in text:
        parts += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    parts += [("hex", *m.span()) for m in _HEX.finditer(text)]
    strong = sorted((a, b) for k, a, b in parts if k != "short")
    weak = [("user", *m.span()) for m in _USER.finditer(text)]
    weak += [("endpoint", *m.span()) for m in _ENDPOINT.finditer(text)] if ":" in text else []
    weak += [("blob", *m.span()) for m in _BLOB.finditer(text) if _mixed(m.group())]
    return parts + [w for w in weak if w[0] != "blob" or not any(a < w[2] and w[1] < b for a, b in strong)]


def _mixed(value: str) -> bool:
    """Has digits and letters of both cases."""
    return any(c.isdigit() for c in value) and value.lower() != value and value.upper() != value


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, kinds, starts, ends, scopes = [], [], [], [], []
        numbers, texts = batch.column("row"), batch.column("text")
        digests, counts = [], []
        for low in range(0, batch.num_rows, 256):
            for text in texts.slice(low, 256).to_pylist():
                text = text or ""
                parts = find_parts(text)
                base = sorted((p for p in parts if p[0] in _BASE), key=lambda p: (p[1], _BASE.index(p[0])))
                digests.append(hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest())
                counts.append([sum(p[0] == k for p in base) for k in _BASE])
                breaks = [m.end() for m in _BREAK.finditer(text)] if parts else []
                kinds.append([p[0] for p in parts])
                starts.append([p[1] for p in parts])
                ends.append([p[2] for p in parts])
                scopes.append([bisect_right(breaks, p[1]) for p in parts])
        yield pa.RecordBatch.from_arrays(
            [
                numbers, batch.column("id"), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(3)), pa.array(digests, pa.string()),
                pa.array(kinds, pa.list_(pa.string())), *(pa.array(x, pa.list_(pa.int64())) for x in (starts, ends, scopes)),
            ],
            ["row", "id", "n_assign", "n_access", "n_hex", "base_sha256", "kinds", "starts", "ends", "scopes"],
        )


_FOUND = (
    "row bigint, id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, "
    "kinds array<string>, starts array<bigint>, ends array<bigint>, scopes array<bigint>"
)


def _in(names: list[str]) -> Column:
    return F.col("kind").isin(names)


def linked_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """`parts` (`row, scope, kind, start, end`) that are reported: the strong ones, and weak ones
    with what completes them near by in their scope."""
    role = F.when(_in(["access", "user"]), "id").when(F.col("kind") == "endpoint", "place").otherwise("secret")
    parts = parts.withColumn("role", role).withColumn("strong", _in(list(_BASE)))
    # an interval reaches into the bins beside its own; a long part stands in all it touches
    bins = F.sequence(F.floor((F.col("start") - scope) / scope), F.floor((F.col("end") + scope) / scope))
    dealt = parts.withColumn("bin", F.explode(bins)).withColumn("home", F.col("bin").between(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope)))
    # a stretch of the bins: what begins before a part, and what begins at it or after
    before = Window.partitionBy("row", "scope", "bin").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row", "scope", "bin").orderBy("start", "end", "kind").rowsBetween(1, Window.unboundedFollowing)
    out, flags = dealt, []
    for name in ("id", "secret", "place"):
        for strong in (False, True):
            chosen = (F.col("role") == name) & (F.col("strong") if strong else F.lit(True))
            left = F.max(F.when(chosen, F.col("end"))).over(before)
            right = F.min(F.when(chosen, F.col("start"))).over(after)
            near = F.coalesce(F.col("start") - left <= scope, F.lit(False)) | F.coalesce(right - F.col("end") <= scope, F.lit(False))
            flags.append(f"{'strong' if strong else 'any'}_{name}")
            out = out.withColumn(flags[-1], near)
    # what a long part is near to is what any of its bins says
    whole = out.filter("home").groupBy("row", "kind", "start", "end", "role", "strong").agg(*[F.bool_or(f).alias(f) for f in flags])
    kept = F.col("strong")
    others = {"id": ("secret", "place"), "secret": ("id", "place"), "place": ("id", "secret")}
    for name, (a, b) in others.items():
        complete = (F.col(f"any_{a}") & F.col(f"any_{b}")) | F.col(f"strong_{a}") | F.col(f"strong_{b}")
        kept = kept | ((F.col("role") == name) & complete)
    return whole.filter(kept).select("row", "kind", "start", "end", "strong")


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """`id, n_assign, n_access, n_hex, base_sha256, spans, n_linked` for every row of `docs`.

    spans: `kind:start:end` of all reported parts by start, then kind in the order of KINDS, with
    commas between; base_sha256: SHA-256 of the same text for the strong parts alone; n_linked:
    weak parts reported. A null or empty text has no parts. Repeated rows and ids are searched
    each for itself. Other columns are not read.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = written(rows.mapInArrow(_found, _FOUND), "parts")
    parts = found.select("row", F.inline(F.arrays_zip("kinds", "starts", "ends", "scopes"))).toDF("row", "kind", "start", "end", "scope")
    weak = found.filter(F.exists("kinds", lambda k: ~k.isin(list(_BASE)))).select("row")
    # rows of strong parts alone need no join
    linked = linked_parts(parts.join(weak, "row", "left_semi"), scope)
    alone = parts.join(weak, "row", "left_anti").select("row", "kind", "start", "end", F.lit(True).alias("strong"))
    kept = linked.unionByName(alone)
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    span = F.struct("start", place.alias("k"), F.concat_ws(":", "kind", "start", "end").alias("s"))
    spans = kept.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("x"), F.sum(F.when(F.col("strong"), 0).otherwise(1)).alias("n"))
    out = found.join(spans, "row", "left")
    return out.select(
        "id", "n_assign", "n_access", "n_hex", "base_sha256",
        F.coalesce(F.array_join(F.transform("x", lambda s: s["s"]), ","), F.lit("")).alias("spans"), F.coalesce("n", F.lit(0)).alias("n_linked"),
    )
