"""Secret scans with an incremental ledger of blobs.

Every version of a text is addressed by its SHA-256. The ledger, a Parquet table
that only grows, holds which blob was scanned by which version of the rules and
what was found. A run scans the texts of unseen (blob, rules) pairs alone, each
once, appends them, and joins the findings back to every path with that blob.

Defined results: a null text counts as empty; copies share one scan; a text
without findings has an empty list of spans; repeated paths give a row each.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.llm import common

# The kinds in their order. Of (anchors, pattern, group, least
# size), a text is searched for the pattern only if it holds an anchor.
_ASSIGN = rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A private key runs to the END line of its label; where that is missing, over header fields and
# runs of base64 with what parts them, line ends within quoted strings too.
_GAP = rb"""(?:\\[nrt]|[\s>"'|#*,\\])"""
_FIELDS = rb"(?:" + _GAP + rb"++[A-Za-z][A-Za-z-]*+:\x20(?:(?![A-Za-z0-9+/]{40})[^\r\n\\])*+)*+"
_BODY = _FIELDS + _GAP + rb"*[A-Za-z0-9+/]{20,}(?:" + _GAP + rb"+[A-Za-z0-9+/]{20,})*(?:={1,2}|" + _GAP + rb"+[A-Za-z0-9+/]{1,19}={0,2})?(?:" + _GAP + rb"+=[A-Za-z0-9+/]{4}(?![A-Za-z0-9+/]))?"
_KEY = rb"-----BEGIN ([A-Z ]*PRIVATE KEY(?: BLOCK)?)-----(?:(?:(?!-----BEGIN )[\s\S])*?-----END \1-----|(?:" + _BODY + rb")?)"
RULES = {
    "assign": ((b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"), re.compile(rb"(?i:" + _ASSIGN[: _ASSIGN.index(b")") + 1] + rb")" + _ASSIGN[_ASSIGN.index(b")") + 1 :]), 2, 6),
    "access": ((b"akia",), re.compile(rb"AKIA[A-Z0-9]+"), 0, 20),
    "hex": ((), re.compile(rb"[0-9a-f]+"), 0, 24),
    "github": ((b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_"), re.compile(rb"gh[pousr]_[A-Za-z0-9]{36,}"), 0, 40),
    "slack": ((b"xox",), re.compile(rb"xox[abprs]-[A-Za-z0-9-]{10,}"), 0, 15),
    "google": ((b"aiza",), re.compile(rb"AIza[0-9A-Za-z_-]{35,}"), 0, 39),
    "jwt": ((b"eyj",), re.compile(rb"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 0, 28),
    "private_key": ((b"private key",), re.compile(_KEY), 0, 20),
}
BASE_KINDS = ("assign", "access", "hex")
KINDS = tuple(RULES)
#: Changes with any rule, so that a changed rule is a version of its own.
RULES_VERSION = hashlib.sha256(repr([(k, a, p.pattern, g, n) for k, (a, p, g, n) in RULES.items()]).encode()).hexdigest()[:16]

_LOWER = bytes(range(256)).lower()
_HEX = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_HEX_RUN = re.compile(rb"h{24,}")


def find_spans(data: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind as listed."""
    low = data.translate(_LOWER)
    found = []
    for order, (kind, (anchors, pattern, group, least)) in enumerate(RULES.items()):
        if kind == "hex":
            runs = data.translate(_HEX)
            if b"h" * least in runs:
                found += [(m.start(), order, m.end()) for m in _HEX_RUN.finditer(runs)]
        elif any(a in low for a in anchors):
            found += [(m.start(), order, m.end()) for m in pattern.finditer(data) if m.end(group) - m.start(group) >= least]
    if not found:
        return []
    # byte positions to code points, left to right
    at = chars = 0
    place = {}
    for x in sorted({p for a, _, b in found for p in (a, b)}):
        chars += len(data[at:x].decode())
        at, place[x] = x, chars
    return [(KINDS[k], place[a], place[b]) for a, k, b in sorted(found)]


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_LEDGER = T.StructType([T.StructField("blob", T.BinaryType()), T.StructField("rules", T.StringType()), T.StructField("spans", _SPANS)])


def _scan_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in common.slices(batch.column(1)):
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(x)] for x in batch.column(1).slice(a, b - a).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array([RULES_VERSION] * (b - a)), pa.array(spans, _SPANS_ARROW)],
                names=["blob", "rules", "spans"],
            )


class BlobLedger:
    """The table of scanned blobs at a path that all executors share; one run writes it at a time."""

    def __init__(self, spark, path: str, create: bool = True):
        self.spark, self.path = spark, path
        if create:
            spark.createDataFrame([], _LEDGER).write.mode("append").parquet(path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(_LEDGER).parquet(self.path)

    def current(self) -> DataFrame:
        """(blob, spans) by the rules as they are; runs at one time may have added a blob twice."""
        return self.read().filter(F.col("rules") == RULES_VERSION).select("blob", "spans")

    def findings(self) -> DataFrame:
        """One row (blob, spans) for each blob in which something was found."""
        return self.current().filter(F.size("spans") > 0).groupBy("blob").agg(F.first("spans").alias("spans"))

    def unseen(self, blobs: DataFrame) -> DataFrame:
        """One row (blob, text) for each blob that the current rules haven't scanned."""
        fresh = blobs.join(self.current().select("blob"), "blob", "left_anti")
        return fresh.groupBy("blob").agg(F.first("text").alias("text"))

    def update(self, blobs: DataFrame) -> None:
        common.map_arrow(self.unseen(blobs), _scan_blobs, _LEDGER).write.mode("append").parquet(self.path)


def scan_secrets(df: DataFrame, ledger: BlobLedger, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) and ``secret_spans`` of each row's text."""
    keep = df.columns if keep is None else keep
    value = common.text_or_empty(text)
    address = F.unhex(F.sha2(value, 256))
    ledger.update(df.select(address.alias("blob"), value.cast("binary").alias("text")))
    name = common.free_name(df.select(*keep), "secret_spans")
    paths = df.select(address.alias("_blob"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"))
    found = ledger.findings()
    joined = paths.join(found, paths["_blob"] == found["blob"], "left")
    return joined.select("_row.*", F.coalesce("spans", F.expr("array()").cast(_SPANS)).alias(name))


def redact_text(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """The text with each stretch of overlapping (start, end) replaced by one mark, in one pass."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, spans: str = "secret_spans", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The text with each stretch of overlapping spans replaced by one mark."""
    others = [c for c in df.columns if c != text]
    places = F.transform(F.col(spans), lambda s: F.struct(s["start"], s["end"]))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row"), F.col(f"`{text}`").alias("_text"), places.alias("_places"))
    schema = T.StructType([rows.schema["_row"], rows.schema["_text"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in common.slices(batch.column(1)):
                texts, found = batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a)
                if pc.any(pc.greater(pc.list_value_length(found), 0)).as_py():
                    clean = [redact_text(t, [(x["start"], x["end"]) for x in p], mark) if t is not None and p else t for t, p in zip(texts.to_pylist(), found.to_pylist(), strict=True)]
                    texts = pa.array(clean, pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), texts], names=["_row", "_text"])

    done = common.map_arrow(rows, run, schema)
    return done.select(*[F.col("_text").alias(c) if c == text else F.col(f"_row.`{c}`") for c in df.columns])


def span_list(column, kinds: tuple[str, ...] | None = None):
    """kind:start:end, comma-joined, in the order found."""
    if kinds:
        column = F.filter(column, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_history(versions: list[DataFrame], ledger: BlobLedger, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Versions of a table, oldest first, by one ledger: the findings of the last one's rows.

    Each version's blobs go through the ledger in turn, so what an older one held already
    isn't scanned again.
    """
    for older in versions[:-1]:
        value = common.text_or_empty(text)
        ledger.update(older.select(F.unhex(F.sha2(value, 256)).alias("blob"), value.cast("binary").alias("text")))
    return scan_secrets(versions[-1], ledger, text, keep)


def op7_secret_ledger(spark, sf_dir: str, ledger_path: str | None = None) -> DataFrame:
    """Findings of every document; a ledger that earlier runs filled is used where its path is given."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ledger = BlobLedger(spark, ledger_path or common.fresh_path(spark, "ledger"))
    found = scan_history([docs], ledger, keep=["doc_id"])
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in BASE_KINDS],
        F.sha2(span_list(F.col("secret_spans"), BASE_KINDS), 256).alias("base_sha256"),
        span_list(F.col("secret_spans")).alias("spans"),
    )
