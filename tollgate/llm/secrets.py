"""Secret scan: fixed patterns plus zstandard novelty.

Base patterns find assignments, access keys and hex runs.  The method adds strings that stand after a
sensitive word and that zstandard, primed with an identifier dictionary and with the surrounding
text, can't shorten: their marginal compressed bytes a character are those of random characters.

Defined cases: null text counts as empty and has no spans; an empty table gives no rows; repeated
rows are scanned each; texts are scanned whole whatever their length; other columns are ignored.
"""

from __future__ import annotations

import builtins
import functools
import importlib
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.llm.common import prepare, slices, table

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so asking for 16 here drops the shorter ones
LEAST = {"assign": 12, "access": 18}

#: Words after which a string is looked at, how far after, and what counts as one string.
SENSITIVE = re.compile(r"(?ai:passw|pwd|secret|token|key|auth|credential|bearer|private|session)")
REACH, SHORTEST = 48, 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{%d,}" % SHORTEST)
CONTEXT = 256
#: Marginal compressed bytes a character from which a string is reported.  Measured on strings of 16 to 40 characters:
#: random letters and digits, base64 and hex 0.75 and more (mostly over 0.94), identifiers and words up to 0.72.
NOVELTY = 0.75

#: Stands in for the text before a string that a document doesn't have.
PREFACE = ("this text stands before a string which has little else around it so that the coder has met some ordinary words and "
           "set_value(name, default) or user_name = get_config(path) in front of the string that it is going to be asked about, as "
           "most documents would have by then.\n")[-CONTEXT:]

SPANS = "array<struct<kind:string,start:int,end:int,novelty:double>>"

#: Modules whose public names (``__all__``, and the public members of the classes among them) make up the dictionary.
MODULES = ("argparse", "ast", "asyncio", "base64", "calendar", "codecs", "collections", "concurrent.futures", "configparser", "csv", "datetime",
           "decimal", "difflib", "email", "enum", "fractions", "functools", "gettext", "glob", "hashlib", "heapq", "html", "http.client",
           "http.cookies", "imaplib", "inspect", "io", "json", "locale", "logging", "mailbox", "mimetypes", "optparse", "os", "pathlib",
           "pickle", "plistlib", "queue", "random", "re", "sched", "secrets", "shutil", "smtplib", "socket", "socketserver", "statistics",
           "string", "struct", "subprocess", "tarfile", "tempfile", "textwrap", "threading", "tokenize", "trace", "traceback", "types",
           "typing", "unittest", "urllib.parse", "urllib.request", "warnings", "wave", "weakref", "xmlrpc.client", "zipfile")


def identifier_dictionary(size: int = 1 << 15) -> bytes:
    """A zstandard dictionary (content and entropy tables) trained on the identifiers of Python's standard library."""
    import zstandard
    public = lambda o: {n for n in vars(o) if n[0] != "_"}
    names = public(builtins)
    for module in map(importlib.import_module, MODULES):
        for n in module.__all__ if hasattr(module, "__all__") else ():
            names.add(n)
            if isinstance(o := getattr(module, n, None), type):
                names |= public(o)
    long = sorted(n for n in names if len(n) > 3)
    samples = [" ".join(long[i: i + 8]).encode() for i in range(0, len(long), 8)]
    return zstandard.train_dictionary(size, samples, level=19).as_bytes()


def _kept(matches, group: int, least: int):
    return [(m.start(), m.end()) for m in matches if m.end(group) - m.start(group) >= least]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns: leftmost non-overlapping matches per kind, too short ones dropped."""
    found = [(a, b, "assign") for a, b in _kept(ASSIGN.finditer(text), 2, LEAST["assign"])]
    found += [(a, b, "access") for a, b in _kept(ACCESS.finditer(text), 0, LEAST["access"])]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


class Novelty:
    """Marginal compressed size of a string within its surroundings, under a primed compressor."""

    def __init__(self, dictionary: bytes):
        import zstandard
        self.compressor = zstandard.ZstdCompressor(
            level=19, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=False, write_content_size=False,
            write_dict_id=False)

    def size(self, text: str) -> int:
        return len(self.compressor.compress(text.encode("utf-8", "surrogatepass")))

    def __call__(self, text: str, start: int, end: int) -> float:
        before, after = text[max(0, start - CONTEXT): start], text[end: end + CONTEXT]
        if len(before) < CONTEXT:  # too little text for the coder to settle; ordinary words stand in
            before = PREFACE[len(before):] + before
        return (self.size(before + text[start:end] + after) - self.size(before + after)) / (end - start)


def novel_spans(text: str, base: list[tuple[int, int, str]], novelty: Novelty, threshold: float = NOVELTY):
    """(start, end, 'novel', novelty) of incompressible strings in a sensitive context that no base span touches."""
    found, seen, b = [], -1, 0
    # of the base spans that start before a place, how far the longest reaches
    starts, reach = [x[0] for x in base], list(accumulate((x[1] for x in base), max))
    for m in SENSITIVE.finditer(text):
        # one that starts at the end of the reach has its least length behind it
        for c in CANDIDATE.finditer(text, m.end(), min(len(text), m.end() + REACH + SHORTEST)):
            a = c.start()
            if a > m.end() + REACH:
                break
            if a <= seen:
                continue
            if a >= b:  # else it is the rest of the string before, of the same end
                b = CANDIDATE.match(text, a).end()  # the reach may have cut it
            before = bisect_left(starts, b)
            if before and reach[before - 1] > a:
                continue
            seen = b - 1
            if (score := novelty(text, a, b)) >= threshold:
                found.append((a, b, "novel", score))
    return found


def scan_text(text: str, novelty: Novelty) -> list[tuple[str, int, int, float | None]]:
    base = base_spans(text)
    spans = [(a, b, k, None) for a, b, k in base] + novel_spans(text, base, novelty)
    spans.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return [(k, a, b, n) for a, b, k, n in spans]


#: A text that none of these match has no span (RE2, over a whole Arrow array at once): fixed kinds, and a sensitive word
#: with a long string behind it.
MAYBE = (r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", r"AKIA", r"[0-9a-f]{16}",
         r"(?i)(passw|pwd|secret|token|key|auth|credential|bearer|private|session)(?s:.{0,48}?)[A-Za-z0-9+/_=.-]{16}")


def _found(batch: pa.RecordBatch, novelty: Novelty) -> list:
    """Spans of each row's text."""
    text = pc.fill_null(batch.column("text"), "")
    spans: list = [[]] * batch.num_rows
    maybe = functools.reduce(pc.or_, (pc.match_substring_regex(text, m) for m in MAYBE))
    for i in pc.indices_nonzero(maybe).to_pylist():
        spans[i] = scan_text(text[i].as_py(), novelty)
    return spans


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and ``secret_spans`` (array of kind, start, end, novelty; code points, end exclusive) of every row."""
    prepare(docs.sparkSession)
    dictionary = identifier_dictionary()
    names = ("kind", "start", "end", "novelty")
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("novelty", pa.float64())])

    def run(batches):
        novelty = Novelty(dictionary)
        for b in slices(batches, "text", 16 << 20):
            spans = [[dict(zip(names, s, strict=True)) for s in row] for row in _found(b, novelty)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, pa.list_(item))], names=["doc_id", "secret_spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, secret_spans {SPANS}")


def redact_spans(text: str, spans: list[tuple[int, int]], mark: str = "[REDACTED]") -> str:
    """The text with every stretch that spans (by start) cover replaced by one mark."""
    out, at = [], 0
    for a, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """The documents, with all their columns, with secrets replaced by a mark."""
    prepare(docs.sparkSession)
    dictionary = identifier_dictionary()

    def run(batches):
        novelty = Novelty(dictionary)
        for b in slices(batches, "text", 16 << 20):
            text, spans = b.column("text"), _found(b, novelty)
            clean = [redact_spans(t.as_py(), [(s, e) for _, s, e, _ in x], mark) if x else t.as_py() for t, x in zip(text, spans, strict=True)]
            yield b.set_column(b.schema.get_field_index("text"), b.schema.field("text"), pa.array(clean, text.type))

    return docs.mapInArrow(run, docs.schema)


def digest_columns(scanned: DataFrame) -> DataFrame:
    spans = F.col("secret_spans")
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(F.filter(spans, lambda s: s["kind"] != "novel")), 256).alias("base_sha256"),
        joined(spans).alias("spans"), count("novel").alias("n_novel"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_columns(scan(table(spark, sf_dir, "documents")))
