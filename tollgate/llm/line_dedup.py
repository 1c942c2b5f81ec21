"""Line deduplication by pairwise alignment.

Documents that share lines are found through line hashes: a line belongs to the earliest document that holds it, so
a document is paired with the owners of its lines and never with everyone who shares them.  A pair is aligned if
it shares a rare line (in at most ``RARE`` texts), or ``LINES`` lines, or ``CHARS`` characters of lines.  Patience diff
anchors the alignment on lines that are unique in both documents; every aligned block with a line that isn't blank is
deleted from the later document, and then the lines of the earlier one that occur again or in another order.  Copies of a whole text lose all their lines but for the earliest.

Lines in more than ``RARE`` texts need no pair: where the lines that earlier documents own, of all owners together, come to
``LINES`` lines or ``CHARS`` characters of a document, each of them is deleted wherever it stands in it, by the owner table alone.
Kept on purpose is a line in more than ``RARE`` texts in a document that shares less than that (a lone heading or separator).

Earlier means a smaller doc_id.  Lines are compared without white space around them.  Defined cases: null text counts
as empty; blank lines alone match nothing, so empty and blank texts are left alone; rows that repeat both doc_id and text
are one document and come out alike; a null doc_id is the latest; an empty table gives no rows; of a very long text the lines' hashes are held, and aligned with one owner at a time; other columns
are passed through by ``line_dedup`` and ignored by the query.
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.llm.common import prepare, scratch, table

RARE, LINES, CHARS = 100, 3, 200
LAST = (1 << 63) - 1
CUTS = "doc_id long, t1 long, t2 long, kept array<struct<start:int,length:int>>, n_removed long"


# ---- alignment of two documents ----------------------------------------------------------------------------------------

def _unique_common(a: list, b: list, a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Index pairs of lines that are unique in both ranges, by place in ``a``."""
    def once(x, lo, hi):
        at: dict = {}
        for i in range(lo, hi):
            at[x[i]] = -1 if x[i] in at else i
        return at
    in_a, in_b = once(a, a0, a1), once(b, b0, b1)
    return [(i, j) for v, i in in_a.items() if i >= 0 and (j := in_b.get(v, -1)) >= 0 and v != 0]


def _longest_rise(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of pairs that rises in both documents (patience sorting)."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tops, j)
        back.append(piles[k - 1] if k else -1)
        if k == len(tops):
            tops.append(j)
            piles.append(n)
        else:
            tops[k], piles[k] = j, n
    out, n = [], piles[-1] if piles else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned index pairs of two line lists, rising in both; 0 stands for a blank line, which is never an anchor."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 < a1 and b0 < b1:
            anchors = _longest_rise(_unique_common(a, b, a0, a1, b0, b1))
            if anchors:
                i, j = a0, b0
                for x, y in [*anchors, (a1, b1)]:
                    todo.append((i, x, j, y))
                    if x < a1:
                        out.append((x, y))
                    i, j = x + 1, y + 1
    return sorted(out)


def _gaps(lines: list, among: list[int]) -> list[tuple[tuple, int, int]]:
    """((line, next line, places apart), place, next place) of neighbours ``among`` places with nothing but blanks between."""
    return [((lines[i], lines[j], j - i), i, j) for i, j in zip(among, among[1:], strict=False) if j - i > 1 and not any(lines[i + 1: j])]


def common_lines(later: list, earlier: list) -> set[int]:
    """Lines of ``later`` in aligned blocks (runs adjacent in both) that hold a line that isn't blank, and what the one chain leaves:
    passages that occur twice or in another order.  Aligning the rest until nothing aligns would take every line that
    ``earlier`` holds, so those are taken at once, with the blank lines between two of them that ``earlier`` has there too."""
    got, block = set(), []
    pairs = patience(later, earlier)
    for n, (i, j) in enumerate(pairs):
        if block and (i, j) != (block[-1][0] + 1, block[-1][1] + 1):
            block = []
        block.append((i, j))
        if n + 1 == len(pairs) or pairs[n + 1] != (i + 1, j + 1):
            if any(later[x] for x, _ in block):
                got.update(x for x, _ in block)
            block = []
    got |= held_lines(later, [x for x in earlier if x])
    known = {gap for gap, _, _ in _gaps(earlier, [i for i, x in enumerate(earlier) if x])}
    for gap, i, j in _gaps(later, sorted(x for x in got if later[x])):
        if gap in known:
            got.update(range(i + 1, j))
    return got


def held_lines(later: list, lines: list) -> set[int]:
    """Places in ``later`` of any of ``lines``."""
    some = set(lines)
    return {i for i, x in enumerate(later) if x in some}


def kept_ranges(n: int, removed: set[int]) -> list[dict]:
    out: list[dict] = []
    for i in range(n):
        if i not in removed:
            if out and out[-1]["start"] + out[-1]["length"] == i:
                out[-1]["length"] += 1
            else:
                out.append({"start": i, "length": 1})
    return out


# ---- Spark ---------------------------------------------------------------------------------------------------------------

def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _t1() -> Column:
    return F.xxhash64(_text())


def _t2() -> Column:
    return F.xxhash64(F.lit(2), _text())


def _hashed(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, t1, t2, find, align, size): per line a hash to find it by, another to align by (0: blank) and its length."""
    lines = F.split(_text(), "\n", -1)
    clean = F.transform(lines, lambda x: F.trim(F.translate(x, "\t\r\x0b\x0c", "    ")))
    hashed = lambda seed: F.transform("lines", lambda x: F.when(x == "", F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(seed), x)))
    out = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), _t1().alias("t1"), _t2().alias("t2"), clean.alias("lines"))
    return out.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "t1", "t2", hashed(3).alias("find"), hashed(5).alias("align"),
                      F.transform("lines", F.length).alias("size"))


def _first_copies(rows: DataFrame) -> DataFrame:
    """For each distinct text: its earliest document (doc_id, rid) and whether a later one repeats it."""
    key = F.struct("doc_id", "rid")
    return rows.groupBy("t1", "t2").agg(F.min(key).alias("first"), F.max("doc_id").alias("last"))


def cuts(docs: DataFrame, rare: int | None = RARE, lines: int = LINES, chars: int = CHARS) -> DataFrame:
    """A row for each document (doc_id, t1, t2) that loses lines, with the ranges of lines it keeps.  ``rare`` None: every pair that
    shares a line is aligned, however many texts hold it, so that what goes depends on the two documents only."""
    rows = scratch(_hashed(docs), "lines")
    texts = scratch(_first_copies(rows), "texts")
    first = texts.select(F.col("first.rid").alias("rid"))
    heads = rows.join(first, "rid", "left_semi")
    # copies: every document but the first of its text, unless the text is blank
    copied = texts.where(F.col("last") > F.col("first.doc_id")).select("t1", "t2", F.col("first.doc_id").alias("head"))
    # one row a document before the join, so that nothing after it needs a text's rows together and a hot text can be split
    known = rows.where(F.exists("align", lambda x: x != 0)).groupBy("doc_id", "t1", "t2").agg(F.max(F.size("align")).cast("long").alias("n_removed"))
    copies = known.join(copied, ["t1", "t2"]).where(F.col("doc_id") != F.col("head"))
    # lines that several texts hold: owner and number of texts
    held = heads.select("rid", "doc_id", F.explode(F.array_distinct(F.arrays_zip("find", "align", "size"))).alias("l")).select(
        "rid", "doc_id", F.col("l.find").alias("find"), F.col("l.align").alias("align"), F.col("l.size").alias("size")).where("find != 0")
    shared = held.groupBy("find", "align").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "rid")).alias("owner")).where("n > 1")
    # a table of its own, so that both sides of the join are shuffled for it and a hot line's rows can be split at run time
    shared = scratch(shared.select("find", "align", "n", F.col("owner.rid").alias("owner")), "shared")
    owned = held.join(shared, ["find", "align"]).where("rid != owner")
    rare = LAST if rare is None else rare
    owned = owned.groupBy("rid", "owner").agg(F.min("n").alias("rarest"), F.count("*").alias("lines"), F.sum("size").alias("chars"),
                                              F.collect_list(F.when(F.col("n") > rare, F.col("align"))).alias("hot"))
    enough = (F.col("lines") >= lines) | (F.col("chars") >= chars)
    owned = owned.withColumn("paired", (F.col("rarest") <= rare) | enough)
    # per document: the owners it is aligned with, and its hot lines of other owners if all it shares is enough
    found = owned.groupBy("rid").agg(F.sum("lines").alias("lines"), F.sum("chars").alias("chars"), F.collect_list(F.when(F.col("paired"), F.col("owner"))).alias("owners"),
                                     F.flatten(F.collect_list(F.when(~F.col("paired"), F.col("hot")))).alias("hot"))
    found = scratch(found.select("rid", "owners", F.when(enough, F.col("hot")).alias("hot")), "found")
    pairs = found.select("rid", F.explode("owners").alias("owner"))
    with_owner = pairs.join(rows.select(F.col("rid").alias("owner"), F.col("align").alias("earlier")), "owner").select("rid", "earlier", F.lit(False).alias("is_hot"))
    hot = found.where(F.size("hot") > 0).select("rid", F.col("hot").alias("earlier"), F.lit(True).alias("is_hot"))
    with_owner = with_owner.unionByName(hot)
    both = with_owner.join(rows.select("rid", "doc_id", "t1", "t2", "align"), "rid")
    keys = ["doc_id", "t1", "t2", "n_lines"]

    def align(batches):
        # a pair of documents at a time: what a document loses to all of its owners together is put together below
        for b in batches:
            places, lost = [], []
            for i, (later, earlier, is_hot) in enumerate(zip(b.column("align"), b.column("earlier"), b.column("is_hot"), strict=True)):
                removed = (held_lines if is_hot.as_py() else common_lines)(later.as_py(), earlier.as_py())
                if removed:
                    places.append(i)
                    lost.append(sorted(removed))
            some = b.take(pa.array(places, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("rid", *keys)), pa.array(lost, pa.list_(pa.int32()))], names=["rid", *keys, "removed"])

    def keep(batches):
        item = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
        for b in batches:
            removed = [set(x) for x in b.column("removed").to_pylist()]
            kept = [kept_ranges(n, r) for n, r in zip(b.column("n_lines").to_pylist(), removed, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keys[:3]), pa.array(kept, item), pa.array(list(map(len, removed)), pa.int64())],
                                             names=["doc_id", "t1", "t2", "kept", "n_removed"])

    prepare(docs.sparkSession)
    pairs = both.withColumn("n_lines", F.size("align"))
    lost = pairs.select("rid", *keys, "align", "earlier", "is_hot").mapInArrow(align, "rid long, doc_id long, t1 long, t2 long, n_lines int, removed array<int>")
    lost = lost.select("rid", *keys, F.explode("removed").alias("line")).groupBy("rid", *keys).agg(F.collect_set("line").alias("removed"))
    aligned = lost.select(*keys, "removed").mapInArrow(keep, CUTS)
    return aligned.unionByName(copies.select("doc_id", "t1", "t2", F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("kept"), "n_removed"))


def line_dedup(docs: DataFrame, **options) -> DataFrame:
    """All columns of ``docs`` (any called n_lines or n_removed are replaced), ``text`` without the deleted lines, and n_lines, n_removed (long)."""
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    cut = scratch(cuts(docs.select("doc_id", "text"), **options), "cuts")
    # the row as one struct, so that none of its names can clash
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), _text().alias("text"),
                        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), _t1().alias("t1"), _t2().alias("t2"))
    joined = keyed.join(cut.hint("shuffle_hash"), ["doc_id", "t1", "t2"], "left")
    lines = F.split("text", "\n", -1)
    rest = F.array_join(F.flatten(F.transform("kept", lambda k: F.slice(lines, k["start"] + 1, k["length"]))), "\n")
    cols = [F.when(F.col("kept").isNull(), F.col("row")["text"]).otherwise(rest).alias("text") if c == "text" else F.col("row")[c].alias(c) for c in columns]
    return joined.select(*cols, F.size(lines).cast("long").alias("n_lines"), F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the text that is left, for every document."""
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")
