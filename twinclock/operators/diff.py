"""Comparing revision texts as a distributed job over pairs of revisions.

A pair is (pair_id, old_text, new_text), and may carry a ``status`` that says why it is not to be compared. Every pair
keeps a row with its status through each operator. Pairs are independent rows, so no group is ever collected. There is
no bound on texts or edits unless the caller sets one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinclock.functions.instants import BLANK, trimmed
from twinclock.functions.texts import shortest_edit, split_lines, word_parts
from twinclock.llm.common import bound_batches
from twinclock.operators.slices import Scan
from twinclock.schema import HUNK_CONTEXT

LINES = "pair_id bigint, seq int, type string, text string, old_no int, new_no int, status string"
PARTS = "array<struct<text:string,changed:boolean>>"


def consecutive_pairs(revisions: DataFrame, key, max_rows: int | None = None) -> DataFrame:
    """Each revision with the digest of the one before it inside ``key``; digests only, no texts."""
    keys = [key] if isinstance(key, str) else list(key)
    narrow = revisions.select(*keys, "ts", "rev_id", F.struct("rev_id", "sha1", "hidden").alias("me"))
    rows = Scan(narrow, keys, ["ts", "rev_id"], max_rows).lag("me", "before").result().filter(F.col("before").isNotNull())
    return rows.select(F.col("rev_id").alias("pair_id"), *keys,
                       F.col("before.rev_id").alias("old_rev"), F.col("before.sha1").alias("old_sha1"),
                       F.col("before.hidden").alias("old_hidden"),
                       F.col("me.rev_id").alias("new_rev"), F.col("me.sha1").alias("new_sha1"),
                       F.col("me.hidden").alias("new_hidden"))


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Fetch the texts by digest, late and only where they are needed.

    Hidden texts are not fetched, and of two equal texts only one is. Digests without a text match nothing, so they are
    spread over the tasks of the join."""
    def side(name):
        return texts.select(F.col("sha1").alias(f"{name}_key"), F.col("text").alias(f"{name}_fetched"))

    seen = {n: ~F.coalesce(F.col(f"{n}_hidden"), F.lit(False)) if f"{n}_hidden" in pairs.columns else F.lit(True) for n in ("old", "new")}
    same = seen["old"] & seen["new"] & F.coalesce(F.col("old_sha1") == F.col("new_sha1"), F.lit(False))
    keyed = pairs.withColumns({"old_key": F.when(seen["old"], F.col("old_sha1")), "new_key": F.when(seen["new"] & ~same, F.col("new_sha1"))})
    fetched = keyed.join(side("old"), "old_key", "left").join(side("new"), "new_key", "left")
    return fetched.select(*pairs.columns, F.col("old_fetched").alias("old_text"),
                          F.when(same, F.col("old_fetched")).otherwise(F.col("new_fetched")).alias("new_text"))


def diff_status(max_bytes: int | None = None) -> Column:
    """Why a pair is not compared, or OK. Set before the job, so one bad pair cannot fail a stage."""
    too_large = F.lit(False) if max_bytes is None else \
        (F.octet_length("old_text") > max_bytes) | (F.octet_length("new_text") > max_bytes)
    return (F.when(F.col("old_rev").isNull() | F.col("new_rev").isNull(), "NO_REVISION")
            .when(F.col("old_rev") == F.col("new_rev"), "SAME_REVISION")
            .when(F.col("old_text").isNull() | F.col("new_text").isNull(), "CONTENT_HIDDEN")
            .when(too_large, "TOO_LARGE").otherwise("OK"))


def diff_pairs(pairs: DataFrame, max_edits: int | None = None) -> DataFrame:
    """Line diff as rows (pair_id, seq, type, text, old_no, new_no, status); type is same, del or add.

    A pair without lines has one row that carries its status and no type: IDENTICAL (equal texts, with their number of
    lines in old_no and new_no), TOO_EXPENSIVE (more than ``max_edits`` edits), or the status it came with.
    """
    given = F.col("status") if "status" in pairs.columns else F.lit("OK")
    usable = F.col("old_text").isNotNull() & F.col("new_text").isNotNull()
    rows = pairs.select("pair_id", "old_text", "new_text", F.when((given == "OK") & ~usable, "CONTENT_HIDDEN").otherwise(given).alias("status"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size = [], 0
        for batch in batches:
            for pair, old, new, status in zip(batch["pair_id"], batch["old_text"], batch["new_text"], batch["status"], strict=True):
                if status != "OK":
                    out.append((pair, None, None, None, None, None, status))
                elif old == new:
                    n = len(split_lines(old))
                    out.append((pair, None, None, None, n, n, "IDENTICAL"))
                else:
                    out += _line_rows(int(pair), split_lines(old), split_lines(new), max_edits)
                    size += len(old) + len(new)
                if len(out) >= ROWS_PER_BATCH or size >= CHARS_PER_BATCH:
                    yield _frame(out)
                    out, size = [], 0
        if out:
            yield _frame(out)

    bound_batches(pairs.sparkSession)
    return rows.mapInPandas(compare, LINES)


#: Rows and characters that the comparison gathers before it hands them on.
ROWS_PER_BATCH, CHARS_PER_BATCH = 10_000, 4 << 20


def _line_rows(pair: int, old: list[str], new: list[str], max_edits: int | None) -> list[tuple]:
    script = shortest_edit(old, new, max_edits)
    if script is None:
        return [(pair, None, None, None, None, None, "TOO_EXPENSIVE")]
    rows, i, j = [], 0, 0
    for seq, step in enumerate(script):
        if step == "=":
            rows.append((pair, seq, "same", old[i], i + 1, j + 1, "OK"))
        elif step == "-":
            rows.append((pair, seq, "del", old[i], i + 1, None, "OK"))
        else:
            rows.append((pair, seq, "add", new[j], None, j + 1, "OK"))
        i += step != "+"
        j += step != "-"
    return rows


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["pair_id", "seq", "type", "text", "old_no", "new_no", "status"])
    return out.astype({"seq": "Int32", "old_no": "Int32", "new_no": "Int32"})


def diff_stats(lines: DataFrame) -> DataFrame:
    """One row per pair: its status, lines added and removed, lines of either text; counts are null where nothing
    was compared."""
    compared = F.col("status").isin("OK", "IDENTICAL")

    def total(no):  # a row without type holds the number of lines
        return F.when(compared, F.count(F.when(F.col("type").isNotNull(), F.col(no))) + F.coalesce(F.sum(F.when(F.col("type").isNull(), F.col(no))), F.lit(0)))

    return lines.groupBy("pair_id", "status").agg(
        F.when(compared, F.count_if(F.col("type") == "add")).alias("added"), F.when(compared, F.count_if(F.col("type") == "del")).alias("removed"),
        total("old_no").alias("old_lines"), total("new_no").alias("new_lines")) \
        .withColumn("identical", F.when(compared, (F.col("added") == 0) & (F.col("removed") == 0)))


def hunk_lines(lines: DataFrame, context: int = HUNK_CONTEXT) -> DataFrame:
    """Lines of the hunks, with ``hunk`` numbered from 1: ``context`` lines around each change, overlapping or
    touching windows merged. A pair without changes keeps one row without hunk. A pair's lines come from one row of
    the comparison, so they fit a task."""
    per_pair = Window.partitionBy("pair_id").orderBy("seq")
    from_end = Window.partitionBy("pair_id").orderBy(F.desc("seq"))
    change = F.when(F.col("type") != "same", F.col("seq"))
    nearest = lines.withColumns({
        "before": F.last(change, True).over(per_pair.rowsBetween(Window.unboundedPreceding, 0)),
        "after": F.last(change, True).over(from_end.rowsBetween(Window.unboundedPreceding, 0)),
        "nth": F.row_number().over(per_pair)})
    near = (F.col("seq") - F.col("before") <= context) | (F.col("after") - F.col("seq") <= context)
    # no change before or after: the pair has none; its first row stands for it
    bare = F.col("before").isNull() & F.col("after").isNull() & (F.col("nth") == 1)
    kept = nearest.filter(F.coalesce(near, F.lit(False)) | bare)
    blank = [F.when(bare, F.lit(None)).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name) if f.name not in ("pair_id", "status") else F.col(f.name)
             for f in lines.schema.fields]
    kept = kept.select(*blank, bare.alias("bare"))
    opens = F.coalesce(F.col("seq") - F.lag("seq").over(per_pair) > 1, F.lit(True)).cast("int")
    return (kept.withColumn("opens", opens).withColumn("hunk", F.when(~F.col("bare"), F.sum("opens").over(per_pair)))
            .drop("opens", "bare"))


def hunks(lines: DataFrame, context: int = HUNK_CONTEXT) -> DataFrame:
    """One row per hunk: old_start, new_start and its lines in order. A pair without hunks has one row without lines."""
    item = F.struct("seq", "type", "text", "old_no", "new_no")
    return (hunk_lines(lines, context).groupBy("pair_id", "hunk", "status").agg(
        F.min("old_no").alias("old_start"), F.min("new_no").alias("new_start"),
        F.array_sort(F.collect_list(F.when(F.col("seq").isNotNull(), item))).alias("lines")))


def _word_parts(old: pa.Array, new: pa.Array) -> pa.Array:
    offsets, texts, changed = ([0], [0]), ([], []), ([], [])
    for row in range(len(old)):
        a, b = old[row].as_py(), new[row].as_py()
        for k, parts in enumerate(([], []) if a is None or b is None else word_parts(a, b)):
            texts[k].extend(t for t, _ in parts)
            changed[k].extend(c for _, c in parts)
            offsets[k].append(len(texts[k]))
    sides = [pa.ListArray.from_arrays(pa.array(offsets[k], pa.int32()), pa.StructArray.from_arrays(
        [pa.array(texts[k], pa.string()), pa.array(changed[k], pa.bool_())], ["text", "changed"])) for k in range(2)]
    return pa.StructArray.from_arrays(sides, ["old", "new"])


def word_changes(lines: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Each run of deleted lines is paired one to one with the added lines after it, and both get word parts.

    Lines longer than ``max_chars``, if that is set, are listed without parts. A pair in which no lines are paired keeps
    one row with its status.
    """
    per_pair = Window.partitionBy("pair_id").orderBy("seq")
    # the first line of a pair stands for it, so that the comparison is read once
    runs = lines.withColumns({"run": F.sum((F.col("type") == "same").cast("int")).over(per_pair), "first": F.row_number().over(per_pair) == 1,
                              "kind": F.when(F.col("type") != "same", F.col("type"))}).filter(F.col("kind").isNotNull() | F.col("first"))
    nth = F.row_number().over(Window.partitionBy("pair_id", "run", "kind").orderBy("seq"))

    def pick(kind, column):
        return F.max(F.when(F.col("kind") == kind, F.col(column)))

    parts = F.arrow_udf(_word_parts, f"struct<old:{PARTS},new:{PARTS}>")
    sides = runs.withColumn("nth", nth).groupBy("pair_id", "run", "nth").agg(
        F.max("status").alias("status"), F.max("first").alias("first"),
        pick("del", "old_no").alias("old_no"), pick("add", "new_no").alias("new_no"),
        pick("del", "text").alias("old_line"), pick("add", "text").alias("new_line"))
    sides = sides.withColumn("both", F.col("old_line").isNotNull() & F.col("new_line").isNotNull())
    found = sides.withColumn("found", F.max("both").over(Window.partitionBy("pair_id"))).filter(F.col("both") | (F.col("first") & ~F.col("found")))
    compared = F.col("both")
    if max_chars is not None:
        compared &= (F.length("old_line") <= max_chars) & (F.length("new_line") <= max_chars)
    found = found.withColumns({f"{n}_line": F.when(compared, F.col(f"{n}_line")) for n in ("old", "new")})
    return found.withColumn("parts", parts("old_line", "new_line")).select("pair_id", "status", *[
        F.when(F.col("both"), F.col(c)).alias(n) for c, n in [("old_no", "old_no"), ("new_no", "new_no"), ("parts.old", "old_parts"), ("parts.new", "new_parts")]])


# Fixed value: where a sentence ends.
SENTENCE_END = rf'(?<=[.!?]){BLANK}+(?=[A-Z0-9"“(])'


def sentence_lines(texts: DataFrame, key: str) -> DataFrame:
    """(key, seq, line): paragraphs cut into sentences, trimmed, empty ones dropped."""
    cut = F.flatten(F.transform(F.split(F.regexp_replace("text", "\r", ""), "\n+"), lambda p: F.split(p, SENTENCE_END)))
    lines = F.filter(F.transform(cut, trimmed), lambda s: s != "")
    return texts.select(key, F.posexplode(lines).alias("seq", "line"))


def line_bag_delta(pairs: DataFrame) -> DataFrame:
    """Lines added and removed regardless of order: a cheap SQL form of the statistics for wide scans.

    Every pair keeps a row; the counts are null where a text is missing."""
    def side(column, sign):
        # one final line feed ends the last line; an empty text has no line
        lines = F.split(F.regexp_replace(column, r"\n\z", ""), "\n", -1)
        return (pairs.filter("old_text is not null and new_text is not null")
                .select("pair_id", F.explode(F.when(F.col(column) != "", lines)).alias("line"), F.lit(sign).alias("n")))

    per_line = (side("old_text", -1).unionByName(side("new_text", 1))
                .groupBy("pair_id", F.xxhash64("line").alias("h"), F.md5("line").alias("m")).agg(F.sum("n").alias("n")))
    totals = per_line.groupBy("pair_id").agg(
        F.sum(F.greatest("n", F.lit(0))).alias("added"), F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("removed"))
    known = pairs.select("pair_id", (F.col("old_text").isNotNull() & F.col("new_text").isNotNull()).alias("known"))
    return known.join(totals, "pair_id", "left").select("pair_id", *[
        F.when(F.col("known"), F.coalesce(c, F.lit(0))).alias(c) for c in ("added", "removed")])
