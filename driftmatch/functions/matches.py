"""Column functions over arrays of matches: ranking, overlap resolution, segments, splitting, stripping, replacing.

All are Catalyst expressions. Offsets are UTF-8 bytes, the end exclusive. A null array or text gives null.
An array that a search makes goes into a column of its own first: a Python function can't stand inside a lambda.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCH = "struct<pattern_index:int,pattern:string,start:bigint,end:bigint,similarity:float,insertions:smallint,deletions:smallint,substitutions:smallint,swaps:smallint,edits:smallint,text:string>"
SEGMENT = f"struct<matched:boolean,start:bigint,end:bigint,text:string,match:{MATCH}>"
_SPACE_START, _SPACE_END = r"^(?U)\s+", r"(?U)\s+\z"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def cut(text: Column, start: Column, end: Column) -> Column:
    """The text's bytes from start to end."""
    return F.substring(text.cast("binary"), (start + 1).cast("int"), (end - start).cast("int")).cast("string")


def rank(matches: Column | str, order: str = "default") -> Column:
    """In the order ``default``, ``greedy`` or ``coverage_weighted``; ``unsorted`` leaves them."""
    if order == "unsorted":
        return col(matches)

    def key(m: Column) -> Column:
        size, sim = F.octet_length(m["pattern"]), -m["similarity"]
        if order == "default":
            first = [sim, -size, -(m["end"] - m["start"])]
        elif order == "greedy":
            first = [-size, sim]
        elif order == "coverage_weighted":
            square = (m["similarity"] * m["similarity"]).cast("float")
            first = [-(square * size.cast("float")).cast("float"), sim]
        else:
            raise ValueError(f"no order {order!r}")
        return F.struct(*(x.alias(f"k{i}") for i, x in enumerate(first)), m["start"].alias("s"), m["end"].alias("e"), m["pattern_index"].alias("p"), m.alias("m"))

    return F.transform(F.array_sort(F.transform(col(matches), key)), lambda x: x["m"])


def conflict(a: Column, m: Column) -> Column:
    """Whether an accepted match ``a`` keeps ``m`` out; an empty match at the start of an accepted one does not conflict."""
    return ((a["start"] < m["start"]) & (a["end"] > m["start"])) | ((a["start"] >= m["start"]) & (a["start"] < m["end"]))


def resolve(matches: Column | str, overlap: str = "non_overlapping", unique_ids: Sequence[int] | None = None) -> Column:
    """Accepts matches in their present order where they overlap none accepted; sorted by start.

    ``non_overlapping_unique`` also accepts one match for each id; ``unique_ids`` holds the patterns' ids (their indexes
    unless given).
    """
    if overlap == "keep":
        return col(matches)
    uid = (lambda m: F.element_at(F.array(*map(F.lit, unique_ids)), m["pattern_index"] + 1)) if unique_ids else (lambda m: m["pattern_index"])

    def clash(a: Column, m: Column) -> Column:
        return conflict(a, m) | (uid(a) == uid(m)) if overlap == "non_overlapping_unique" else conflict(a, m)

    kept = F.aggregate(col(matches), F.array().cast(f"array<{MATCH}>"), lambda acc, m: F.when(F.exists(acc, lambda a: clash(a, m)), acc).otherwise(F.concat(acc, F.array(m.cast(MATCH)))))
    ordered = F.array_sort(F.transform(kept, lambda m, i: F.struct(m["start"].alias("s"), m["end"].alias("e"), i.alias("i"), m.alias("m"))))
    return F.when(col(matches).isNotNull(), F.transform(ordered, lambda x: x["m"]))


def filter_matches(matches: Column | str, keep: Callable[[Column], Column]) -> Column:
    return F.filter(col(matches), keep)


retain = filter_matches


def matched_spans(matches: Column | str) -> Column:
    return F.transform(col(matches), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))


def matched_strings(matches: Column | str) -> Column:
    return F.transform(col(matches), lambda m: m["text"])


def count(matches: Column | str) -> Column:
    return F.size(col(matches))


def is_empty(matches: Column | str) -> Column:
    return F.size(col(matches)) == 0


def in_order(matches: Column | str) -> Column:
    """Without the matches that start before the end of one kept earlier: what a walk over the text takes."""
    s = lambda last, out: F.struct(last.cast("bigint").alias("last"), out.alias("out"))
    none = F.array().cast(f"array<{MATCH}>")
    return F.aggregate(col(matches), s(F.lit(0), none), lambda acc, m: F.when(m["start"] < acc["last"], acc).otherwise(s(m["end"], F.concat(acc["out"], F.array(m.cast(MATCH))))), lambda acc: acc["out"])


def _before(kept: Column, i: Column) -> Column:
    return F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get(kept, i - 1)["end"])


def _gap(text: Column, start: Column, end: Column) -> Column:
    return F.struct(F.lit(False).alias("matched"), start.alias("start"), end.alias("end"), cut(text, start, end).alias("text"), F.lit(None).cast(MATCH).alias("match")).cast(SEGMENT)


def segments(text: Column | str, matches: Column | str, resolved: bool = False) -> Column:
    """Matches and the gaps between them, in order; gaps are not empty. ``resolved``: they are known not to overlap."""
    t = col(text)
    kept = col(matches) if resolved else in_order(matches)
    size = F.octet_length(t).cast("bigint")
    both = F.transform(kept, lambda m, i: F.array(_gap(t, _before(kept, i), m["start"]), F.struct(F.lit(True).alias("matched"), m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), m.alias("match")).cast(SEGMENT)))
    last = F.coalesce(F.try_element_at(kept, F.lit(-1))["end"], F.lit(0).cast("bigint"))
    return F.when(kept.isNotNull(), F.filter(F.concat(F.flatten(both), F.array(_gap(t, last, size))), lambda s: s["matched"] | (s["end"] > s["start"])))


def segment_text_of(segs: Column | str) -> Column:
    s = lambda out, prev: F.struct(out.alias("out"), prev.alias("prev"))

    def step(acc: Column, x: Column) -> Column:
        out = acc["out"]
        spaced = F.when(x["matched"], acc["prev"] | ((out != "") & ~out.rlike(r"[ \t]\z"))).otherwise(acc["prev"] & ~x["text"].rlike(r"\A[,.?!;:—\-…]"))
        return s(F.concat(out, F.when(spaced, F.lit(" ")).otherwise(F.lit("")), x["text"]), x["matched"])

    return F.aggregate(col(segs), s(F.lit(""), F.lit(False)), step, lambda acc: acc["out"])


def split_of(segs: Column | str) -> Column:
    return F.transform(F.filter(col(segs), lambda s: ~s["matched"]), lambda s: s["text"])


def _blank(s: Column) -> Column:
    return F.regexp_replace(s["text"], _SPACE_START, "") == ""


def strip_prefix_of(segs: Column | str) -> Column:
    s = lambda skipping, out: F.struct(skipping.alias("skipping"), out.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        first = F.when(x["matched"] | _blank(x), acc).otherwise(s(F.lit(False), F.regexp_replace(x["text"], _SPACE_START, "")))
        return F.when(acc["skipping"], first).otherwise(s(F.lit(False), F.concat(acc["out"], x["text"])))

    return F.aggregate(col(segs), s(F.lit(True), F.lit("")), step, lambda acc: acc["out"])


def strip_suffix_of(segs: Column | str) -> Column:
    keep = F.aggregate(F.transform(col(segs), lambda x, i: F.when(~x["matched"] & ~_blank(x), i + 1).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
    return F.transform(F.array(keep), lambda n: F.array_join(F.transform(F.slice(col(segs), F.lit(1), n), lambda x, i: F.when(i + 1 == n, F.regexp_replace(x["text"], _SPACE_END, "")).otherwise(x["text"])), ""))[0]


def replace_matches(text: Column | str, matches: Column | str, callback: Callable[[Column], Column], resolved: bool = False) -> Column:
    """The text with each match replaced by ``callback(match)``; a null keeps the match's own text."""
    t = col(text)
    kept = col(matches) if resolved else in_order(matches)
    size = F.octet_length(t).cast("bigint")
    parts = F.transform(kept, lambda m, i: F.concat(cut(t, _before(kept, i), m["start"]), F.coalesce(callback(m).cast("string"), m["text"])))
    last = F.coalesce(F.try_element_at(kept, F.lit(-1))["end"], F.lit(0).cast("bigint"))
    return F.when(kept.isNotNull(), F.concat(F.array_join(parts, ""), cut(t, last, size)))
