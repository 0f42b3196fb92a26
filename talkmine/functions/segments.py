"""Expressions over one episode's ordered array of ``struct<text, start, duration>``.

An episode arrives as one row, so everything here is map-only: nothing is shuffled and no
group can grow beyond its row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talkmine import fixed_values as fixed
from talkmine.functions.text import is_artifact, is_blank, let, space_count, word_count


def text_of(s: Column) -> Column:
    return F.coalesce(s["text"], F.lit(""))


def start_of(s: Column) -> Column:
    return F.coalesce(s["start"], F.lit(0.0))


def end_of(s: Column) -> Column:
    return start_of(s) + F.coalesce(s["duration"], F.lit(0.0))


def _sum(values: Column, zero: Column) -> Column:
    return F.aggregate(values, zero, lambda acc, v: acc + v)


def segment_count(segs: Column) -> Column:
    return F.when(segs.isNull(), 0).otherwise(F.size(segs)).cast("long")


def total_words(segs: Column) -> Column:
    counts = F.transform(segs, lambda s: word_count(text_of(s)))
    return F.coalesce(_sum(counts, F.lit(0).cast("long")), F.lit(0).cast("long"))


def artifact_count(
    segs: Column, markers: list[str] = fixed.LOAD_MARKERS, ignore_case: bool = True
) -> Column:
    hits = F.filter(segs, lambda s: is_artifact(s["text"], markers, ignore_case))
    return segment_count(hits)


def empty_count(segs: Column) -> Column:
    return segment_count(F.filter(segs, lambda s: is_blank(text_of(s))))


def covered_seconds(segs: Column) -> Column:
    """End of the last segment."""
    last = F.get(segs, F.size(segs) - 1)
    return F.when(segment_count(segs) > 0, end_of(last)).otherwise(F.lit(0.0))


def mean_length(segs: Column) -> Column:
    total = _sum(F.transform(segs, lambda s: F.coalesce(s["duration"], F.lit(0.0))), F.lit(0.0))
    return F.when(segment_count(segs) > 0, total / segment_count(segs)).otherwise(F.lit(0.0))


def has_gap(segs: Column, gap_sec: float) -> Column:
    """True when a segment starts more than ``gap_sec`` after the previous one ends."""
    wide = let(segs, lambda a: F.transform(
        a, lambda s, i: F.coalesce(start_of(s) - end_of(previous(a, i)) > gap_sec, F.lit(False)) & (i > 0)
    ))
    return F.coalesce(F.array_contains(wide, True), F.lit(False))


def previous(items: Column, i: Column) -> Column:
    """The element before position ``i``, NULL at the start."""
    return F.when(i > 0, F.get(items, i - 1))


def drop_repeats(segs: Column) -> Column:
    """Keep the first of each run of equal texts."""
    return let(segs, lambda a: F.filter(
        a, lambda s, i: (i == 0) | ~F.coalesce(previous(a, i)["text"].eqNullSafe(s["text"]), F.lit(False))
    ))


def strip_overlap(segs: Column) -> Column:
    """Drop from each text the prefix that is the whole previous text (rolling captions)."""

    def rest(s: Column, before: Column) -> Column:
        rolled = before.isNotNull() & (F.length(before) > 0) & s["text"].startswith(before)
        fresh = F.when(rolled, F.ltrim(F.substr(s["text"], F.length(before) + 1))).otherwise(s["text"])
        return F.struct(fresh.alias("text"), s["start"].alias("start"), s["duration"].alias("duration"))

    return let(segs, lambda a: F.transform(a, lambda s, i: rest(s, previous(a, i)["text"])))


def spoken(segs: Column) -> Column:
    """Segments with text and a start, sorted by start; ties keep their order."""
    kept = F.filter(
        F.transform(segs, lambda s, i: F.struct(
            s["start"].alias("start"), i.alias("pos"), s["text"].alias("text"),
            s["duration"].alias("duration"),
        )),
        lambda s: F.coalesce(F.trim(s["text"]) != "", F.lit(False)) & s["start"].isNotNull(),
    )
    return F.sort_array(kept)


def runs(items: Column, starts_run) -> Column:
    """Split a sorted array into consecutive runs; ``starts_run(item, previous)`` opens one."""

    def cut(a: Column) -> Column:
        opens = F.filter(
            F.transform(a, lambda s, i: F.when((i == 0) | starts_run(s, previous(a, i)), i)),
            lambda i: i.isNotNull(),
        )
        return let(opens, lambda o: F.transform(
            o, lambda first, j: F.slice(
                a, first + 1, F.coalesce(F.get(o, j + 1), F.size(a)) - first
            )
        ))

    return let(items, cut)


def window_groups(segs: Column, size: int, step: int) -> Column:
    """Arrays of ``struct<w, start, pos, text, duration>``, one per time window.

    Window ``w`` covers ``[w * step, w * step + size)``; with ``step == size`` windows are
    disjoint, otherwise a segment belongs to every window that contains its start.
    """

    def tagged(s: Column) -> Column:
        last = F.floor(s["start"] / step)
        first = last if step == size else F.greatest(
            F.floor((s["start"] - size) / step) + 1, F.lit(0).cast("long"))
        row = lambda w: F.struct(
            w.alias("w"), s["start"].alias("start"), s["pos"].alias("pos"),
            s["text"].alias("text"), s["duration"].alias("duration"))
        return row(last) if step == size else F.transform(F.sequence(first, last), row)

    spread = F.transform(spoken(segs), tagged)
    # With disjoint windows the order by start is already the order by window.
    ordered = spread if step == size else F.sort_array(F.flatten(spread))
    return runs(ordered, lambda s, p: s["w"] != p["w"])


def sentences(segs: Column, longest: int | None = None) -> Column:
    """Arrays of segments, each closed by a segment that ends in ``.``, ``!`` or ``?``.

    Captions often have no punctuation. With ``longest``, a sentence that goes on past a multiple
    of so many seconds is closed there if no mark ended one since the multiple before it.
    """
    found = runs(spoken(segs), lambda s, p: p["text"].rlike(r"[.!?]\s*$"))
    if longest is None:
        return found

    def window(s: Column) -> Column:
        return F.floor(s["start"] / longest)

    def split(sentence: Column) -> Column:
        begin = window(F.get(sentence, F.lit(0)))
        # the window a sentence begins in and the one after it are one piece
        return runs(sentence, lambda s, p: (window(s) != window(p)) & (window(s) > begin + 1))

    return F.flatten(F.transform(found, split))


def joined(group: Column) -> Column:
    return F.array_join(F.transform(group, lambda s: s["text"]), " ")


def first_start(group: Column) -> Column:
    return F.array_min(F.transform(group, lambda s: s["start"]))


def last_end(group: Column) -> Column:
    return F.array_max(F.transform(group, lambda s: s["start"] + s["duration"]))


def spaced_words(group: Column) -> Column:
    return _sum(F.transform(group, lambda s: space_count(s["text"])), F.lit(0).cast("long"))
