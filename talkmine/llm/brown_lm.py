"""Scoring texts with a class-based bigram model, its classes found by exchange.

The most frequent words are put into classes that an exchange algorithm improves: each word moves
to the class that makes the class bigrams of the corpus likeliest. Then every other word that was
seen more than once goes to the class that the same likelihood gains most by. Only words seen once
or never belong to a class by their length. A token has the probability of its class after the class
before it, times that of the word in its class. All counts come from all training texts.

Tasks hold the classes of frequent words. Occurrences of the others meet by word, where they are
counted and their class is chosen, and then by text, where they meet the classes beside them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmine.llm.langid import fold
from talkmine.llm.text import SLICE_BYTES, Words, slices
from talkmine.session import cut_lineage

#: words that exchange puts into classes, classes for them, classes of words seen once or never by length
CLASS_WORDS, CLASSES, LENGTHS = 1024, 64, 12
#: steps in which counts double
_STEPS = 64
#: frequent words whose counts and classes every task holds; those of the others are shuffled
FREQUENT = 65_536
ROUNDS = 6
#: entries of rare words that meet in one task
RARE_PER_TASK = 500_000
#: words whose gains are computed at once
_ASSIGNED = 64
#: stands for the end of a text
END = np.int64(-1)
_SLICE = 4 * SLICE_BYTES


def _tokens(column: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words, their hashes as signed numbers (never END), and the class of each by length."""
    words = Words(column, spans=True)
    h = words.hash.view(np.int64)
    h = np.where(h == END, np.int64(0), h)
    return words, h, np.minimum(words.end - words.start, LENGTHS) - 1


def word_counts(training: DataFrame) -> DataFrame:
    """(word, length, n) of all tokens of the training texts; END has length -1."""

    def count(batches):
        for batch in batches:
            text = batch.column("text")
            seen, lengths, n = [], [], []
            for a, b in slices(text, _SLICE):
                _, h, length = _tokens(text.slice(a, b - a))
                word, at, times = np.unique(h, return_index=True, return_counts=True)
                seen.append(word)
                lengths.append(length[at])
                n.append(times)
            seen = np.concatenate([*seen, [END]]).astype(np.int64)
            word, first, at = np.unique(seen, return_index=True, return_inverse=True)
            n = np.bincount(at, np.concatenate([*n, [len(text)]])).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(word), pa.array(np.concatenate([*lengths, [-1]])[first].astype(np.int32)), pa.array(n)],
                names=["word", "length", "n"])

    return training.select("text").mapInArrow(count, "word long, length int, n long").groupBy("word").agg(
        F.first("length").alias("length"), F.sum("n").alias("n"))


class _Units:
    """Numbers of tokens in the bigram table: class words first, then END, then lengths."""

    def __init__(self, words: np.ndarray) -> None:
        self.order = np.argsort(words)
        self.words = words[self.order]
        self.n = len(words)
        self.end = self.n
        self.size = self.n + 1 + LENGTHS

    def of(self, h: np.ndarray, length: np.ndarray) -> np.ndarray:
        unit = self.n + 1 + length
        if self.n:
            at = np.minimum(np.searchsorted(self.words, h), self.n - 1)
            unit = np.where(self.words[at] == h, self.order[at], unit)
        return unit

    def sequence(self, words: Words, h: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _sequence(words, self.of(h, length), self.end)


def _sequence(words: Words, units: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of all tokens and of those before them, with text numbers; a text starts after an end."""
    place = np.arange(len(units)) + words.doc
    n = len(units) + words.n_docs
    unit = np.full(n, end, dtype=np.int64)
    unit[place] = units
    doc = np.zeros(n, dtype=np.int64)
    doc[place] = words.doc
    doc[words.first[1:] + np.arange(words.n_docs)] = np.arange(words.n_docs)
    return unit, np.r_[end, unit[:-1]], doc


def bigram_counts(training: DataFrame, units: _Units) -> np.ndarray:
    """How often unit v follows unit u in the training texts, as a table of fixed size.

    A task adds up its texts in a table of its own; rows of all tables are added by unit.
    """

    def count(batches):
        table = np.zeros(units.size ** 2, dtype=np.int64)
        for batch in batches:
            text = batch.column("text")
            for a, b in slices(text, _SLICE):
                unit, before, _ = units.sequence(*_tokens(text.slice(a, b - a)))
                table += np.bincount(before * units.size + unit, minlength=units.size ** 2)
        table = table.reshape(units.size, units.size)
        at = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(list(table[at]), pa.list_(pa.int64()))],
                                         names=["unit", "row"])

    def add(batches):
        rows: dict[int, np.ndarray] = {}
        for batch in batches:
            for unit, row in zip(batch.column("unit").to_pylist(), batch.column("row")):
                rows[unit] = rows.get(unit, 0) + row.values.to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), pa.array(list(rows.values()), pa.list_(pa.int64()))],
                                         names=["unit", "row"])

    schema = "unit int, row array<long>"
    found = training.select("text").mapInArrow(count, schema).repartition("unit").mapInArrow(add, schema).toArrow()
    out = np.zeros((units.size, units.size))
    for unit, row in zip(found.column("unit").to_pylist(), found.column("row")):
        out[unit] += row.values.to_numpy()
    return out


def _gain(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, n_words: int, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each unit. Words move among ``classes``; the other units keep one of their own.

    A move is judged by the sum of n * log n over class bigrams less that over classes as left
    and as right side, which is the log likelihood up to a constant.
    """
    classes = min(classes, max(1, n_words))
    size = len(bigrams)
    own = np.r_[np.arange(n_words) % classes, classes + np.arange(size - n_words)]
    total = classes + size - n_words
    member = np.zeros((size, total))
    member[np.arange(size), own] = 1
    table = member.T @ bigrams @ member

    gain = _gain
    for _ in range(rounds):
        moved = 0
        for w in range(n_words):
            old = own[w]
            after = np.bincount(own, bigrams[w], minlength=total)
            before = np.bincount(own, bigrams[:, w], minlength=total)
            itself = bigrams[w, w]
            after[old] -= itself
            before[old] -= itself
            table[old] -= after
            table[:, old] -= before
            table[old, old] -= itself
            c = np.arange(classes)
            rows = gain(table[:classes] + after) - gain(table[:classes])
            columns = gain(table[:, :classes] + before[:, None]) - gain(table[:, :classes])
            both = table[c, c]
            value = rows.sum(axis=1) - rows[c, c] + columns.sum(axis=0) - columns[c, c] + gain(
                both + after[c] + before[c] + itself) - gain(both)
            left, right = table.sum(axis=1)[:classes], table.sum(axis=0)[:classes]
            out, came = after.sum() + itself, before.sum() + itself
            value -= gain(left + out) - gain(left) + gain(right + came) - gain(right)
            best = int(np.argmax(value))
            if value[best] <= value[old] + 1e-9:
                best = old
            moved += best != old
            own[w] = best
            table[best] += after
            table[:, best] += before
            table[best, best] += itself
        if not moved:
            break
    return own


def assign(table: np.ndarray, classes: int, own: np.ndarray, before: np.ndarray, after: np.ndarray,
           itself: np.ndarray) -> np.ndarray:
    """Class below ``classes`` that each of several words gains most by, all judged by the same table.

    ``table`` counts class bigrams with word i in class ``own[i]``, none of the first ``classes``. Rows
    of ``before`` and ``after`` say how often tokens of each class stand beside the word, ``itself``
    how often it follows itself, which both hold at ``own``. A move is judged as in ``exchange``.
    """
    out = np.zeros(len(own), dtype=np.int64)
    c = np.arange(classes)
    left, right = table.sum(axis=1)[:classes], table.sum(axis=0)[:classes]
    both = table[c, c]
    for a in range(0, len(own), _ASSIGNED):
        old, alone = own[a:a + _ASSIGNED], itself[a:a + _ASSIGNED].astype(float)
        w = np.arange(len(old))
        came, out_of = before[a:a + _ASSIGNED].astype(float), after[a:a + _ASSIGNED].astype(float)
        came[w, old] -= alone
        out_of[w, old] -= alone
        value = np.zeros((len(old), classes))
        for beside, opposite, cells in ((out_of, came, table[:classes]), (came, out_of, table[:, :classes].T)):
            # only what stands beside a word changes cells; those at its own class are without the word
            word, at = np.nonzero(beside)
            without = cells.T[at]
            mine = at == old[word]
            without[mine] -= opposite[word[mine], :classes]
            more = _gain(without + beside[word, at][:, None]) - _gain(without)
            more[np.flatnonzero(at < classes), at[at < classes]] = 0
            if len(word):
                has, head = np.unique(word, return_index=True)
                value[has] += np.add.reduceat(more, head, axis=0)
        value += _gain(both + out_of[:, :classes] + came[:, :classes] + alone[:, None]) - _gain(both)
        for side, n in ((left, out_of), (right, came)):
            value -= _gain(side + (n.sum(axis=1) + alone)[:, None]) - _gain(side)
        out[a:a + _ASSIGNED] = value.argmax(axis=1)
    return out


def _frequent_from(counts: DataFrame, most: int) -> int:
    """Least step of the logarithm of a count such that at most ``most`` words reach it."""
    steps = counts.groupBy(F.floor(F.log2("n") * _STEPS).alias("step")).agg(F.count("*").alias("words")).toPandas()
    steps = steps.sort_values("step", ascending=False)
    enough = steps[steps["words"].cumsum() <= most]
    return int(enough["step"].min()) if len(enough) else 1 << 20


def _neighbours(training: DataFrame, box, parts: int) -> DataFrame:
    """How often what stands beside the open words: their numbers times the width of a row of counts
    plus the place in it (classes before, classes after, the word itself), packed by word."""

    def count(batches):
        m = box.value
        k, n_open = m["k"], int(m["open"].max(initial=-1)) + 1
        width = 2 * k + 1
        found = np.zeros(n_open * width, dtype=np.int32)
        for batch in batches:
            text = batch.column("text")
            for a, b in slices(text, _SLICE):
                words, h, length = _tokens(text.slice(a, b - a))
                at, known = _place(h, m["words"])
                if not len(m["words"]):
                    continue
                unit, before, _ = _sequence(words, _class_of(at, known, length, m), m["end"])
                word = np.where(known, m["open"][at], -1)
                mine = np.flatnonzero(word >= 0)
                place = mine + words.doc[mine]
                follows = mine[np.r_[False, (h[1:] == h[:-1]) & (words.doc[1:] == words.doc[:-1])][mine]]
                entry, n = np.unique(np.concatenate([
                    word[mine] * width + before[place], word[mine] * width + k + unit[place + 1],
                    word[follows] * width + 2 * k]), return_counts=True)
                found[entry] += n.astype(np.int32)
        entry = np.flatnonzero(found)
        place = entry // width * parts // max(n_open, 1)
        full = np.unique(place)
        cut = pa.array(np.r_[np.searchsorted(place, full), len(place)], pa.int32())
        yield pa.RecordBatch.from_arrays([
            pa.array(full, pa.int32()), pa.ListArray.from_arrays(cut, pa.array(entry)),
            pa.ListArray.from_arrays(cut, pa.array(found[entry]))], names=["place", "entries", "n"])

    return training.select("text").mapInArrow(count, "place int, entries array<long>, n array<int>")


def _choose(box, table: np.ndarray):
    """Classes of open words from all that stands beside them."""

    def compute(found: pa.Table) -> pa.Table:
        m = box.value
        k = m["k"]
        width = 2 * k + 1
        entry, at = np.unique(_flat(found, "entries"), return_inverse=True)
        n = np.bincount(at, _flat(found, "n"))
        word, at = np.unique(entry // width, return_inverse=True)
        own = m["class"][np.flatnonzero(m["open"] >= 0)[word]]
        chosen = np.zeros(len(word), dtype=np.int64)
        for a in range(0, len(word), _ASSIGNED):
            some = slice(*np.searchsorted(at, [a, a + _ASSIGNED]))
            rows = np.bincount((at[some] - a) * width + entry[some] % width, n[some],
                               minlength=_ASSIGNED * width).reshape(-1, width)[:len(word) - a]
            chosen[a:a + _ASSIGNED] = assign(table, m["classes"], own[a:a + _ASSIGNED], rows[:, :k], rows[:, k:2 * k], rows[:, -1])
        return pa.Table.from_arrays([pa.array(word), pa.array(chosen)], names=["word", "class"])

    return compute


def _class_counts(training: DataFrame, box) -> np.ndarray:
    """Class bigrams of the training texts, two tables: those without rare words, and all, with rare
    words in the classes of their lengths."""

    def count(batches):
        m = box.value
        k = m["k"]
        found = np.zeros(2 * k * k, dtype=np.int64)
        for batch in batches:
            text = batch.column("text")
            for a, b in slices(text, _SLICE):
                words, h, length = _tokens(text.slice(a, b - a))
                at, known = _place(h, m["words"])
                unit, before, _ = _sequence(words, _class_of(at, known, length, m), m["end"])
                rare, rare_before, _ = _sequence(words, ~known, 0)
                found += np.bincount(before * k + unit + np.where(rare | rare_before, k * k, 0), minlength=2 * k * k)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(found[at])], names=["at", "n"])

    k = box.value["k"]
    found = _collected(training.select("text").mapInArrow(count, "at int, n long"), 2 * k * k).reshape(2, k, k)
    return np.stack([found[0], found.sum(axis=0)])


def _collected(counts: DataFrame, size: int) -> np.ndarray:
    """Sums of (at, n) as an array of fixed size."""
    found = counts.groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size)
    out[found["at"].to_numpy(dtype=np.int64)] = found["n"]
    return out


def train(training: DataFrame) -> dict:
    """Model of the texts of ``training``, all in bounded arrays: counts and classes of the frequent
    words, and class bigrams. Rare words get their classes where their occurrences meet."""
    spark = training.sparkSession
    counts = cut_lineage(word_counts(training))
    totals = counts.agg(F.sum("n"), F.count("*")).first()
    most = counts.filter(F.floor(F.log2("n") * _STEPS) >= _frequent_from(counts, FREQUENT)).toPandas()
    most = most.sort_values(["n", "word"], ascending=[False, True])
    of_words = most[most["word"] != END]
    chosen = of_words[:CLASS_WORDS]
    units = _Units(chosen["word"].to_numpy(dtype=np.int64))
    bigrams = bigram_counts(training, units)
    own = exchange(bigrams, units.n)
    k = int(own.max()) + 1
    classes = k - 1 - LENGTHS
    member = np.zeros((units.size, k))
    member[np.arange(units.size), own] = 1
    # words seen once that aren't class words, by length; each is one token
    lengths = counts.filter("length >= 0 and n = 1").groupBy("length").agg(F.count("*").alias("n")).toPandas()
    once = np.zeros(LENGTHS)
    once[lengths["length"]] = lengths["n"]
    np.subtract.at(once, chosen["length"].to_numpy(dtype=int)[chosen["n"].to_numpy() == 1], 1)
    known = most.sort_values("word")
    word = known["word"].to_numpy(dtype=np.int64)
    n = known["n"].to_numpy(dtype=np.int64)
    class_of = classes + 1 + known["length"].to_numpy(dtype=np.int64)  # END has length -1
    class_of[np.searchsorted(word, units.words)] = own[units.order]
    undecided = (class_of > classes) & (n > 1)
    numbers = np.where(undecided, np.cumsum(undecided) - 1, -1)
    n_end = int(most.loc[most["word"] == END, "n"].sum()) if len(most) else 0
    if not n_end and totals[0]:
        n_end = int(counts.filter(F.col("word") == int(END)).agg(F.sum("n")).first()[0] or 0)
    model = {"words": word, "counts": n, "class": class_of, "open": numbers, "k": k, "classes": classes, "end": classes,
             "once": once, "n": int(totals[0] or 0), "v": int(totals[1]), "n_end": n_end,
             "n_rare": int((totals[0] or 0) - most["n"].sum())}
    if undecided.any():
        box = spark.sparkContext.broadcast(model)
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        decided = _neighbours(training, box, parts).groupBy("place").applyInArrow(
            _choose(box, member.T @ bigrams @ member), "word long, class long").toPandas()
        model = {**model, "class": class_of.copy()}
        model["class"][np.flatnonzero(undecided)[decided["word"].to_numpy(dtype=np.int64)]] = decided["class"]
    model["known_table"], model["table"] = _class_counts(training, spark.sparkContext.broadcast(model))
    return model


def _place(h: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where hashes are among frequent words, and whether they are there."""
    if not len(words):
        return np.zeros(len(h), dtype=np.int64), np.zeros(len(h), dtype=bool)
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    return at, words[at] == h


def _class_of(at: np.ndarray, known: np.ndarray, length: np.ndarray, model: dict) -> np.ndarray:
    """Classes of tokens, of rare ones those of their lengths."""
    by_length = model["end"] + 1 + length
    return np.where(known, model["class"][at], by_length) if len(model["words"]) else by_length


def _seen(n: np.ndarray, own: np.ndarray, classes: int) -> np.ndarray:
    """Logarithms of counts in the classes: one more for words seen once or never."""
    return np.log10(n + (own >= classes))


def _scored_but_rare(docs: DataFrame, box) -> DataFrame:
    """Per row what its tokens give, but for those of rare words and the steps to and from them."""

    def compute(batches):
        m = box.value
        below, k = np.log10(m["n"] + m["v"] + 1), m["k"]
        for batch in batches:
            text = batch.column("text")
            for a, b in slices(text, _SLICE):
                n = b - a
                words, h, length = _tokens(text.slice(a, n))
                at, known = _place(h, m["words"])
                own = _class_of(at, known, length, m)
                unit, before, doc = _sequence(words, own, m["end"])
                rare, rare_before, _ = _sequence(words, ~known, 0)
                size = np.bincount(doc, minlength=n)
                c = np.where(known, m["counts"][at], 0) if len(m["words"]) else np.zeros(len(h))
                base = np.bincount(words.doc, np.log10(c + 1.0), minlength=n) + np.log10(m["n_end"] + 1.0) - size * below
                n_known = np.bincount(words.doc, c > 0, minlength=n) + (m["n_end"] > 0)
                step = np.where(rare | rare_before, 0, m["follows"][before * k + unit]) + np.where(rare, 0, m["emits"][unit])
                score = np.bincount(doc, step, minlength=n) + np.bincount(
                    words.doc[known], _seen(c[known], own[known], m["classes"]), minlength=n)
                yield pa.RecordBatch.from_arrays([
                    batch.column("key").slice(a, n), batch.column("doc_id").slice(a, n),
                    batch.column("held_out").slice(a, n), pa.array(size.astype(np.int64)),
                    pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(score)],
                    names=["key", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return docs.mapInArrow(compute, "key long, doc_id long, held_out boolean, n_tokens long, n_known long, "
                                    "base_score double, score double")


def _packed(place: np.ndarray, columns: dict[str, np.ndarray]) -> list[pa.Array]:
    """Columns in ascending order of place as one list for each place, after the places."""
    full = np.unique(place)
    cut = pa.array(np.r_[np.searchsorted(place, full), len(place)], pa.int32())
    return [pa.array(full, pa.int32()), *[pa.ListArray.from_arrays(cut, pa.array(c)) for c in columns.values()]]


def _rare_words(docs: DataFrame, box, places: int) -> DataFrame:
    """Occurrences of rare words packed by the place where those of a word meet: rows' keys, places
    in the text, and in one number the classes before and after, the length, and whether the row trains."""

    def compute(batches):
        m = box.value
        for batch in batches:
            text = batch.column("text")
            keys = batch.column("key").to_numpy()
            trains = ~batch.column("held_out").to_numpy(zero_copy_only=False)
            for a, b in slices(text, _SLICE):
                words, h, length = _tokens(text.slice(a, b - a))
                at, known = _place(h, m["words"])
                unit, before, _ = _sequence(words, _class_of(at, known, length, m), m["end"])
                rare = np.flatnonzero(~known)
                if not len(rare):
                    continue
                doc = words.doc[rare]
                beside = before[rare + doc] | unit[rare + doc + 1] << 8 | length[rare] << 16 | trains[a:b][doc].astype(np.int64) << 24
                place = (h[rare].view(np.uint64) % np.uint64(places)).astype(np.int64)
                order = np.argsort(place, kind="stable")
                yield pa.RecordBatch.from_arrays(_packed(place[order], {
                    "words": h[rare][order], "keys": keys[a:b][doc][order],
                    "at": (rare - words.first[doc])[order].astype(np.int32), "beside": beside[order].astype(np.int32)}),
                    names=["place", "words", "keys", "at", "beside"])

    return docs.select("text", "key", "held_out").mapInArrow(
        compute, "place int, words array<long>, keys array<long>, at array<int>, beside array<int>")


def _flat(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name).combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False)


def _decide_rare(places: int, box):
    """All occurrences of some rare words: their counts and classes, packed by the rows' place."""

    def compute(found: pa.Table) -> pa.Table:
        m = box.value
        k, classes = m["k"], m["classes"]
        word, key, at, beside = (_flat(found, c) for c in ("words", "keys", "at", "beside"))
        order = np.lexsort((at, key, word))
        word, key, at, beside = word[order], key[order], at[order], beside[order]
        # rows that repeat with the same id and text share a key: their tokens stay once, with a number
        head = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (key[1:] != key[:-1]) | (at[1:] != at[:-1])])
        n = np.diff(np.r_[head, len(word)])
        word, key, at, beside = word[head], key[head], at[head], beside[head]
        before, after, length, trains = beside & 255, beside >> 8 & 255, beside >> 16 & 255, beside >> 24
        counted = n * trains
        again = np.r_[False, (word[1:] == word[:-1]) & (key[1:] == key[:-1]) & (at[1:] == at[:-1] + 1)] * counted
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        which = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(word)]))
        c = np.bincount(which, counted)
        own = (classes + 1 + length[first]).astype(np.int64)
        several = np.flatnonzero(c > 1)
        number = np.full(len(first), -1)
        number[several] = np.arange(len(several))
        mine = np.flatnonzero(number[which] >= 0)
        number = number[which[mine]]
        for a in range(0, len(several), _ASSIGNED):
            to = min(a + _ASSIGNED, len(several))
            lo, hi = np.searchsorted(number, [a, to])
            some, of = mine[lo:hi], number[lo:hi] - a
            rows = [np.bincount(of * k + side[some], counted[some], minlength=(to - a) * k).reshape(-1, k) for side in (before, after)]
            own[several[a:to]] = assign(m["table"], classes, own[several[a:to]], *rows,
                                        np.bincount(of, again[some], minlength=to - a))
        place = (key.view(np.uint64) % np.uint64(places)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        beside = before | after << 8 | own[which] << 16 | trains << 24
        return pa.Table.from_arrays(_packed(place[order], {
            "keys": key[order], "at": at[order], "beside": beside[order].astype(np.int32),
            "counts": c[which][order].astype(np.int32), "rows": n[order].astype(np.int32)}),
            names=["place", "keys", "at", "beside", "counts", "rows"])

    return compute


def _beside_rare(box):
    """Rare words of some texts in order: per text how many were seen in training, their logarithms
    for the base and in their classes, the steps to and from them, and in how many rows it trains."""

    def compute(found: pa.Table) -> pa.Table:
        k, classes = box.value["k"], box.value["classes"]
        key, at, beside, c, rows = (_flat(found, x) for x in ("keys", "at", "beside", "counts", "rows"))
        order = np.lexsort((at, key))
        key, at, beside, c, rows = key[order], at[order], beside[order].astype(np.int64), c[order], rows[order]
        before, after, own = beside & 255, beside >> 8 & 255, beside >> 16 & 255
        joined = (key[1:] == key[:-1]) & (at[1:] == at[:-1] + 1)
        before[1:] = np.where(joined, own[:-1], before[1:])
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        alone = np.flatnonzero(~np.r_[joined, False])  # before a token that isn't rare
        to = pa.array(np.r_[head, len(key)], pa.int32())
        since = pa.array(np.r_[np.searchsorted(alone, head), len(alone)], pa.int32())
        return pa.Table.from_arrays([
            pa.array(key[head]), pa.array(np.add.reduceat((c > 0).astype(np.int64), head)),
            pa.array(np.add.reduceat(np.log10(c + 1.0), head)), pa.array(np.add.reduceat(_seen(c.astype(float), own, classes), head)),
            pa.ListArray.from_arrays(to, pa.array((before * k + own).astype(np.int16))),
            pa.ListArray.from_arrays(since, pa.array((own * k + after)[alone].astype(np.int16))),
            pa.array((rows * (beside >> 24))[head].astype(np.int64))],
            names=["key", "rare_known", "rare_base", "rare_score", "into", "out", "trained"])

    return compute


def _rare_steps(added: DataFrame, k: int) -> np.ndarray:
    """Class bigrams of the training texts to and from rare words."""

    def count(batches):
        found = np.zeros(k * k)
        for batch in batches:
            for name in ("into", "out"):
                steps = batch.column(name)
                n = np.repeat(batch.column("trained").to_numpy(), np.diff(steps.offsets.to_numpy()))
                found += np.bincount(steps.flatten().to_numpy(), n, minlength=k * k)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(found[at].astype(np.int64))], names=["at", "n"])

    return _collected(added.filter("trained > 0").select("into", "out", "trained").mapInArrow(count, "at int, n long"), k * k)


def _add_rare(added: DataFrame, box) -> DataFrame:
    """What rare words add to the scores of each text."""

    def compute(batches):
        m = box.value
        for batch in batches:
            score = batch.column("rare_score").to_numpy().copy()
            for name in ("into", "out"):
                steps = batch.column(name)
                step = steps.flatten().to_numpy().astype(np.int64)
                row = np.repeat(np.arange(batch.num_rows), np.diff(steps.offsets.to_numpy()))
                value = m["follows"][step] + (m["emits"][step % m["k"]] if name == "into" else 0)
                score += np.bincount(row, value, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("rare_known"), batch.column("rare_base"),
                                              pa.array(score)], names=["key", "rare_known", "rare_base", "rare_score"])

    return added.select("key", "rare_known", "rare_base", "rare_score", "into", "out").mapInArrow(
        compute, "key long, rare_known long, rare_base double, rare_score double")


def _with_probabilities(model: dict, table: np.ndarray) -> dict:
    """The model with the logarithms of steps between classes, and of a word in its class but for its count."""
    k, classes = model["k"], model["classes"]
    prior = (table.sum(axis=0) + 1) / (table.sum() + k)
    follows = (table + prior) / (table.sum(axis=1, keepdims=True) + 1)
    emits = np.zeros(k)  # of an end 1
    emits[:classes] = -np.log10(np.maximum(table.sum(axis=0)[:classes], 1))
    emits[classes + 1:] = -np.log10(2 * model["once"] + 1)
    return {**model, "follows": np.log10(follows).ravel(), "emits": emits}


def score(docs: DataFrame, parts: int = 7, held: int = 2, model: dict | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every
    row of ``docs`` (doc_id, text), learning from those outside the held-out fold.

    Tokens are words, A to Z in lower case, and one end; a null text is only an end. Rows that
    repeat an id and a text get the same scores each. With nothing to learn from, counts are 0
    and every token has base probability 1. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"),
                       (fold(F.col("doc_id"), parts) == held).alias("held_out"))
    model = model or train(docs.filter("not held_out"))
    box = spark.sparkContext.broadcast(model)
    places = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-model["n_rare"] * parts // (parts - 1) // RARE_PER_TASK))
    added = _rare_words(docs, box, places).groupBy("place").applyInArrow(
        _decide_rare(places, box), "place int, keys array<long>, at array<int>, beside array<int>, counts array<int>, rows array<int>")
    added = cut_lineage(added.groupBy("place").applyInArrow(
        _beside_rare(box), "key long, rare_known long, rare_base double, rare_score double, into array<short>, "
                           "out array<short>, trained long"))
    table = model["known_table"] + _rare_steps(added, model["k"]).reshape(model["k"], -1)
    box = spark.sparkContext.broadcast(_with_probabilities(model, table))
    rows = _scored_but_rare(docs, box).join(_add_rare(added, box), "key", "left")
    score = F.col("score") + F.coalesce("rare_score", F.lit(0.0))
    return rows.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(model["n"]).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"), score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"))
