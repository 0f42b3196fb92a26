"""N-gram Jaccard join: groups of documents whose word shingles overlap, found by PartEnum.

Every distinct shingle set is a node. Sets that share a PartEnum signature are candidates; no
similar pair shares none. A candidate pair is dropped when parity sketches prove it too far
apart, and otherwise settled on the sets themselves. Only membership in components is wanted,
so a signature group is first compared with a few pivots; pairs of its other members are looked
at only where they are still in different components, in blocks of bounded size. Blocks tell which
components may be linked; then the members of one are held against those of the other, on the sets.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmine.llm.bitmap import bitmap, hits
from talkmine.llm.partenum import Scheme, signatures
from talkmine.llm.text import Words, mix, shingle_sets, slices, tidy
from talkmine.functions.ranking import skew_join
from talkmine.operators.components import connected
from talkmine.session import cut_lineage, fresh_dir

SHINGLE_WORDS = 5
PERCENT = 80
#: features whose signatures, a little over half as many, one task of the meeting stage holds
FEATURES_PER_TASK = 4_000_000
#: sets that all later ones with the same signature are compared with
PIVOTS = 4
#: sets that are compared with each other at once; of sketches, which are short, four times as many
BLOCK = 256
#: pairs for each set that carry brief sketches through a shuffle at once, and that carry sets
BRIEF_PAIRS, WHOLE_PAIRS = 8, 0.5
#: sets that a round is made for at least
ROUND_SETS = 100_000
#: signatures that one count stands for at most
RUN = 32_767
_U64 = np.uint64


def _set_ids(sets: list[np.ndarray]) -> np.ndarray:
    """Identities of sets; of no use for empty ones."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    running = np.zeros(size.sum() + 1, dtype=_U64)
    np.cumsum(mix(np.concatenate([*sets, np.zeros(0, _U64)])), out=running[1:])
    end = np.cumsum(size)
    return mix(running[end] - running[end - size] + size.astype(_U64)).astype(np.int64)


def _sketch(features: np.ndarray) -> np.ndarray:
    """Parity of the features in each of at least 2 * size cells, as 64-bit words.

    Two sets differ in at least as many features as their parities differ in cells.
    """
    cells = max(64, 1 << int(2 * len(features) - 1).bit_length())
    odd = np.bincount((mix(features) & _U64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _brief(sketch: np.ndarray) -> np.ndarray:
    """The sketch as if made with a quarter of the cells, of which there are at least 64."""
    return np.bitwise_xor.reduce(sketch.reshape(min(4, len(sketch)), -1), axis=0)


def _each_set(batches, length: int) -> Iterator[tuple[pa.RecordBatch, int, list[np.ndarray]]]:
    for batch in batches:
        text = batch.column("text")
        for a, b in slices(text):
            yield batch, a, shingle_sets(Words(text.slice(a, b - a)), length)


def row_key(docs: DataFrame) -> Column:
    """What rows with the same id and text share."""
    return F.xxhash64(docs["doc_id"], docs["text"])


def shingle_table(docs: DataFrame, length: int = SHINGLE_WORDS) -> DataFrame:
    """key, doc_id, n_shingles, set_id, sketch and brief sketch of each document."""

    def compute(batches):
        for batch, a, sets in _each_set(batches, length):
            sketches = [_sketch(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column("key").slice(a, len(sets)),
                batch.column("doc_id").slice(a, len(sets)),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(_set_ids(sets), mask=np.array([not len(s) for s in sets])),
                pa.array(sketches, pa.list_(pa.int64())),
                pa.array([None if x is None else _brief(x) for x in sketches], pa.list_(pa.int64()))],
                names=["key", "doc_id", "n_shingles", "set_id", "sketch", "brief"])

    return docs.select(row_key(docs).alias("key"), "doc_id", "text").mapInArrow(
        tidy(compute), "key long, doc_id long, n_shingles long, set_id long, sketch array<long>, brief array<long>")


def sets_of(docs: DataFrame, ids: DataFrame, length: int) -> DataFrame:
    """(set_id, features) of the sets with the given ids, made anew from the texts where they are.

    A bitmap of the ids keeps nearly all other sets inside their task; each task gives a set once.
    """
    box = docs.sparkSession.sparkContext.broadcast(bitmap(ids))

    def compute(batches):
        given: set[int] = set()
        for _, _, sets in _each_set(batches, length):
            own = {i: s for i, s in zip(_set_ids(sets).tolist(), sets) if len(s)}
            names = np.array(list(own), dtype=np.int64)
            chosen = [i for i in names[hits(names, box.value)].tolist() if i not in given]
            given.update(chosen)
            yield pa.RecordBatch.from_arrays(
                [pa.array(chosen, pa.int64()), pa.array([own[i].view(np.int64) for i in chosen], pa.list_(pa.int64()))],
                names=["set_id", "features"])

    found = docs.select("text").mapInArrow(tidy(compute), "set_id long, features array<long>")
    return found.join(ids, "set_id", "left_semi").dropDuplicates(["set_id"])


def signature_rows(docs: DataFrame, scheme: Scheme, places: int, length: int = SHINGLE_WORDS) -> DataFrame:
    """Signatures packed by the place where they meet: per slice of documents and place, the set
    ids, how many signatures each has there, and the signatures. Copies in a slice count once.

    A place holds the signatures of about ``FEATURES_PER_TASK`` features at any size of corpus, so 32 more
    bits tell them apart; the few that fall together only make a candidate more. A set's id goes to every
    place where it has a signature, so with more places more bytes are ids.
    """

    def compute(batches):
        for _, _, sets in _each_set(batches, length):
            own = {i: signatures(s, scheme) for i, s in zip(_set_ids(sets).tolist(), sets) if len(s)}
            if not own:
                continue
            ids = np.array(list(own), dtype=np.int64)
            sig = np.concatenate(list(own.values()))
            who = np.repeat(np.arange(len(ids)), [len(x) for x in own.values()])
            place = (sig % _U64(places)).astype(np.int64)
            sig = (sig // _U64(places)).astype(np.uint32)
            order = np.argsort(place, kind="stable")
            sig, who, place = sig[order], who[order], place[order]
            begins = np.r_[True, (who[1:] != who[:-1]) | (place[1:] != place[:-1])][:len(sig)]
            inside = np.arange(len(sig)) - np.maximum.accumulate(np.where(begins, np.arange(len(sig)), 0))
            runs = np.flatnonzero(inside % RUN == 0)
            counts = np.diff(np.r_[runs, len(sig)])
            full = np.flatnonzero(np.bincount(place, minlength=places))
            at_run = np.searchsorted(place[runs], full)
            at_sig = np.searchsorted(place, full)
            yield pa.RecordBatch.from_arrays([
                pa.array(full, pa.int32()),
                pa.ListArray.from_arrays(pa.array(np.r_[at_run, len(runs)], pa.int32()), pa.array(ids[who[runs]])),
                pa.ListArray.from_arrays(pa.array(np.r_[at_run, len(runs)], pa.int32()), pa.array(counts, pa.int16())),
                pa.ListArray.from_arrays(pa.array(np.r_[at_sig, len(sig)], pa.int32()), pa.array(sig.view(np.int32))),
            ], names=["place", "ids", "counts", "sigs"])

    return docs.select("doc_id", "text").mapInArrow(
        tidy(compute), "place int, ids array<long>, counts array<smallint>, sigs array<int>")


def _meet(batches, most: int = PIVOTS, buffer: int = 1 << 19):
    """Rows (sig, pivot, member) of the signatures that several sets share.

    The first set seen with a signature is its pivot, and all later ones are its members; they
    stream past, so a task holds its distinct signatures and never all sets of a frequent one.
    The next few sets are further pivots, ``most`` in all. Pairs with one of these as an end come
    without signature, once for each buffer. Only sets after the pivots are wanted by signature, since
    they have yet to be compared with each other; they come with the first pivot. What Spark hands
    over at once is cut to about ``buffer`` signatures, since sorting takes many times their size.
    """
    known, count = np.zeros(0, np.int64), np.zeros(0, np.int8)
    pivots = [np.zeros(0, np.int64) for _ in range(most)]
    sigs, owners, held = [], [], 0

    def settle():
        nonlocal known, count, sigs, owners, held
        s, o = np.concatenate(sigs), np.concatenate(owners)
        sigs, owners, held = [], [], 0
        order = np.lexsort((o, s))
        s, o = s[order], o[order]
        once = np.r_[True, (s[1:] != s[:-1]) | (o[1:] != o[:-1])]
        s, o = s[once], o[once]
        head = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        size = np.diff(np.r_[head, len(s)])
        place = np.searchsorted(known, s[head])
        fresh = np.ones(len(head), bool)
        fresh[place < len(known)] = known[place[place < len(known)]] != s[head][place < len(known)]
        known = np.insert(known, place[fresh], s[head][fresh])
        count = np.insert(count, place[fresh], 0)
        for j in range(most):
            pivots[j] = np.insert(pivots[j], place[fresh], 0)
        at = np.searchsorted(known, s[head])
        had = count[at].astype(np.int64)
        group = np.repeat(np.arange(len(head)), size)
        ordinal = np.arange(len(s)) - head[group]
        out = []
        for j in range(most):
            new = (had <= j) & (j - had < size)
            pivots[j][at[new]] = o[head[new] + (j - had)[new]]
            count[at[new]] = j + 1
            pivot = pivots[j][at][group]
            later = (j < count[at])[group] & (ordinal > (j - had)[group]) & (o != pivot)
            pairs = np.stack([s[later], pivot[later], o[later]])
            if j == 0:
                after = (ordinal + had[group])[later] >= most
                named = pairs[:, after]
                pairs = pairs[:, ~after]
            out.append(np.unique(pairs[1:], axis=1))
        more = np.unique(np.concatenate(out, axis=1), axis=1)
        return pa.RecordBatch.from_arrays([
            pa.array(np.r_[named[0], np.zeros(more.shape[1], np.int64)],
                     mask=np.r_[np.zeros(named.shape[1], bool), np.ones(more.shape[1], bool)]),
            pa.array(np.r_[named[1], more[0]]), pa.array(np.r_[named[2], more[1]])], names=["sig", "pivot", "member"])

    for batch in batches:
        upto = np.cumsum(pc.list_value_length(batch.column("sigs")).to_numpy())
        begin = 0
        while begin < len(upto):
            done = upto[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(upto, done + buffer, "right")))
            rows = batch.slice(begin, end - begin)
            begin = end
            counts = rows.column("counts").flatten().to_numpy()
            place = np.repeat(rows.column("place").to_numpy().astype(np.int64), pc.list_value_length(rows.column("sigs")))
            sigs.append(place << 32 | rows.column("sigs").flatten().to_numpy().view(np.uint32))
            owners.append(np.repeat(rows.column("ids").flatten().to_numpy(), counts))
            held += len(sigs[-1])
            if held >= buffer // 2:
                yield settle()
    if held:
        yield settle()


def signature_groups(docs: DataFrame, n_features: int, scheme: Scheme, length: int = SHINGLE_WORDS) -> DataFrame:
    """(sig, pivot, member) of all signatures that at least two sets have; null sig: pairs with a pivot."""
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-n_features // FEATURES_PER_TASK))
    packed = signature_rows(docs, scheme, tasks, length)
    return packed.repartitionById(tasks, "place").mapInArrow(
        tidy(partial(_meet, most=PIVOTS)), "sig long, pivot long, member long")


def _forget(spark: SparkSession, *folders: str) -> None:
    """Delete folders of finished steps, and have the driver collect the handles of their shuffles, at which
    Spark deletes those files too; else all that the steps wrote stays on disk until the end."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()


def _stored(df: DataFrame) -> tuple[DataFrame, str]:
    """Written to the shared folder and read again: smaller than a checkpoint of many short rows; and its folder."""
    path = fresh_dir(df.sparkSession, "ngram-join")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _folded(sketch: Column, cells: Column) -> Column:
    """Halves of a sketch, of ``cells`` words each, added up, as if it had been made with half the cells."""
    cells = cells.cast("int")
    return F.zip_with(F.slice(sketch, F.lit(1), cells), F.slice(sketch, cells + 1, cells), lambda x, y: x.bitwiseXOR(y))


def _at_most(a: str, b: str, percent: int) -> Column:
    """Whether sizes and sketches of two sets leave it open that they are similar."""
    big, small = F.greatest(f"{a}.n", f"{b}.n"), F.least(f"{a}.n", f"{b}.n")
    cells = F.least(F.size(f"{a}.sketch"), F.size(f"{b}.sketch"))

    def folded(side: str) -> Column:
        s = F.col(f"{side}.sketch")
        return F.when(F.size(s) == cells, s).otherwise(_folded(s, cells))

    differ = F.aggregate(
        F.zip_with(folded(a), folded(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    return (small * 100 >= big * percent) & (
        differ * (100 + percent) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (100 - percent))


def _by(pairs: DataFrame, sketches: DataFrame, kind: str, percent: int) -> DataFrame:
    """Pairs (a, b) that sketches of the kind can't rule out."""
    for side in ("a", "b"):
        own = sketches.select(F.col("set_id").alias(side), F.struct("n", F.col(kind).alias("sketch")).alias(f"of_{side}"))
        pairs = pairs.join(own, side)
    return pairs.filter(_at_most("of_a", "of_b", percent)).select("a", "b")


def _rounds(pairs: int, sets: int, each: float) -> int:
    """Rounds in which ``pairs`` are dealt with, ``each`` for every set at once."""
    return max(1, math.ceil(pairs / (each * max(sets, ROUND_SETS))))


def _in_rounds(rows: DataFrame, by: Column, rounds: int, step) -> DataFrame:
    """``step`` of all rows, made part by part: what the shuffles of one part wrote is deleted before the next.

    ``by`` deals the rows into parts. Pairs grow faster than the texts; with more rounds for more pairs
    the disk that they take at once does not.
    """
    parts = []
    for i in range(rounds):
        parts.append(cut_lineage(step(rows.filter(F.pmod(by, F.lit(rounds)) == i) if rounds > 1 else rows, i)))
        _forget(rows.sparkSession)
    return reduce(lambda x, y: x.union(y), parts)


def _open_pairs(pairs: DataFrame, n: int, sketches: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) that sketches can't rule out, each once; ``pairs`` are ``n`` rows. Most are by the
    brief ones, so few pairs carry whole sketches through a shuffle."""
    left = _in_rounds(pairs, F.xxhash64("a", "b"), _rounds(n, sketches.count(), BRIEF_PAIRS),
                      lambda part, _: _by(part.distinct(), sketches, "brief", percent))
    return _by(left, sketches, "sketch", percent)


def verified(pairs: DataFrame, docs: DataFrame, percent: int, length: int) -> DataFrame:
    """Those of the candidate pairs that are similar, on the sets themselves."""
    ids = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct())
    sets, folder = _stored(sets_of(docs, ids, length))
    _forget(docs.sparkSession)
    rounds = _rounds(pairs.count(), ids.count(), WHOLE_PAIRS)

    def similar_of(part: DataFrame, i: int) -> DataFrame:
        # only the sets of this part's right sides go through the shuffle with it
        right = sets.filter(F.pmod(F.xxhash64("set_id"), F.lit(rounds)) == i)
        for side, own in (("a", sets), ("b", right)):
            part = part.join(own.select(F.col("set_id").alias(side), F.col("features").alias(f"of_{side}")), side)
        common = F.size(F.array_intersect("of_a", "of_b"))
        union = F.size("of_a") + F.size("of_b") - common
        return part.filter(common * 100 >= union * percent).select("a", "b")

    similar = _in_rounds(pairs, F.xxhash64("b"), rounds, similar_of)
    _forget(docs.sparkSession, folder)
    return similar


def _blocks(groups: DataFrame, labels: DataFrame, sketches: DataFrame) -> tuple[DataFrame, str]:
    """Blocks, and pairs of blocks, of those groups whose members, the pivots aside, are not all
    connected; and the folder that these are read from.

    Of groups with the same members one is enough. Blocks hold about four times ``BLOCK`` members, so
    a frequent signature is many tasks; each block is copied for every other of its group. Members
    bring half their sketch, which is as wide as their set is large and rules out nearly as many.
    """
    label = F.coalesce("component", "member")
    members = groups.select("sig", "member").join(labels.withColumnRenamed("node", "member"), "member", "left")
    members, folder = _stored(members.select("sig", "member", label.alias("component")))
    several = members.groupBy("sig").agg(
        F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("size"),
        F.sum(F.shiftright(F.xxhash64("member"), 24)).alias("all"), F.bit_xor(F.xxhash64("member", F.lit(1))).alias("same"))
    several = cut_lineage(several.filter("x <> y").groupBy("size", "all", "same").agg(F.min("sig").alias("sig")).select(
        "sig", F.ceil(F.col("size") / (4 * BLOCK)).alias("blocks")))
    half = F.when(F.size("sketch") < 2, F.col("sketch")).otherwise(_folded(F.col("sketch"), F.size("sketch") / 2))
    members = members.join(several, "sig").join(
        sketches.select(F.col("set_id").alias("member"), "n", half.alias("sketch")), "member")
    members = members.withColumn("block", F.pmod(F.xxhash64("member"), "blocks"))
    blocks = members.groupBy("sig", "block", "blocks").agg(F.collect_list(
        F.struct("member", "component", "n", "sketch")).alias("members"))
    none = F.lit(None).cast(blocks.schema["members"].dataType)
    small = blocks.filter("blocks = 1").select(F.col("members").alias("left"), none.alias("right"))
    large = cut_lineage(blocks.filter("blocks > 1"))
    left = large.select("sig", F.explode(F.sequence("block", F.col("blocks") - 1)).alias("block"),
                        F.col("members").alias("left"), F.col("block").alias("own"))
    return small.union(left.join(large.select("sig", "block", "members"), ["sig", "block"]).select(
        "left", F.when(F.col("own") != F.col("block"), F.col("members")).alias("right"))), folder


class _Block:
    """Members of one block: ids, components, sizes, and sketches by their width."""

    def __init__(self, members: pa.StructArray) -> None:
        self.member, self.component, self.n = (members.field(f).to_numpy() for f in ("member", "component", "n"))
        sketches = members.field("sketch")
        begin = sketches.offsets.to_numpy()
        values, begin = sketches.values.to_numpy()[begin[0]:begin[-1]], begin - begin[0]
        width = np.diff(begin)
        self.by_width = {w: (at, values[begin[at][:, None] + np.arange(w)]) for w in np.unique(width).tolist()
                         for at in [np.flatnonzero(width == w)]}


def _close(x: _Block, y: _Block, percent: int) -> np.ndarray:
    """Places of the pairs of two blocks in different components that sketches leave open."""
    out = [np.zeros((0, 2), np.int64)]
    for w, (at, a) in x.by_width.items():
        for v, (to, b) in y.by_width.items():
            common = min(w, v)
            if max(w, v) > 2 * common:  # sizes too different
                continue
            a_, b_ = (np.bitwise_xor.reduce(m.reshape(len(m), -1, common), axis=1) for m in (a, b))
            for i in range(0, len(at), step := max(1, (1 << 21) // (len(to) * common))):
                rows = at[i:i + step]
                n, m = x.n[rows][:, None], y.n[to][None, :]
                fit = (x.component[rows][:, None] != y.component[to][None, :]) & (
                    np.minimum(n, m) * 100 >= np.maximum(n, m) * percent)
                differ = np.bitwise_count((a_[i:i + step, None, :] ^ b_[None, :, :]).view(_U64)).sum(axis=2, dtype=np.int64)
                p, q = np.nonzero(fit & (differ * (100 + percent) <= (n + m) * (100 - percent)))
                out.append(np.stack([rows[p], to[q]], axis=1))
    return np.concatenate(out)


def _open_components(percent: int):
    """Compare blocks with themselves or each other: the pairs of components that sketches leave open,
    each once a batch."""

    def members(batch, side: str, i: int) -> _Block:
        column = batch.column(side)
        a, b = column.offsets[i].as_py(), column.offsets[i + 1].as_py()
        return _Block(column.values.slice(a, b - a))

    def compute(batches):
        for batch in batches:
            found = [np.zeros((0, 2), np.int64)]
            crosses = batch.column("right").is_valid().to_pylist()
            for i in range(batch.num_rows):
                x = members(batch, "left", i)
                if len(x.n) < 2 and not crosses[i]:
                    continue
                y = members(batch, "right", i) if crosses[i] else x
                at = _close(x, y, percent)
                found.append(np.unique(np.stack([x.component[at[:, 0]], y.component[at[:, 1]]], axis=1), axis=0))
            pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return compute


def _linked(percent: int):
    """For each set of the right block one link to the left block, whose sets are one component."""

    def sets(column, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = column.offsets[i].as_py(), column.offsets[i + 1].as_py()
        rows = column.values.slice(a, b - a)
        features = rows.field("features")
        begin = features.offsets.to_numpy()
        return rows.field("member").to_numpy(), features.values.to_numpy()[begin[0]:begin[-1]], begin - begin[0]

    def compute(batches):
        for batch in batches:
            out: list[tuple[int, int]] = []
            for i in range(batch.num_rows):
                y, of_y, begin = sets(batch.column("left"), i)
                x, of_x, at = sets(batch.column("right"), i)
                size = np.diff(begin)
                order = np.argsort(of_y, kind="stable")
                owner, of_y = np.repeat(np.arange(len(y)), size)[order], of_y[order]
                for j in range(len(x)):
                    own = of_x[at[j]:at[j + 1]]
                    low, high = np.searchsorted(of_y, own, "left"), np.searchsorted(of_y, own, "right")
                    n = high - low
                    hit = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                    common = np.bincount(owner[hit], minlength=len(y))
                    near = np.flatnonzero(common * 100 >= (size + len(own) - common) * percent)
                    if len(near):
                        out.append((int(x[j]), int(y[near[0]])))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())],
                                             names=["a", "b"])

    return compute


def _links_between(pairs: DataFrame, labels: DataFrame, docs: DataFrame, percent: int, length: int) -> DataFrame:
    """Links (a, b) that connect the given pairs of components, if any pair of their members is similar.

    The members of all smaller components that a larger one may be linked with are its
    challengers. They meet its members in tiles of ``BLOCK`` by ``BLOCK`` sets, and a challenger
    gives one link a tile at most, so a component of any size is many tasks and no pairs are listed.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("component")).distinct()
    sizes = labels.groupBy("component").agg(F.count("*").alias("n"))
    ends = cut_lineage(ends.join(sizes, "component", "left").select("component", F.coalesce("n", F.lit(1)).alias("n")))
    members = skew_join(labels, ends, "component", "n").select("component", F.col("node").alias("member")).unionByName(
        ends.join(labels, "component", "left_anti").select("component", F.col("component").alias("member")))
    members = cut_lineage(members)
    sets, folder = _stored(sets_of(docs, members.select(F.col("member").alias("set_id")), length))
    _forget(docs.sparkSession)
    members = members.join(sets.withColumnRenamed("set_id", "member"), "member")
    met = pairs
    for side in ("a", "b"):
        met = met.join(ends.select(F.col("component").alias(side), F.col("n").alias(f"n_{side}")), side)
    first = (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    met = cut_lineage(met.select(
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("large"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("small"),
        F.greatest("n_a", "n_b").alias("n_large"), F.least("n_a", "n_b").alias("n_small")))
    tiles = cut_lineage(met.groupBy("large").agg(
        F.ceil(F.first("n_large") / BLOCK).alias("lefts"), F.ceil(F.sum("n_small") / BLOCK).alias("rights"),
        F.sum("n_small").alias("n_small"), F.first("n_large").alias("n_large")))

    def cut(rows: DataFrame, own: str, other: str, i: str, j: str, name: str) -> DataFrame:
        at = F.pmod(F.xxhash64("member"), F.col(own))
        spread = rows.select("large", at.alias(i), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(j), "member", "features")
        return spread.groupBy("large", "i", "j").agg(F.collect_list(F.struct("member", "features")).alias(name))

    left = skew_join(members.withColumnRenamed("component", "large"), tiles, "large", "n_large")
    asked = cut_lineage(met.select("small", "large").join(tiles.select("large", "lefts", "rights"), "large"))
    right = members.withColumnRenamed("component", "small").join(asked, "small")
    met_tiles = cut(left, "lefts", "rights", "i", "j", "left").join(
        cut(right, "rights", "lefts", "j", "i", "right"), ["large", "i", "j"])
    links = cut_lineage(met_tiles.select("left", "right").mapInArrow(tidy(_linked(percent)), "a long, b long"))
    _forget(docs.sparkSession, folder)
    return links


def similar_groups(docs: DataFrame, percent: int = PERCENT, length: int = SHINGLE_WORDS,
                   scheme: Scheme | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, root (of linked sets) and key of each row of ``docs`` (doc_id, text; more are ignored).

    Two documents link when ``100 * |A & B| >= percent * |A | B|`` on their distinct shingles of
    ``length`` words; the component is the least doc_id that links lead to, its own included.
    A document with fewer words has its whole sequence as its one shingle. Null and empty texts
    and those of blanks have no shingle and link with nothing. Repeated rows link with each
    other and each gives a row; a null doc_id is never the least. An empty table gives no rows.
    Links are not counted: pairs already in one component are mostly not tested.
    """
    scheme = scheme or Scheme(percent=percent, parts=2, damage=1, spare=0.3)
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession
    sketched, folder = _stored(shingle_table(docs, length))
    nodes = cut_lineage(sketched.filter("set_id is not null").groupBy("set_id").agg(
        F.min("doc_id").alias("low"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"),
        F.first("brief").alias("brief")))
    table = cut_lineage(sketched.select("key", "doc_id", "n_shingles", "set_id"))
    _forget(spark, folder)
    sketches = nodes.select("set_id", "n", "sketch", "brief")
    n_features = table.agg(F.sum("n_shingles")).first()[0] or 0

    groups, of_groups = _stored(signature_groups(docs, n_features, scheme, length))
    _forget(spark)
    low, high = F.least("pivot", "member"), F.greatest("pivot", "member")
    stars = groups.select(low.alias("a"), high.alias("b"))
    open_pairs = cut_lineage(_open_pairs(stars, groups.count(), sketches, percent))
    _forget(spark)
    first = verified(open_pairs, docs, percent, length)
    labels = cut_lineage(connected(first))

    rest, of_members = _blocks(groups.filter("sig is not null"), labels, sketches)
    rest = cut_lineage(rest.mapInArrow(tidy(_open_components(percent)), "a long, b long").distinct())
    _forget(spark, of_groups, of_members)
    if not rest.isEmpty():
        second = _links_between(rest, labels, docs, percent, length)
        labels = cut_lineage(connected(labels.toDF("a", "b").union(second)))

    lows = nodes.select("set_id", "low").join(labels.withColumnRenamed("node", "set_id"), "set_id", "left")
    lows = cut_lineage(lows.select("set_id", "low", F.coalesce("component", "set_id").alias("root")))
    least = lows.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n"))
    of_sets = cut_lineage(skew_join(lows, least, "root", "n").select("set_id", "component_id", "root"))
    return table.select("doc_id", "n_shingles", "set_id", "key").join(of_sets, "set_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "root", "key")


def one_of_each_group(docs: DataFrame, percent: int = PERCENT, length: int = SHINGLE_WORDS) -> DataFrame:
    """Rows of ``docs`` without those that are similar to another: of each group the one with the
    least doc_id stays (a null id comes last). Texts without a word all stay."""
    rows = cut_lineage(similar_groups(docs, percent, length).filter("root is not null").select(
        "root", "key", F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "key").alias("place")))
    first = rows.groupBy("root").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1")
    grouped = cut_lineage(skew_join(rows, first, "root", "n"))
    kept = grouped.groupBy("root").agg(F.max("first")["key"].alias("key"), F.count_if(F.col("place") == F.col("first")).alias("n"))
    gone = cut_lineage(grouped.filter("place <> first").select("key").distinct())
    repeated = cut_lineage(kept.filter("n > 1").select("key"))
    changed = cut_lineage(gone.withColumn("stays", F.lit(False)).union(repeated.withColumn("stays", F.lit(True))))
    box = docs.sparkSession.sparkContext.broadcast(bitmap(changed.select("key")))
    named = docs.withColumn("__row_key", row_key(docs))

    def touched(yes: bool):
        def compute(batches):
            for batch in batches:
                yield batch.filter(pa.array(hits(batch.column("__row_key").to_numpy(), box.value) == yes))
        return named.mapInArrow(tidy(compute), named.schema)

    asked = touched(True).join(changed.withColumnRenamed("key", "__row_key").withColumnRenamed("stays", "__stays"),
                               "__row_key", "left")
    once = asked.filter("__stays").dropDuplicates(["__row_key"])
    columns = [f"`{c}`" for c in docs.columns]
    return touched(False).select(*columns).union(asked.filter("__stays is null").select(*columns)).union(
        once.select(*columns))
