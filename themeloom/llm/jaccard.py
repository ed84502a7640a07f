"""Exact Jaccard join of word n-gram sets with set-relation skipping.

Equal sets are one class and are joined through one representative. The tokens of a
set are put in one global order, frequent ones last, and only a prefix of them is
indexed: two sets that are similar enough share at least ``SHARED`` tokens of their
prefixes. Two relations between sets save most of the work:

* Index lists carry set size, token position and a parity signature; pairs whose sizes,
  positions or signatures rule out the overlap are skipped inside the list (each bit
  that differs between two signatures takes at least one token that differs). Lists are
  first read against a few leaders of each size class. Where only components are asked
  for, lists whose sets already belong to one component are skipped as a whole
  afterwards; where the links of each row are counted, sets near the same leader form a
  cluster whose sets are all linked and are counted by its size, and lists are read
  against themselves, by blocks of bounded size, for pairs of different clusters.
* Answers of a set follow from those of a highly similar leader: with the known
  differences x-leader and leader-y, the triangle inequality links or drops (x, y)
  without reading either set. Only pairs that it leaves open are compared.

Frequencies of all documents are counted in hashed buckets; that bounds what is sent
to the tasks, and any order gives the same result. Sets are compared by 64-bit
fingerprints of n-grams.

Results for odd rows: null, empty and blank texts have no set, link with nothing and
are their own component; the links of a row are all other rows with an equal or similar set; rows with equal sets are linked; a null id ranks above every
other id, so a component has a null id only when all its ids are null; an empty table
gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.llm.components import components
from themeloom.llm.lookups import likely
from themeloom.llm.words import Piece, chunk, column, grams, mix, pieces
from themeloom.runtime import stage

#: Common prefix tokens that a pair needs (fewer when its overlap is smaller).
SHARED = 12
#: Bits of the parity signature of a set, 64 in a number.
SIGNATURE = 256
SEEDS = (11, 23, 37)
#: Sets of a list and size class that are joined in one group.
BLOCK = 256
ROWS = "doc_id long, n_shingles long, set_key binary, signature array<long>, prefix array<long>"


@dataclass(frozen=True)
class JaccardSettings:
    """Words of a shingle, similarity in hundredths, and width of the frequency table."""

    words: int = 4
    percent: int = 85
    width: int = 1 << 16


def sets_of(piece: Piece, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of the documents of a piece, ordered by (document, value),
    and the bounds of each document in them. Documents of fewer than n words have
    their whole sequence as one shingle."""
    owner = piece.owner()
    values = grams(piece.marks, n)
    inside = owner[: len(values)] == owner[n - 1 :] if len(values) else np.zeros(0, bool)
    documents, shingles = [owner[: len(values)][inside]], [values[inside]]
    short = np.flatnonzero((piece.counts > 0) & (piece.counts < n))
    for i in short:
        own = piece.marks[piece.begins[i] : piece.begins[i + 1]]
        documents.append(np.array([i]))
        shingles.append(mix(grams(own, len(own)) ^ np.uint64(len(own))))
    document, shingle = np.concatenate(documents), np.concatenate(shingles)
    order = np.lexsort((shingle, document))
    document, shingle = document[order], shingle[order]
    fresh = np.ones(len(shingle), bool)
    fresh[1:] = (shingle[1:] != shingle[:-1]) | (document[1:] != document[:-1])
    document, shingle = document[fresh], shingle[fresh]
    return shingle, np.searchsorted(document, np.arange(len(piece) + 1))


def _key(values: np.ndarray) -> bytes | None:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None


def shingle_frequencies(docs: DataFrame, settings: JaccardSettings) -> DataFrame:
    """bucket, df: documents of each hashed shingle, over all documents."""
    width, n = settings.width, settings.words

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            for piece in pieces(column(batch, "text"), lower=True):
                shingles, _ = sets_of(piece, n)
                total += np.bincount((shingles % np.uint64(width)).astype(np.int64), minlength=width)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "df"])

    return docs.select("text").mapInArrow(count, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df"))


def levels(frequencies: DataFrame, width: int) -> np.ndarray:
    """Order class of each bucket: 0 up to what chance puts into it, then by doublings."""
    total = np.zeros(width)
    for row in frequencies.collect():
        total[row.bucket] = row.df
    usual = np.median(total)
    over = (total - usual - 4 * np.sqrt(usual + 1)) / (np.sqrt(usual + 1) + 8)
    return np.clip(np.ceil(np.log2(np.maximum(over, 0) + 1)), 0, 63).astype(np.uint8)


def signatures(piece: Piece, shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each document the parity of its number of tokens in each of the classes."""
    owner = np.repeat(np.arange(len(piece)), np.diff(bounds))
    place = ((shingles >> np.uint64(20)) % np.uint64(SIGNATURE)).astype(np.int64)
    counts = np.bincount(owner * SIGNATURE + place, minlength=len(piece) * SIGNATURE)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.int64)


def rows_of(docs: DataFrame, level: np.ndarray, settings: JaccardSettings) -> DataFrame:
    """doc_id, set size, digest of the set and its prefix, for each row."""
    width, n, percent = settings.width, settings.words, settings.percent

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(column(batch, "text"), lower=True):
                shingles, bounds = sets_of(piece, n)
                rank = level[(shingles % np.uint64(width)).astype(np.int64)]
                sizes = np.diff(bounds)
                keys, heads = [], []
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    own = shingles[a:b]
                    keys.append(_key(own))
                    size = b - a
                    least = -(-percent * size // 100)
                    length = min(size, size - least + SHARED)
                    later = rank[a:b]
                    order = np.argsort(later, kind="stable")[:length] if later.any() else slice(0, length)
                    heads.append(own[order].view(np.int64))
                lengths = np.array([len(h) for h in heads], np.int64)
                flat = np.concatenate(heads) if heads else np.zeros(0, np.int64)
                prefix = pa.ListArray.from_arrays(
                    pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array(flat)
                )
                steps = pa.array(np.arange(0, (len(piece) + 1) * SIGNATURE // 64, SIGNATURE // 64)[: len(piece) + 1], pa.int32())
                marks = pa.ListArray.from_arrays(steps, pa.array(signatures(piece, shingles, bounds)))
                yield pa.RecordBatch.from_arrays(
                    [chunk(batch, "doc_id", piece), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), marks, prefix],
                    ["doc_id", "n_shingles", "set_key", "signature", "prefix"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(build, ROWS)


def _least(size_a: Column, size_b: Column, percent: int) -> Column:
    """Smallest overlap that links two sets of these sizes."""
    return F.ceil(F.lit(percent) * (size_a + size_b) / F.lit(100.0 + percent) - 1e-9).cast("long")


def postings(rows: DataFrame, percent: int) -> DataFrame:
    """token, sid, n, pos, signature, and whether a smaller set shows this token, of tokens
    that more than one representative has. Copies are left out by their class."""
    each = rows.select("sid", "n_shingles", "prefix").select("sid", F.col("n_shingles").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "token"))
    common = each.groupBy("token").count().filter("count > 1").select("token")
    own = F.col("n") - _least(F.col("n"), F.col("n"), percent) + SHARED
    parts = [F.col("signature")[i].alias(f"s{i}") for i in range(SIGNATURE // 64)]
    marks = rows.select("sid", *parts).hint("merge")
    return each.join(common, "token").withColumn("indexed", F.col("pos") < own).join(marks, "sid")


def _fits(small: str, large: str, percent: int) -> Column:
    """Size, position and signature let the pair reach its overlap."""
    n1, n2, p1, p2 = (F.col(c) for c in (f"{small}.n", f"{large}.n", f"{small}.pos", f"{large}.pos"))
    least = _least(n1, n2, percent)
    reach = F.least(p1, p2) + 1 + F.least(n1 - p1, n2 - p2) - 1
    differ = F.lit(0)
    for i in range(SIGNATURE // 64):
        differ = differ + F.bit_count(F.col(f"{small}.s{i}").bitwiseXOR(F.col(f"{large}.s{i}")))
    return (100 * n1 >= percent * n2) & (reach >= least) & (differ <= n1 + n2 - 2 * least)


def _candidates(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) with their sizes that share enough prefix tokens."""
    shared = pairs.groupBy("x", "y", "nx", "ny").count()
    enough = F.least(F.lit(SHARED), _least(F.col("nx"), F.col("ny"), percent))
    return shared.filter(F.col("count") >= enough).drop("count")


def _pair() -> list[Column]:
    return [F.col("s.sid").alias("x"), F.col("l.sid").alias("y"), F.col("s.n").alias("nx"), F.col("l.n").alias("ny")]


def _smaller(one: str, other: str) -> Column:
    n1, n2 = F.col(f"{one}.n"), F.col(f"{other}.n")
    return (n1 < n2) | ((n1 == n2) & (F.col(f"{one}.sid") < F.col(f"{other}.sid")))


def leader_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Each list's sets against a few sets of their size class: the first by each of
    some hash orders, which tend to be the same sets in all lists of a group."""
    band = F.floor(F.log(F.col("n").cast("double")) / -F.log(F.lit(percent / 100))).cast("int")
    row = F.struct("n", "sid", "pos", "indexed", *[f"s{i}" for i in range(SIGNATURE // 64)])
    banded = lists.withColumn("band", band)
    chosen = [F.min_by(row, F.struct(F.xxhash64(F.lit(seed), "sid"), "sid")) for seed in SEEDS]
    leaders = banded.groupBy("token", "band").agg(F.array_distinct(F.array(*chosen)).alias("leaders"))
    leaders = leaders.select("token", "band", F.explode("leaders").alias("m")).select("token", "band", "m.*")
    # The leader is the smaller set of the pair in one half, the larger in the other.
    first = banded.alias("l").join(leaders.alias("s"), ["token", "band"])
    second = leaders.alias("l").join(banded.alias("s"), ["token", "band"])
    both = [x.filter(F.col("s.indexed") & _smaller("s", "l")).filter(_fits("s", "l", percent)).select("token", *_pair()) for x in (first, second)]
    return _candidates(both[0].union(both[1]).distinct(), percent)


def other_pairs(lists: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets of different components, from lists that hold more than one."""
    known = lists.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    known = stage(known, "rooted-lists")
    mixed = known.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("token")
    open_ = known.join(mixed, "token")
    small, large = open_.filter("indexed").alias("s"), open_.alias("l")
    on = (F.col("s.token") == F.col("l.token")) & (F.col("s.root") != F.col("l.root")) & _smaller("s", "l") & _fits("s", "l", percent)
    return _candidates(small.join(large, on).select(*_pair()), percent)


def clusters(known: DataFrame, percent: int) -> DataFrame:
    """sid, cluster: sets whose gap to their leader is at most what links them if half of it
    is theirs. By the triangle inequality any two sets of a cluster are linked. Of several
    leaders that one counts which could have the most sets. ``known`` is that of ``derive``."""
    either = known.select(F.col("x").alias("cluster"), F.col("y").alias("sid"), F.col("ny").alias("n"), "gap").union(
        known.select("y", "x", "nx", "gap")
    )
    near = either.filter((100 + percent) * F.col("gap") <= (100 - percent) * F.col("n")).select("cluster", "sid")
    sizes = stage(near.groupBy("cluster").agg(F.count("*").alias("could")), "cluster-sizes")
    own = sizes.select("cluster", F.col("cluster").alias("sid"), "could")
    every = near.join(sizes, "cluster").select("cluster", "sid", "could").union(own)
    best = F.max(F.struct("could", (-F.col("cluster")).alias("place")))
    return every.groupBy("sid").agg(best.alias("b")).select("sid", (-F.col("b.place")).alias("cluster"))


def every_pair(lists: DataFrame, grouped: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets of different clusters from all lists, inside components too. A list
    whose sets are of one cluster is skipped. The others are cut by size class and into
    blocks; a set meets the blocks of its own class and of the next larger one, as no others
    have sizes that let it link."""
    # shrunk a little: sizes at just the limit stay in neighbouring classes
    band = F.floor(F.log(F.col("n").cast("double")) / -F.log(F.lit(percent / 100)) * (1 - 1e-9)).cast("int")
    banded = lists.join(grouped, "sid", "left").withColumn("cluster", F.coalesce("cluster", "sid")).withColumn("band", band)
    sizes = stage(
        banded.groupBy("token", "band").agg(F.count("*").alias("size"), F.min("cluster").alias("lo"), F.max("cluster").alias("hi")),
        "list-sizes",
    )
    mixed = sizes.groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi").select("token")
    blocks = sizes.join(mixed, "token").select("token", "band", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    large = banded.join(blocks, ["token", "band"]).withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    asking = banded.filter("indexed").withColumn("up", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("band", F.col("band") + F.col("up"))
    small = asking.join(blocks, ["token", "band"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    same = [F.col(f"s.{c}") == F.col(f"l.{c}") for c in ("token", "band", "block")]
    apart = F.col("s.cluster") != F.col("l.cluster")
    on = same[0] & same[1] & same[2] & apart & _smaller("s", "l") & _fits("s", "l", percent)
    return _candidates(small.alias("s").join(large.alias("l"), on).select(*_pair()), percent)


def derive(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """``pairs`` with ``link``: true or false where the answers of a leader decide it,
    null where the sets have to be read. ``known`` has (x, y, gap) of compared pairs."""
    either = known.select("x", "y", "gap").union(known.select("y", "x", "gap"))
    best = either.groupBy("y").agg(F.min(F.struct("gap", "x")).alias("b"))
    near = best.select(F.col("y").alias("_set"), F.col("b.x").alias("_leader"), F.col("b.gap").alias("_own"))
    allowed = F.col("nx") + F.col("ny") - 2 * _least(F.col("nx"), F.col("ny"), percent)

    def by(one: str, other: str, found: str) -> DataFrame:
        step = pairs.select("x", "y", "nx", "ny").join(near, F.col(one) == F.col("_set"))
        far = either.select(F.col("x").alias("_from"), F.col("y").alias("_far"), F.col("gap").alias("_gap"))
        step = step.join(far, (step._leader == far._from) & (F.col(other) == F.col("_far")))
        link = F.when(F.col("_own") + F.col("_gap") <= allowed, True).when(
            F.abs(F.col("_own") - F.col("_gap")) > allowed, False
        )
        return step.select("x", "y", link.alias(found)).filter(F.col(found).isNotNull())

    answered = by("x", "y", "link").union(by("y", "x", "link")).groupBy("x", "y").agg(F.max("link").alias("link"))
    return pairs.join(answered, ["x", "y"], "left")


def sets_of_members(docs: DataFrame, wanted: DataFrame, settings: JaccardSettings) -> DataFrame:
    """sid, tokens of the sets in ``wanted`` (sid, doc_id, set_key), made again from the
    texts of their representatives. A text under an id that repeats is told from the
    others by the digest of its set."""
    n = settings.words

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()  # rows that repeat id and text are neighbours after the join
        for batch in batches:
            sids, keys = column(batch, "sid").to_pylist(), column(batch, "set_key").to_pylist()
            for piece in pieces(column(batch, "text"), lower=True):
                shingles, bounds = sets_of(piece, n)
                kept, tokens = [], []
                for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True), piece.first):
                    if sids[i] not in given and _key(shingles[a:b]) == keys[i]:
                        given.add(sids[i])
                        kept.append(sids[i])
                        tokens.append(shingles[a:b].view(np.int64))
                ends = np.append(0, np.cumsum([len(t) for t in tokens])).astype(np.int32)
                flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kept, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["sid", "tokens"]
                )

    texts = likely(docs.select(F.col("doc_id").cast("long"), "text"), wanted)
    keyed = wanted.select(F.col("doc_id").alias("_id"), "sid", "set_key").hint("merge")
    both = texts.join(keyed, texts.doc_id.eqNullSafe(keyed._id)).select("text", "sid", "set_key")
    return both.mapInArrow(build, "sid long, tokens array<long>")


def compare(pairs: DataFrame, docs: DataFrame, members: DataFrame, settings: JaccardSettings) -> DataFrame:
    """x, y, nx, ny, gap (symmetric difference) of ``pairs``. Only the larger set of a
    pair travels with it; both sides grow with the data, so nothing is broadcast."""
    sids = pairs.select(F.col("x").alias("sid")).union(pairs.select("y")).distinct()
    wanted = stage(members.select("sid", "doc_id", "set_key").join(sids.hint("merge"), "sid"), "sets-wanted")
    sets = sets_of_members(docs, wanted, settings)
    with_y = sets.select(F.col("sid").alias("y"), F.col("tokens").alias("ty")).hint("merge").join(pairs.hint("merge"), "y")
    both = sets.select(F.col("sid").alias("x"), F.col("tokens").alias("tx")).hint("merge").join(with_y, "x")
    common = F.size(F.array_intersect("tx", "ty")).cast("long")
    found = both.select("x", "y", "nx", "ny", (F.col("nx") + F.col("ny") - 2 * common).alias("gap"))
    return found.distinct()


def _first_answers(docs: DataFrame, members: DataFrame, settings: JaccardSettings) -> tuple[DataFrame, DataFrame]:
    """The lists, and the compared pairs of leaders."""
    lists = stage(postings(members, settings.percent), "lists")
    first = stage(leader_pairs(lists, settings.percent), "leader-pairs")
    return lists, stage(compare(first, docs, members, settings), "leader-answers")


def _close(percent: int) -> Column:
    return F.col("gap") <= F.col("nx") + F.col("ny") - 2 * _least(F.col("nx"), F.col("ny"), percent)


def _rest(rest: DataFrame, known: DataFrame, docs: DataFrame, members: DataFrame, settings: JaccardSettings) -> DataFrame:
    """a, b: linked pairs of ``rest`` that are not in ``known``."""
    rest = rest.join(known.select("x", "y"), ["x", "y"], "left_anti")
    rest = stage(derive(stage(rest, "other-pairs"), known, settings.percent), "derived")
    derived = rest.filter("link").select(F.col("x").alias("a"), F.col("y").alias("b"))
    found = compare(rest.filter("link IS NULL").drop("link"), docs, members, settings).filter(_close(settings.percent))
    return derived.union(found.select(F.col("x").alias("a"), F.col("y").alias("b")))


def links(docs: DataFrame, members: DataFrame, settings: JaccardSettings) -> DataFrame:
    """a, b: links between representatives that connect each component of similar sets."""
    lists, known = _first_answers(docs, members, settings)
    near = known.filter(_close(settings.percent)).select(F.col("x").alias("a"), F.col("y").alias("b"))
    roots = components(near).select(F.col("node").alias("sid"), "root")
    rest = other_pairs(lists, stage(roots, "roots"), settings.percent)
    return stage(near.union(_rest(rest, known, docs, members, settings)), "all-links")


def every_link(docs: DataFrame, members: DataFrame, settings: JaccardSettings) -> tuple[DataFrame, DataFrame]:
    """All links between representatives: (a, b) of different clusters, each once, and the
    clusters (sid, cluster), inside which all sets are linked."""
    lists, known = _first_answers(docs, members, settings)
    grouped = stage(clusters(known, settings.percent), "clusters")
    near = known.filter(_close(settings.percent)).select(F.col("x").alias("a"), F.col("y").alias("b"))
    of = [grouped.select(F.col("sid").alias(c), F.col("cluster").alias(f"c{c}")) for c in "ab"]
    near = near.join(of[0], "a", "left").join(of[1], "b", "left")
    near = near.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    rest = _rest(every_pair(lists, grouped, settings.percent), known, docs, members, settings)
    return stage(near.union(rest), "all-links"), grouped


def classes(docs: DataFrame, settings: JaccardSettings) -> tuple[DataFrame, DataFrame]:
    """The rows of ``rows_of`` with a ``place`` that tells them apart, and for each
    distinct set its representative ``sid`` and the smallest id ``low``."""
    level = levels(shingle_frequencies(docs, settings), settings.width)
    rows = stage(rows_of(docs, level, settings).withColumn("place", F.monotonically_increasing_id()), "set-rows")
    same = rows.filter("set_key IS NOT NULL").groupBy("set_key").agg(
        F.min("place").alias("sid"), F.min("doc_id").alias("low")
    )
    return rows, stage(same, "set-classes")


def _labelled(rows: DataFrame, same: DataFrame, found: DataFrame) -> DataFrame:
    """set_key, doc_id, n_shingles, component_id of ``rows`` by the links in ``found``."""
    joined = stage(components(found), "components")
    labels = same.join(joined.select(F.col("node").alias("sid"), "root"), "sid")
    least = labels.groupBy("root").agg(F.min("low").alias("least"))
    linked = labels.join(least, "root").select("set_key", F.col("least").alias("_least"))
    known = same.select("set_key", "low").join(linked, "set_key", "left").select(
        "set_key", F.coalesce("_least", "low").alias("_component")
    )
    narrow = rows.select("doc_id", "n_shingles", "set_key")
    return narrow.join(known, "set_key", "left").select(
        "set_key", "doc_id", "n_shingles", F.coalesce("_component", "doc_id").alias("component_id")
    )


def _members(rows: DataFrame, same: DataFrame) -> DataFrame:
    return rows.join(same.select(F.col("sid").alias("place"), "sid").hint("merge"), "place")


def similar(docs: DataFrame, settings: JaccardSettings | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``."""
    settings = settings or JaccardSettings()
    rows, same = classes(docs, settings)
    return _labelled(rows, same, links(docs, _members(rows, same), settings)).drop("set_key")


def counted(docs: DataFrame, settings: JaccardSettings | None = None) -> DataFrame:
    """``similar`` with n_links: how many other rows have an equal or a similar set."""
    settings = settings or JaccardSettings()
    rows, same = classes(docs, settings)
    found, grouped = every_link(docs, _members(rows, same), settings)
    sizes = rows.filter("set_key IS NOT NULL").groupBy("set_key").agg(F.count("*").alias("size"))
    sized = stage(same.select("set_key", "sid").join(sizes, "set_key"), "class-sizes")
    either = found.union(found.select("b", "a"))
    far = either.join(sized.select(F.col("sid").alias("b"), "size"), "b").groupBy("a").agg(F.sum("size").alias("far"))
    whole = grouped.join(sized, "sid").groupBy("cluster").agg(F.sum("size").alias("near"))
    near = grouped.join(whole, "cluster").select("sid", "near")
    totals = sized.join(far.withColumnRenamed("a", "sid"), "sid", "left").join(near, "sid", "left").select(
        "set_key", (F.coalesce("near", "size") - 1 + F.coalesce("far", F.lit(0).cast("long"))).alias("n_links")
    )
    joined = found.union(grouped.filter("sid <> cluster").select("sid", "cluster"))
    return _labelled(rows, same, joined).join(totals, "set_key", "left").select(
        "doc_id", "n_shingles", "component_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")
    )


def keep_one(docs: DataFrame, settings: JaccardSettings | None = None) -> DataFrame:
    """The rows of the smallest id of each component, with all their columns. A
    component without any id keeps all its rows."""
    found = similar(docs, settings)
    stay = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_stay")).distinct()
    return docs.join(stay, docs.doc_id.eqNullSafe(stay._stay), "left_semi")
