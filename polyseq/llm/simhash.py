"""SimHash near-duplicates through an inverted index of byte positions.

Two 64-bit fingerprints that differ in at most 2 bits differ in at most 2 bytes, so they agree in at least 6 of
their 8 positional bytes. Each distinct fingerprint is listed under eleven choices of 5 positional bytes, such that
whichever 6 bytes two fingerprints share, one choice lies within them. Members of a posting list share 5 bytes; their
shared positional bytes are tallied over all 8, pairs that reach the guaranteed minimum of 6 are retained, and the
bits of those are verified. A posting list that is long is split by the fingerprints of radius one around each member,
which hold all its links without listing its pairs. Components are found on distinct fingerprints by rounds of joins.

Texts that are alike (:func:`similar_groups`) are proposed by that index first. What lies further apart than its bits is
proposed by the sets of their shingles: two sets of a Jaccard similarity t or more share one of the rarest shingles of
each, under whatever order of all shingles. The exact similarity of the sets decides about both.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from polyseq.llm._shared import LOWER_AZ, fresh, mix, partitions_for, rows_without, scratch, sift, stage, text_bytes, word_hashes

BITS, BYTES, MOST_BITS = 64, 8, 2
#: The least number of positional bytes that a link shares.
LEAST_SHARED = BYTES - MOST_BITS
#: Bytes left out of each choice: any two of the eight are among the three of one of them (the lines of seven points, and four with the eighth).
LEFT_OUT = [{k, (k + 1) % 7, (k + 3) % 7} for k in range(7)] + [{7, 0, 1}, {7, 2, 3}, {7, 4, 5}, {7, 6, 0}]
SEED = 42
#: Posting lists up to this length have their pairs tallied one by one; longer ones are split further.
PAIRED = 32
#: Fingerprints that a task lists, about; the share of all rows, one in HOT, above which a fingerprint is broadcast; most rows that are broadcast.
PRINTS, HOT, BROADCAST_ROWS = 250_000, 1024, 200_000


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles, repeats included, with A-Z lower-cased; zero without words."""
    words = text.translate(LOWER_AZ).split()  # bytes.split() parts at exactly \x20 and \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-shingle] + 1]).tolist()
    ends = ends[shingle - 1 :].tolist()
    over = np.zeros(BITS, np.int64)
    for k in range(0, len(starts), 1 << 16):  # a very long text doesn't need its bits all at once
        hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[k : k + (1 << 16)], ends[k : k + (1 << 16)], strict=True)], dtype="<u8")
        over += np.unpackbits(hashes.view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * over > len(starts), bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x, shingle) for x in text_bytes(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.record_batch({"doc_id": batch.column(0), "fp": pa.array(found.view(np.int64))})

    return run


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _masks() -> list[int]:
    """For each choice of 5 positional bytes, the mask that keeps them, as a signed 64-bit number."""
    return [_signed(sum(0xFF << (8 * b) for b in range(BYTES) if b not in left)) for left in LEFT_OUT]


def _shared_bytes(a: Column, b: Column) -> Column:
    """How many of the 8 positional bytes agree."""
    differ = a.bitwiseXOR(b)
    same = [F.when(F.shiftrightunsigned(differ, 8 * k).bitwiseAND(F.lit(0xFF)) == 0, 1).otherwise(0) for k in range(BYTES)]
    return sum(same[1:], same[0])


def _retained(pairs: DataFrame) -> DataFrame:
    """The pairs (u, v) whose tally of shared positional bytes reaches the minimum that a link is sure to have."""
    return pairs.filter(_shared_bytes(F.col("u"), F.col("v")) >= LEAST_SHARED)


def _links(prints: DataFrame) -> DataFrame:
    """(u, v), u < v, of distinct fingerprints within 2 bits: enough of them to connect what is connected.

    A posting list has 3 bytes that may differ, so it holds 2 ** 24 fingerprints at the very most.
    """
    masks = _masks()
    postings = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("kept", "bytes"))
    postings = postings.groupBy("kept", "bytes").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    postings = stage(postings, "postings")
    pairs = F.flatten(F.transform("fps", lambda x, i: F.transform(F.slice("fps", i + 2, F.size("fps")), lambda y: F.struct(F.least(x, y).alias("u"), F.greatest(x, y).alias("v")))))
    short = _retained(postings.filter(F.size("fps") <= PAIRED).select(F.explode(pairs).alias("p")).select("p.u", "p.v"))
    short = short.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MOST_BITS)
    # members within 2 bits share a point within 1 bit of both; all around one point are within 2 bits of each other
    flips = [_signed(1 << b) for b in range(BITS)]
    points = postings.filter(F.size("fps") > PAIRED).select("kept", "bytes", F.explode("fps").alias("v"))
    mask = F.element_at(F.array(*[F.lit(m) for m in masks]), F.col("kept") + 1)
    near = F.concat(F.array("v"), F.transform(F.filter(F.array(*[F.lit(m) for m in flips]), lambda m: m.bitwiseAND(mask) == 0), lambda m: m.bitwiseXOR(F.col("v"))))
    points = points.select("kept", "v", F.explode(near).alias("point"))
    centres = points.groupBy("kept", "point").agg(F.collect_list("v").alias("fps")).filter(F.size("fps") > 1)  # 25 members at most
    least = F.array_min("fps")
    star = F.transform(F.array_remove("fps", least), lambda v: F.struct(least.alias("u"), v.alias("v")))
    long = centres.select(F.explode(star).alias("p")).select("p.u", "p.v")
    return short.union(long).distinct()


def components(links: DataFrame) -> DataFrame:
    """(v, label) for each v that isn't the least of its component, label being the least; from pairs (u, v).

    Large-star and small-star rounds: every node's larger neighbours, then its smaller ones, are hung on its least
    neighbour, until the pairs are stars. Each round is written to the shared folder; the driver gets counts only.
    """
    edges, before = stage(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u < v"), "links"), None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        edges = both.filter("v > u").join(least, "u").select(F.col("m").alias("u"), "v").distinct()  # large star
        edges = stage(edges, "large-star")
        least = edges.groupBy("v").agg(F.min("u").alias("m"))
        hung = edges.join(least, "v").filter("u > m").select(F.col("m").alias("u"), F.col("u").alias("v"))  # small star
        edges = stage(hung.union(least.select(F.col("m").alias("u"), "v")).distinct(), "small-star")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select("v", F.col("u").alias("label"))
        before = now


def _linked_sets(prints: DataFrame) -> DataFrame:
    """(u, v) of sets whose fingerprints (set, fp; a set may have several) are within 2 bits by :func:`_links`: enough of them to connect what is connected."""
    listed = stage(prints.select("fp", "set").distinct(), "fingerprints")
    firsts = stage(listed.groupBy("fp").agg(F.min("set").alias("one")), "prints")
    links = _links(firsts.select("fp").repartition(partitions_for(prints.sparkSession, firsts.count(), PRINTS), "fp"))
    a, b = (firsts.select(F.col("fp").alias(k), F.col("one").alias(f"one_{k}")) for k in "uv")
    apart = links.join(a, "u").join(b, "v").select("one_u", "one_v")
    alike = listed.join(firsts, "fp").select("one", "set")
    pairs = apart.union(alike).toDF("u", "v").filter("u != v")
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row for each row of ``df``: doc_id, fp (the fingerprint as a signed long), component_id.

    component_id is the smallest id reachable over links of at most 2 bits, the row itself included; null if all
    ids there are null. Null and empty texts, and those of white space alone, have fingerprint zero, which is
    linked like any other. Fewer than ``shingle`` words are one shingle. Other columns are not read.
    """
    spark, kind = df.sparkSession, df.schema[id_col].dataType.simpleString()
    rows = stage(df.select(df[id_col].alias("doc_id"), df[text_col].alias("text")).mapInArrow(_fingerprints(shingle), f"doc_id {kind}, fp long"), "simhash")
    prints = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n")), "prints")
    n_prints, n_rows = prints.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    links = _links(prints.select("fp").repartition(partitions_for(spark, n_prints, PRINTS), "fp"))
    labels = components(links).withColumnRenamed("v", "fp")
    prints = prints.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    ids = prints.groupBy("label").agg(F.min("least_id").alias("component_id"))
    known = stage(prints.join(ids, "label").select("fp", "n", "component_id"), "components")
    # a fingerprint of more than one row in HOT, of which there are fewer than HOT, is settled where its rows lie
    hot = known.filter(F.col("n") * HOT > n_rows).select("fp", "component_id")
    others = rows.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(known.filter(F.col("n") * HOT <= n_rows).select("fp", "component_id"), "fp")
    return rows.join(F.broadcast(hot), "fp").unionByName(others).select("doc_id", "fp", "component_id")


#: Bits of a shingle's hash by which its frequency is estimated: the order of shingles is by a table of fixed size.
SLOT_BITS, SLOTS_A_ROW = 18, 1 << 12
#: Bits of the sketch by which most sets that can't be similar are told apart without comparing them.
SKETCH_BITS = 2048
#: 64-bit numbers that a sketch is folded into, small enough to go with each listed row.
FOLDED = 8
#: Words of 64 bits of the sieve for shingles that have a list, which is broadcast; most lists that are broadcast themselves.
SIEVE_WORDS, BROADCAST_LISTS = 1 << 20, 1_000_000
#: Rounds in which lists are held against one member, and comparisons for each listed row from which they are worth while.
ROUNDS, FEW = 2, 4
#: Lists of a set that a listed row knows from before its own.
BEFORE = 8


def _shingles(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of n words (of all words, if there are fewer) of a batch of texts, A-Z lower-cased, and how many each text has."""
    words, sizes = word_hashes(column)
    ends = np.cumsum(sizes)
    h, turn = np.zeros(len(words), np.uint64), np.uint64(0x9E3779B97F4A7C15)
    short = (sizes < n) & (sizes > 0)
    at = np.arange(len(words))
    last = np.repeat(ends, sizes)
    for k in range(n):
        inside = at + k < last
        h = np.where(inside, mix(h + turn) ^ words[np.minimum(at + k, max(len(words) - 1, 0))], h) if len(words) else h
    left = last - at  # words from here to the end of the text
    keep = (left >= n) | (np.repeat(short, sizes) & (left == np.repeat(sizes, sizes)))
    return mix(h[keep]), np.where(short, 1, np.maximum(sizes - n + 1, 0))


def _sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The distinct hashes of the shingles of each text, sorted."""
    for at in range(0, len(column), 512):
        hashes, sizes = _shingles(column.slice(at, 512), n)
        yield from map(np.unique, np.split(hashes, np.cumsum(sizes)[:-1]))


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(BITS - SLOT_BITS)).astype(np.int64)


def _frequencies(rows: DataFrame, shingle: int) -> np.ndarray:
    """For each slot of hashes, how many texts have a shingle there, each shingle counted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            for own in _sets(batch.column(0), shingle):
                np.add.at(total, _slots(own), 1)
        if total.any():
            parts = total.astype("<u4").reshape(-1, SLOTS_A_ROW)
            yield pa.record_batch({"part": pa.array(range(len(parts)), pa.int32()), "n": pa.array([x.tobytes() for x in parts], pa.binary())})

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, "<u4").astype(np.int64) for x in group.column("n").to_pylist())
        return pa.table({"part": group.column("part").slice(0, 1), "n": pa.array([np.minimum(total, (1 << 32) - 1).astype("<u4").tobytes()], pa.binary())})

    out = np.zeros(((1 << SLOT_BITS) // SLOTS_A_ROW, SLOTS_A_ROW), np.uint32)
    for r in rows.select("text").mapInArrow(count, "part int, n binary").groupBy("part").applyInArrow(add, "part int, n binary").collect():  # a megabyte
        out[r.part] = np.frombuffer(r.n, "<u4")
    return out.ravel()


def _sketch(own: np.ndarray) -> bytes:
    """For each of SKETCH_BITS slots, whether an odd number of the shingles falls there."""
    return np.packbits(np.bincount((own & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1).tobytes()


def _prefixes(shingle: int, least: float, often: np.ndarray):
    """The set of each text: its hash, its size, its sketch, the text's fingerprint, and so many of its rarest shingles that every similar set has one of them among its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets, n, sketches, folded, first = [], [], [], [], []
                prints = np.fromiter(map(fingerprint, text_bytes(part.column(2))), np.uint64, part.num_rows)
                for own in _sets(part.column(2), shingle):
                    sets.append(xxh64_intdigest(own.tobytes(), SEED))
                    n.append(len(own))
                    sketches.append(_sketch(own))
                    folded.append(np.bitwise_xor.reduce(np.frombuffer(sketches[-1], "<i8").reshape(-1, FOLDED)))
                    first.append(own[np.lexsort((own, often[_slots(own)]))[: len(own) - int(np.ceil(least * len(own) - 1e-9)) + 1]])
                ends = np.cumsum([0, *map(len, first)])
                yield pa.record_batch({
                    "doc_id": part.column(0), "node": part.column(1), "set": pa.array(np.array(sets, np.uint64).view(np.int64)), "n": pa.array(n, pa.int32()), "sketch": pa.array(sketches, pa.binary()), "folded": pa.array(folded, pa.list_(pa.int64())), "fp": pa.array(prints.view(np.int64)),
                    "first": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(first).view(np.int64))),
                })

    return run


def _shingle_bytes(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"set": batch.column(0), "shingles": pa.array([x.tobytes() for x in _sets(batch.column(1), shingle)], pa.binary())})

    return run


def _may_be_similar(least: float):
    """Whether sets of these sketches and sizes can be similar: a slot whose bits differ holds a shingle that only one of them has."""

    @F.arrow_udf("boolean")
    def may(a: pa.Array, b: pa.Array, n: pa.Array, m: pa.Array) -> pa.Array:
        x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(len(c), SKETCH_BITS // 64) for c in (a, b))
        differ = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
        n, m = n.to_numpy().astype(np.int64), m.to_numpy().astype(np.int64)
        return pa.array((differ <= (n + m) * ((1 - least) / (1 + least)) + 1e-6) & (np.minimum(n, m) >= least * np.maximum(n, m) - 1e-6))

    return may


def _jaccard():
    @F.arrow_udf("double")
    def jaccard(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            out.append(shared / (len(x) + len(y) - shared) if len(x) + len(y) else 1.0)
        return pa.array(out, pa.float64())

    return jaccard


def _pairs_of(both: DataFrame) -> DataFrame:
    return both.select(F.least("a.set", "b.set").alias("u"), F.greatest("a.set", "b.set").alias("v"))


def _against_one(members: DataFrame, turn: int) -> DataFrame:
    """(u, v): in each list, one member of it with those that aren't linked with it yet.

    First the member that is in most and longest lists, as the text is that others were made from; later any.
    """
    order = F.struct((-F.col("score") if turn == 0 else F.xxhash64("set", F.lit(turn))).alias("turn"), "set", "label")
    leaders = members.groupBy("h").agg(F.min(order).alias("one"), F.min("label").alias("least"), F.max("label").alias("most")).filter("least != most").select("h", "one.*")
    return _pairs_of(members.alias("a").join(leaders.alias("b"), (F.col("a.h") == F.col("b.h")) & (F.col("a.label") != F.col("b.label"))))


def _main_labels(members: DataFrame) -> DataFrame:
    """Of each list with several labels the most frequent one, and how many comparisons are left in it, about."""
    each = members.groupBy("h", "label").agg(F.count(F.lit(1)).alias("n"))
    main = each.groupBy("h").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("n"))
    return main.filter("most < n").select("h", "main", ((F.col("n") - F.col("most")) * F.col("n")).alias("work"))


def _may_by_folded(least: float, a: dict[str, Column], b: dict[str, Column]) -> Column:
    """What :func:`_may_be_similar` says, from sizes n and folded sketches."""
    differ = [F.bit_count(F.get(a["folded"], k).bitwiseXOR(F.get(b["folded"], k))) for k in range(FOLDED)]
    near = sum(differ[1:], differ[0]) <= (a["n"] + b["n"]) * ((1 - least) / (1 + least)) + 1e-6
    return near & (F.least(a["n"], b["n"]) >= F.greatest(a["n"], b["n"]) * least - 1e-6)


def _may_be_first(least: float, a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether the shingle at places p of two sets of n, in the order of all shingles, may be the first that they share if they are similar: they share no more then than are left from there on in each."""
    return F.least(a["n"] - a["p"], b["n"] - b["p"]) >= (a["n"] + b["n"]) * (least / (1 + least)) - 1e-6


def _all_between(members: DataFrame, main: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """(u, v): in each list, the pairs of members that aren't linked yet and that places, sizes and folded sketches don't rule out.

    A similar pair is in the list of the first shingle that it shares, so lists that can't be that of the pair leave it
    out: by place, or because both sets have one of the same lists among the BEFORE last ones. So a pair isn't a row for
    each shingle that it shares.
    """
    members = members.select("h", "set", "p", "label").join(_small(main.select("h", "main")), "h").join(sketches.select("set", "n", "folded"), "set")
    members = members.withColumn("before", F.collect_list("h").over(Window.partitionBy("set").orderBy("p").rowsBetween(-BEFORE, -1)))
    once = (F.col("b.label") == F.col("a.main")) | (F.col("a.set") < F.col("b.set"))
    a, b = ({c: F.col(f"{k}.{c}") for c in ("n", "p", "folded")} for k in "ab")
    near = _may_be_first(least, a, b) & _may_by_folded(least, a, b) & ~F.arrays_overlap("a.before", "b.before")
    few = members.filter("label != main").alias("a")
    return _pairs_of(few.join(members.alias("b"), (F.col("a.h") == F.col("b.h")) & (F.col("a.label") != F.col("b.label")) & once & near))


def _small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """To be broadcast if it has no more than ``most`` rows, which are narrow."""
    return F.broadcast(df) if df.count() <= most else df


def _members(listed: DataFrame, lists: DataFrame) -> DataFrame:
    """h, set, n and the least of any other column: the members of the lists (h, n), each once.

    Nearly all shingles are listed by one set only. A sieve of SIEVE_WORDS rows at most keeps these from being shuffled
    where the lists are too many to be broadcast.
    """
    word = F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(SIEVE_WORDS - 1)).alias("word")
    bit = F.element_at(F.array(*[F.lit(_signed(1 << b)) for b in range(64)]), F.col("h").bitwiseAND(F.lit(63)).cast("int") + 1)
    sieve = lists.groupBy(word).agg(F.bit_or(bit).alias("bits"))
    found = listed.withColumn("word", word).join(F.broadcast(sieve), "word").filter(F.col("bits").bitwiseAND(bit) != 0).select(*listed.columns)
    others = [F.min(c).alias(c) for c in listed.columns if c not in ("h", "set")]
    return found.join(_small(lists, BROADCAST_LISTS), "h").groupBy("h", "set").agg(F.first("n").alias("n"), *others)


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """One row for each (id, text) of ``df``: doc_id, node (a hash of both), component (a number that linked texts have in common).

    Texts link if the sets of their word shingles, A-Z lower-cased, have a Jaccard similarity of ``least`` or more;
    texts without words are alike. Pairs are proposed by the index of their SimHash fingerprints (3-word shingles, 2 bits),
    which meets the closest ones, and, as fingerprints of similar texts may lie further apart, by lists of shingles, so that
    every such pair is in one group: each set is listed under its rarest shingles, n - ceil(least n) + 1 of n, of which
    similar sets share one. A list of two is a pair to compare. Longer lists are first
    held against one member at a time, which links large groups at the cost of their size; then those pairs of a list
    are taken that no link connects yet and that sketches of fixed size don't rule out. The shingles of pairs are
    compared exactly. Shingles are told apart by 64-bit hashes, and so are sets. An empty table gives an
    empty result.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(df[id_col].alias("doc_id"), F.xxhash64(df[id_col], df[text_col]).alias("node"), df[text_col].alias("text"))
    prefixes = _prefixes(shingle, least, _frequencies(rows, shingle))
    with scratch(df.sparkSession):
        prints = stage(rows.mapInArrow(prefixes, f"doc_id {kind}, node long, set long, n int, sketch binary, folded array<long>, fp long, first array<long>"), "prefixes")
        of = stage(prints.select("doc_id", "node", "set").distinct(), "of", outlives=True)
        with scratch(df.sparkSession):
            by_bits = stage(_linked_sets(prints), "linked", outlives=True)
        listed = prints.select("set", F.posexplode("first").alias("p", "h"))
        lists = stage(listed.groupBy("h").agg(F.min("set").alias("u"), F.max("set").alias("v"), F.count(F.lit(1)).alias("n")).filter("u != v"), "lists", outlives=True)
        listed = stage(_members(listed, lists.filter("n > 2").select("h", "n")), "listed", outlives=True)
        nodes = stage(prints.groupBy("set").agg(F.min("node").alias("node"), F.min("n").alias("n")), "sets", outlives=True)  # one text of each set
        sketches = prints.join(nodes.select("node"), "node", "left_semi").select("set", "n", "sketch", "folded").dropDuplicates(["set"])
        sketches = stage(sketches, "sketches", outlives=True)
        by_bits = stage(by_bits, "by-bits", outlives=True)
    n_listed = listed.count()
    scores = listed.groupBy("set").agg(F.sum("n").alias("score"))

    def alike(pairs: DataFrame) -> DataFrame:
        """Those of the pairs of sets that are similar."""
        with scratch(df.sparkSession):
            a, b = (sketches.select(F.col("set").alias(k), F.col("n").alias(f"n_{k}"), F.col("folded").alias(f"folded_{k}")) for k in "uv")
            few = pairs.join(a, "u").join(b, "v").filter(_may_by_folded(least, *({c: F.col(f"{c}_{k}") for c in ("n", "folded")} for k in "uv"))).select("u", "v")
            a, b = (sketches.select(F.col("set").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"sketch_{k}")) for k in "uv")
            left = stage(stage(few, "few").join(a, "u").join(b, "v").filter(_may_be_similar(least)("sketch_u", "sketch_v", "n_u", "n_v")).select("u", "v"), "left")
            wanted = nodes.join(left.select(F.explode(F.array("u", "v")).alias("set")).distinct(), "set").select("node", "set")
            wanted = stage(wanted, "wanted")
            likely, may = sift(rows.select("node", "text"), F.col("node"), wanted, "node")
            texts = likely.filter(may).select("node", "text").join(wanted, "node").dropDuplicates(["set"]).select("set", "text")
            sets = stage(texts.mapInArrow(_shingle_bytes(shingle), "set long, shingles binary"), "shingles")
            a, b = (sets.select(F.col("set").alias(k), F.col("shingles").alias(f"shingles_{k}")) for k in "uv")
            return stage(left.join(a, "u").join(b, "v").filter(_jaccard()("shingles_u", "shingles_v") >= least).select("u", "v"), "alike", outlives=True)

    tried: list[DataFrame] = []
    found = None
    for turn in range(ROUNDS + 1):
        members = listed.select("h", "set", "p").join(scores, "set") if turn == 0 else listed.select("h", "set", "p")
        members = members.withColumn("label", F.col("set"))
        if found is not None:
            members = listed.select("h", "set", "p").join(found.withColumnsRenamed({"v": "set"}), "set", "left").withColumn("label", F.coalesce("label", "set"))
        main = stage(_main_labels(members), "main")
        work = main.agg(F.sum("work")).first()[0] or 0
        last = turn == ROUNDS or work <= FEW * n_listed
        pairs = _all_between(members, main, sketches, least) if last else _against_one(members, turn)
        pairs = (pairs if tried else pairs.union(lists.filter("n = 2").select("u", "v")).union(by_bits)).distinct()
        if tried:
            pairs = pairs.join(reduce(DataFrame.union, tried), ["u", "v"], "left_anti")
        tried.append(stage(pairs, "pairs"))
        links = alike(tried[-1])
        found = stage(components(links if found is None else links.union(found.select(F.col("label").alias("u"), "v"))), "found")
        if last:
            break
    return of.join(found.withColumnRenamed("v", "set"), "set", "left").select("doc_id", "node", F.coalesce("label", "set").alias("component"))


def drop_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``df`` whose id is the smallest of their group by :func:`similar_groups`, with all their columns.

    A null id comes after all others. Rows alike in id and text stay or go together. Null texts are alike with those
    without words. Columns may have any names; an empty table gives an empty one. Rows that stay don't move but for
    those few that a sieve of fixed size takes for others.
    """
    (node,) = fresh(df, "node")
    with scratch(df.sparkSession):
        groups = stage(similar_groups(df, id_col, text_col, shingle, least), "groups")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("first")
        kept = groups.groupBy("component").agg(first, F.count(F.lit(1)).alias("n")).filter("n > 1").select("component", F.col("first.node").alias("stays"))
        gone = stage(groups.join(kept, "component").filter("node != stays").select(F.col("node").alias(node)), "gone", outlives=True)
    return rows_without(df, F.xxhash64(df[id_col], df[text_col]), gone, node)
