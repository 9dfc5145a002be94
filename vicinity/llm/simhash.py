"""SimHash near-duplicates by multi-index hashing.

A fingerprint bit is 1 if it is set in over half of the hashes of a text's word shingles. Distinct
fingerprints are linked if they differ in few bits; to find the links, the 64 bits are cut into
segments, small Hamming balls around each segment's value are looked up in a table of all
fingerprints by segment value, and matches are verified over all 64 bits. By the pigeonhole
principle a pair within ``max_bits`` = m * q + a (m segments) agrees within q bits in one of the
first a + 1 segments or within q - 1 bits in one of the others.

A table entry with more than ``cap`` fingerprints would be met by as many probes. Its fingerprints,
and those that probe it, are linked another exact way: two fingerprints differ in at most 2t bits
just if the balls of radius t around them meet, so every whole-fingerprint ball member becomes a
key, and all fingerprints of one key are linked to the least of them where the distance allows it.

Defined results: a null or empty text, or one without words, has fingerprint zero and is linked
like any other; a text of fewer words than a shingle has one shingle, the whole sequence. Rows of
equal fingerprint are one class and are not expanded into pairs. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations
from math import acos, ceil, log, pi, sqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Roller, discard, materialize, mix, release, ship, text_blocks, words_of

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How often each bit is set in each column of 64-bit numbers: (columns, 64). Counts by carry-save addition."""
    columns = h.shape[1]
    counts = np.zeros((columns, 64), np.int64)
    weight, left = 1, h
    while len(left):
        carries = []
        while len(left) >= 3:
            k = len(left) // 3
            a, b, c = left[:k], left[k : 2 * k], left[2 * k : 3 * k]
            x = a ^ b
            carries.append((a & b) | (c & x))
            left = np.concatenate([x ^ c, left[3 * k :]])
        for row in left:
            counts += weight * np.unpackbits(np.ascontiguousarray(row).view(np.uint8).reshape(columns, 8), axis=1, bitorder="little").astype(np.int64)
        left = np.concatenate(carries) if carries else left[:0]
        weight *= 2
    return counts


def majority_bits(h: np.ndarray) -> np.ndarray:
    """For each column of 64-bit numbers: the bits set in over half of the rows."""
    return np.packbits(2 * bit_counts(h) > len(h), axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of a text; none for a text without words."""
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not tokens:
        return np.zeros(0, np.uint64)
    body = b" ".join(tokens)
    if len(tokens) <= shingle:
        pieces = [body]
    else:
        ends = np.cumsum([len(w) + 1 for w in tokens]) - 1
        starts = [0, *(ends[:-1] + 1).tolist()]
        pieces = [body[a:b] for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=False)]
    h = xxhash.xxh64_intdigest
    return np.array([h(p, 42) for p in pieces], np.uint64)


def fingerprint_of(text: str | None, shingle: int = 3, words: int = 1) -> np.ndarray:
    """Fingerprint of one text in 64-bit words; the first is of the shingles' XXH64 (seed 42), further ones of hashes of that."""
    first = shingle_hashes(text, shingle)
    if not len(first):
        return np.zeros(words, np.uint64)
    return majority_bits(np.stack([first, *(mix(first + np.uint64(k)) for k in range(1, words))], axis=1))


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number, or as an array of several."""
    import pyarrow as pa

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint_of(x.as_py(), shingle, words) for x in b.column(1)]
            flat = pa.array(np.concatenate(fp).view(np.int64) if fp else np.zeros(0, np.int64))
            if words > 1:
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(fp) + 1, dtype=np.int32) * words), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), flat], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id long, fp {'array<long>' if words > 1 else 'long'}"
    )


def _balls(width: int, radius: int) -> list[int]:
    """Masks of up to ``radius`` of ``width`` bits."""
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def hamming_links(fps: DataFrame, max_bits: int = 2, segments: int = 2, cap: int = 256) -> DataFrame:
    """Links (src < dst) between the distinct fingerprints ``fps`` (fp) within ``max_bits``.

    Complete up to connection: pairs from overfull table entries come as links to a common third
    fingerprint, whose distance is within ``max_bits`` too.
    """
    width = 64 // segments
    q, a = divmod(max_bits, segments)
    value = lambda s: F.shiftrightunsigned("fp", s * width).bitwiseAND(F.lit((1 << width) - 1)).cast("long")
    fps = fps.select("fp")
    table = fps.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(s).alias("seg"), value(s).alias("key")) for s in range(segments)])).alias("e")
    ).select("fp", "e.seg", "e.key")
    radius = [q if s <= a else q - 1 for s in range(segments)]
    probes = None
    for s in range(segments):
        if radius[s] < 0:
            continue
        masks = F.array(*[F.lit(m).cast("long") for m in _balls(width, radius[s])])
        part = fps.select("fp", F.lit(s).alias("seg"), value(s).alias("own"), F.explode(masks).alias("mask")).select(
            "fp", "seg", F.col("own").bitwiseXOR(F.col("mask")).alias("key")
        )
        probes = part if probes is None else probes.unionByName(part)
    full = materialize(table.groupBy("seg", "key").agg(F.count("*").alias("n")).where(F.col("n") > cap).select("seg", "key"), "overfull")
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("other")))
    if full.isEmpty():
        usual_table, usual_probes = table, probes
    else:
        usual_table = table.join(full, ["seg", "key"], "left_anti")
        usual_probes = probes.join(full, ["seg", "key"], "left_anti")
    links = (
        usual_probes.join(usual_table.withColumnRenamed("fp", "other"), ["seg", "key"])
        .where((F.col("fp") < F.col("other")) & (distance <= max_bits))
        .select(F.col("fp").alias("src"), F.col("other").alias("dst"))
    )
    if full.isEmpty():
        return links
    crowd = materialize(
        probes.join(full, ["seg", "key"], "left_semi").select("fp").unionByName(table.join(full, ["seg", "key"], "left_semi").select("fp")).distinct(),
        "crowd",
    )
    half = max_bits // 2
    if max_bits % 2 == 0:
        return links.unionByName(_meet(crowd, half, half, max_bits))
    # an odd bound: the balls of radius (max_bits - 1) / 2 and (max_bits + 1) / 2 meet
    return links.unionByName(_meet(crowd, half, half + 1, max_bits))


def _meet(crowd: DataFrame, r1: int, r2: int, max_bits: int) -> DataFrame:
    """Links of fingerprints through the keys that their balls share."""
    ball = lambda r: crowd.select("fp", F.explode(F.array(*[F.lit(_signed(m)).cast("long") for m in _balls(64, r)])).alias("mask")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("key")
    )
    if r1 == r2:  # all of one key are within max_bits of one another
        keys = ball(r1)
        low = keys.groupBy("key").agg(F.min("fp").alias("low"), F.count("*").alias("n")).where("n > 1").select("key", "low")
        return (
            keys.join(low, "key").where(F.col("fp") != F.col("low"))
            .select(F.least("fp", "low").alias("src"), F.greatest("fp", "low").alias("dst")).distinct()
        )
    near, far = ball(r1), ball(r2)
    low = near.groupBy("key").agg(F.min("fp").alias("low"))
    return (
        far.join(low, "key").where(F.col("fp") != F.col("low"))
        .select(F.least("fp", "low").alias("src"), F.greatest("fp", "low").alias("dst")).distinct()
    )


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``; component_id is the least doc_id reachable over links."""
    from .components import connected_components

    prints = materialize(fingerprints(docs, shingle), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    member = connected_components(hamming_links(classes, max_bits))
    named = materialize(
        classes.join(member.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("component")),
        "named",
    )
    least = materialize(named.groupBy("component").agg(F.min("rep").alias("component_id")), "least-doc")
    ids = materialize(named.join(least, "component").select("fp", "component_id"), "ids")
    return spread(prints, ids, classes)


def spread(prints: DataFrame, ids: DataFrame, classes: DataFrame, hot: int = 2048) -> DataFrame:
    """Carry class attributes to all rows: classes with over 1/``hot`` of the rows (at most ``hot`` of them) by broadcast, the rest by a shuffled join."""
    total = prints.count()
    crowded = F.broadcast(ids.join(classes.where(F.col("copies") > max(1, total // hot)).select("fp"), "fp", "left_semi"))
    return prints.join(crowded, "fp").unionByName(prints.join(crowded.select("fp"), "fp", "left_anti").join(ids, "fp"))


# --- similar texts: wide fingerprints of shingle sets, pairs verified on the sets -----------------

#: Words of a wide fingerprint that verification looks at, at least.
WIDE = 8
#: A probe flips up to FLIPS of the WEAK least decided bits of a segment.
WEAK, FLIPS = 4, 2
#: The share of pairs just at the similarity threshold that segments are laid out to meet.
MEET = 0.965
#: Four shingles and the same with a fifth differ in more bits than larger sets, as four often tie: 6/16 of bits, half of them then.
TINY, TINY_SHARE = 5, 0.1875
#: Bits of an odd sketch: a bit is set if it is the place of an odd number of a set's hashes.
ODD_BITS = 512
#: Size of the bitmap of refs whose sets are asked for.
SIEVE_BITS = 1 << 26
_LOWER_BYTES = np.frombuffer(_LOWER, np.uint8)


def shingle_sets_of(column, shingle: int) -> Iterator[np.ndarray]:
    """The set of word-shingle hashes of each text of an Arrow column, in ascending order; a text of fewer words has one shingle, one without words none."""
    letters, words = Roller(0), Roller(1)
    for lo, hi, buf, off in text_blocks(column, 1_000_000):
        buf = _LOWER_BYTES[buf]
        starts, ends, first = words_of(buf, off)
        prefix = words.prefix(letters.of(letters.prefix(letters.table[buf]), starts, ends))
        at = np.arange(max(0, len(starts) - shingle + 1))
        h = words.of(prefix, at, at + shingle)
        for i in range(hi - lo):
            a, b = first[i], first[i + 1]
            yield np.unique(h[a : b - shingle + 1] if b - a >= shingle else words.of(prefix, first[i : i + 1], first[i + 1 : i + 2])[: b - a])


def _set_id(s: np.ndarray) -> int:
    import xxhash

    return _signed(xxhash.xxh64_intdigest(s.tobytes(), 7))


def differing_share(similarity: float) -> float:
    """Expected share of bits in which fingerprints of two sets of this similarity (Jaccard) differ: the angle of the sets over pi."""
    return acos(2 * similarity / (1 + similarity)) / pi


def layout(texts: int, similarity: float) -> tuple[int, int]:
    """Width and number of segments for a table of so many texts.

    Segments get wider with the table, so that few unrelated texts share one by chance, and more of them are laid out, so
    that a pair just at ``similarity`` is met with probability MEET at any size. How often one segment meets such a pair is
    measured on simulated bit margins, correlated as the two sets are.
    """
    width = max(21, int(texts).bit_length() + 3)
    rng = np.random.default_rng(7)
    r = 2 * similarity / (1 + similarity)
    a = rng.normal(size=(20_000, width))
    b = r * a + sqrt(1 - r * r) * rng.normal(size=a.shape)
    differ = (a > 0) != (b > 0)
    hit = np.zeros(len(a), bool)
    for margin in (a, b):
        weak = np.argsort(np.abs(margin), 1)[:, :WEAK]
        hit |= (np.take_along_axis(differ, weak, 1).sum(1) == differ.sum(1)) & (differ.sum(1) <= FLIPS)
    return width, ceil(log(1 - MEET) / log(1 - hit.mean()))


def wide_prints(rows: DataFrame, shingle: int, width: int, segments: int) -> DataFrame:
    """(ref, id, n, own, weak, fp, odd) for each row (ref, text): hash and size of the shingle set, values and least decided bits of the segments, fingerprint, odd sketch."""
    import pyarrow as pa

    words = max(WIDE, -(-width * segments // 64))

    def part(refs, sets):
        counts = np.zeros((len(sets), 64 * words), np.int32)
        odd = np.zeros((len(sets), ODD_BITS), np.uint8)
        for i, s in enumerate(sets):
            if len(s):
                odd[i] = np.bincount((mix(s) % np.uint64(ODD_BITS)).astype(np.int64), minlength=ODD_BITS) & 1
                counts[i] = 2 * bit_counts(np.stack([s, *(mix(s + np.uint64(k)) for k in range(1, words))], axis=1)).ravel() - len(s)
        fp, odd = (np.packbits(x, axis=1, bitorder="little").view("<i8").astype(np.int64) for x in (counts > 0, odd))
        margin = counts[:, : width * segments].reshape(len(sets), segments, width)
        own = (margin > 0).astype(np.int64) @ (np.int64(1) << np.arange(width, dtype=np.int64))
        least = np.argsort(np.abs(margin), axis=2, kind="stable")[:, :, :WEAK].astype(np.int64)
        weak = (least << (6 * np.arange(WEAK, dtype=np.int64))).sum(2)
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))
        ids, n = pa.array([_set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32())
        return pa.RecordBatch.from_arrays([refs, ids, n, lists(own), lists(weak), lists(fp), lists(odd)], ["ref", "id", "n", "own", "weak", "fp", "odd"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done, held = 0, []
            for s in shingle_sets_of(b.column(1), shingle):
                held.append(s)
                if len(held) == 1024:
                    yield part(b.column(0).slice(done, len(held)), held)
                    done, held = done + len(held), []
            if held:
                yield part(b.column(0).slice(done), held)

    ref = rows.schema["ref"].dataType.simpleString()
    return rows.select("ref", "text").mapInArrow(run, f"ref {ref}, id long, n int, own array<long>, weak array<long>, fp array<long>, odd array<long>")


def segment_rows(classes: DataFrame, width: int, probes: bool) -> DataFrame:
    """(key, id, comp, peek, own): one row for each segment of each class, and with ``probes`` one for each other member (not ``own``) of the Hamming ball over its least decided bits."""
    import pyarrow as pa

    balls = [list(c) for r in range(1, FLIPS + 1) for c in combinations(range(WEAK), r)] if probes else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 2048):
                b = big.slice(lo, 2048)
                ids, comp = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                own, weak, fp = (b.column(i).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1) for i in (2, 3, 4))
                segments = own.shape[1]
                bit = [np.int64(1) << (weak >> np.int64(6 * k) & np.int64(63)) for k in range(WEAK)]
                values = [own, *(own ^ np.bitwise_or.reduce([bit[k] for k in ball]) for ball in balls)]
                key = (np.stack(values, axis=2) | (np.arange(segments, dtype=np.int64) << np.int64(width))[None, :, None]).ravel()
                # a word that the segment isn't part of
                peek = fp[:, (np.arange(segments) * width // 64 + 2) % fp.shape[1]]
                times = len(values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), *(pa.array(np.repeat(x, segments * times)) for x in (ids, comp)), pa.array(np.repeat(peek.ravel(), times)), pa.array(np.arange(len(key)) % times == 0)],
                    ["key", "id", "comp", "peek", "own"],
                )

    return classes.select("id", "comp", "own", "weak", "fp").mapInArrow(run, "key long, id long, comp long, peek long, own boolean")


def shingle_sets(rows: DataFrame, shingle: int, wanted: DataFrame) -> DataFrame:
    """(id, set) of the rows (ref, text) whose ref is in ``wanted`` (ref), and of a few others.

    The refs wanted go to all tasks as a bitmap of hashes, SIEVE_BITS whatever their number is, so that no text is shuffled;
    the fuller it is, the more sets come that nobody asked for.
    """
    import pyarrow as pa

    place = lambda: F.pmod(F.xxhash64("ref"), F.lit(SIEVE_BITS))
    filled = wanted.select(place().alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    sieve = np.zeros(SIEVE_BITS // 64, np.int64)
    sieve[filled["word"].to_numpy()] = filled["bits"].to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(sieve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(0).to_numpy(zero_copy_only=False)
            b = b.filter(pa.array((shared.value[at >> 6] >> (at & 63) & 1).astype(bool)))
            for s in shingle_sets_of(b.column(1), shingle):
                yield pa.RecordBatch.from_arrays([pa.array([_set_id(s)], pa.int64()), pa.array([s.view(np.int64)], pa.list_(pa.int64()))], ["id", "set"])

    return rows.select(place().alias("at"), "text").mapInArrow(run, "id long, set array<long>")


def similar_links(rows: DataFrame, classes: DataFrame, shingle: int, width: int, similarity: Fraction) -> DataFrame:
    """Links (src < dst) between ids of ``classes``, all of ``similarity`` (Jaccard) or more.

    A table entry (segment and value) may hold any number of texts, and copies of one another need not all be paired: each
    text of an entry and each probe of it is first compared with the entry's center, the text that shares most entries with
    others. First each text meets the one best center of its own entries; what that connects isn't compared again. Then texts
    and their probes meet the centers that they aren't connected to, and of those that stay apart from an entry's center, each
    meets a center elected among them. At last, whatever meets in an entry and isn't connected yet is compared pair by pair;
    there is no limit to that, so entries of many texts that are apart cost the square of their number. Pairs are verified
    over all bits of the fingerprints (three standard deviations beyond the mean distance at ``similarity``) and of the odd
    sketches (which lose none), then on their sets. A similar pair is lost if no segment meets it, or if its fingerprints are further apart than that; README has the
    measured recall. Links are complete up to connection: pairs that other links connect may be left out.
    """
    from .components import connected_components

    p, q = similarity.numerator, similarity.denominator
    share = differing_share(p / q)

    def verified(pairs: DataFrame, looked_at: bool = False) -> DataFrame:
        """``looked_at``: sizes and fingerprints were."""
        side = lambda c: classes.select(F.col("id").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in _LOOKS))
        close = pairs if looked_at else pairs.join(side("src"), "src").join(side("dst"), "dst").where(_maybe_alike("src", "dst", similarity))
        close = close if looked_at else materialize(close.select("src", "dst"), "close-pairs")
        ends = close.select(F.col("src").alias("id")).unionByName(close.select(F.col("dst").alias("id"))).distinct()
        sets = materialize(shingle_sets(rows, shingle, classes.select("id", F.col("low").alias("ref")).join(ends, "id", "left_semi")), "sets")
        if not sets.groupBy("id").count().where("count > 1").isEmpty():
            sets = materialize(sets.dropDuplicates(["id"]), "sets")
        release(rows.sparkSession)
        side_set = lambda c: sets.select(F.col("id").alias(c), F.col("set").alias(f"{c}_set"))
        both = F.size(F.array_intersect("src_set", "dst_set"))
        alike = both * q >= (F.size("src_set") + F.size("dst_set") - both) * p
        out = materialize(close.join(side_set("src"), "src").join(side_set("dst"), "dst").where(alike).select("src", "dst"), "alike")
        for x in (close, sets):
            discard(x)
        release(rows.sparkSession)
        return out

    def grouped(links: DataFrame) -> DataFrame:
        return connected_components(links).select(F.col("node").alias("id"), F.col("component").alias("comp"))

    def centers(table: DataFrame) -> DataFrame:
        best = F.max_by(F.struct("id", "comp", "peek"), F.struct("heat", "id"))
        out = table.groupBy("key").agg(best.alias("c"), F.count("*").alias("texts"), (F.min("comp") != F.max("comp")).alias("mixed"))
        out = out.select("key", F.col("c.id").alias("c_id"), F.col("c.comp").alias("c_comp"), F.col("c.peek").alias("c_peek"), "texts", "mixed")
        return materialize(out, "centers")

    near = F.bit_count(F.col("peek").bitwiseXOR(F.col("c_peek"))) <= 64 * share + 3.5 * sqrt(64 * share * (1 - share))
    pair = (F.least("id", "c_id").alias("src"), F.greatest("id", "c_id").alias("dst"))

    alone = classes.drop("odd").withColumn("comp", F.col("id"))
    table = materialize(segment_rows(alone, width, False), "segments")
    crowded = materialize(table.groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1"), "crowded")
    heat = materialize(table.join(crowded, "key").groupBy("id").agg(F.sum("texts").alias("heat")), "heat")
    warm = table.join(crowded.select("key"), "key", "left_semi").join(heat, "id")
    best = centers(warm)
    stars = table.join(best, "key").where((F.col("id") != F.col("c_id")) & near).join(heat.select(F.col("id").alias("c_id"), "heat"), "c_id")
    stars = stars.groupBy("id").agg(F.max_by("c_id", F.struct("heat", "c_id")).alias("c_id"))
    links = verified(materialize(stars.select(*pair).distinct(), "stars"))
    for x in (table, crowded, best):
        discard(x)

    known = materialize(alone.drop("comp").join(grouped(links), "id", "left").withColumn("comp", F.coalesce("comp", "id")), "grouped-classes")
    table = segment_rows(known, width, False).join(heat, "id", "left").withColumn("heat", F.coalesce("heat", F.lit(0)))
    best = centers(table)
    met = segment_rows(known, width, True).join(best, "key").withColumn("apart", (F.col("comp") != F.col("c_comp")) & near)
    # a probe of an entry whose texts are all connected to it has nothing to be compared with
    every = materialize(met.where("apart OR texts > 1 AND (own OR mixed OR comp <> c_comp)").select("key", "id", "comp", "peek", "own", "c_id", "texts", "apart"), "met")
    met = every.where("apart").select("key", "id", "comp", "peek", "c_id")
    # of those in an entry itself that are apart from its center, another center
    second = centers(met.join(table.select("key", "id", "heat"), ["key", "id"]))
    again = met.drop("c_id").join(second, "key").where((F.col("comp") != F.col("c_comp")) & near)
    rest = verified(materialize(met.select(*pair).unionByName(again.select(*pair)).distinct(), "pairs"))
    for x in (known, best, second, heat):
        discard(x)
    links = materialize(links.unionByName(rest), "links")
    left = _unconnected(every, grouped(links), classes, similarity)
    return links if left.isEmpty() else links.unionByName(verified(left, looked_at=True))


#: What tells whether two texts may be alike.
_LOOKS = ("n", "fp", "odd")


def _maybe_alike(a: str, b: str, similarity: Fraction) -> F.Column:
    """Of two texts, columns of _LOOKS behind ``{a}_`` and ``{b}_``: by their sets' sizes, all bits of their fingerprints, and their
    odd sketches. The last loses no pair: where two sketches differ, an odd number of hashes are in one set only, so sets differ
    in as many hashes as sketches do in bits, or in more; that crowds of texts just under ``similarity`` fail by."""
    p, q = similarity.numerator, similarity.denominator
    share = differing_share(p / q)
    bits_apart = lambda c: F.aggregate(F.zip_with(f"{a}_{c}", f"{b}_{c}", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    apart = bits_apart("fp")
    least, most = F.least(f"{a}_n", f"{b}_n"), F.greatest(f"{a}_n", f"{b}_n")
    part, bits = F.when(least <= TINY, max(share, TINY_SHARE)).otherwise(share), F.size(f"{a}_fp") * 64
    room = (least + most) * (q - p) >= bits_apart("odd") * (q + p)
    return (least * q >= most * p) & room & (apart <= bits * part + 3 * F.sqrt(bits * part * (1 - part)))


def _unconnected(met: DataFrame, groups: DataFrame, classes: DataFrame, similarity: Fraction) -> DataFrame:
    """(src, dst): pairs without an entry's center that meet in it, are not in one of ``groups`` (id, comp), and may be alike.

    Most texts of an entry are in one group; that one is told apart, so that the join doesn't form the pairs within it.
    """
    crowd = met.where("texts > 1").select("key", "id", "own", (F.col("id") != F.col("c_id")).alias("plain"))
    table = crowd = materialize(crowd.join(groups, "id", "left").withColumn("comp", F.coalesce("comp", "id")), "crowd")
    sizes = crowd.where("plain").groupBy("key", "comp").agg(F.count_if("own").alias("n"))
    biggest = F.max_by("comp", F.struct("n", "comp")).alias("main")
    main = sizes.groupBy("key").agg(biggest, F.count("*").alias("groups"), F.count_if(F.col("n") > 0).alias("with_texts"))
    main = materialize(main.where("groups > 1 AND with_texts > 0").select("key", "main", (F.col("with_texts") > 1).alias("other_texts")), "main-groups")
    # in a main group: texts meet others that probe, and probes meet others' texts; rows without any form no pairs
    in_main = F.col("comp") == F.col("main")
    crowd = crowd.where("plain").join(main, "key").where(~in_main | F.col("own") | F.col("other_texts"))
    crowd = materialize(crowd.select("key", "id", "own", "comp", in_main.alias("in_main"), "other_texts"), "to-compare")
    told, crowd = crowd, crowd.join(classes.select("id", *_LOOKS), "id")
    side = lambda c: [F.col("id").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in ("comp", *_LOOKS))]
    texts = crowd.where("own").select("key", "in_main", *side("b"))
    halves = F.array_compact(F.array(F.when(F.col("other_texts"), F.lit(False)), F.when(~F.col("in_main"), F.lit(True))))
    probes = crowd.select("key", F.explode(halves).alias("in_main"), *side("a"))
    pairs = probes.join(texts, ["key", "in_main"]).where((F.col("a_comp") != F.col("b_comp")) & _maybe_alike("a", "b", similarity))
    pairs = materialize(pairs.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(), "unconnected")
    for x in (met, table, main, told):
        discard(x)
    return pairs


def similar_classes(rows: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(ref, leader) for each row (ref, text): the least ref of its group. Texts are linked if their sets of word shingles
    have a similarity (Jaccard) of ``similarity`` or more; those without words are alike. ``ref`` may be of any type that
    has an order; rows of a null ref take no part and are not returned."""
    from .components import connected_components

    ship(rows.sparkSession)
    rows = rows.where("ref IS NOT NULL")
    width, segments = layout(rows.count(), similarity)
    prints = materialize(wide_prints(rows, shingle, width, segments), "wide-fingerprints")
    firsts = [F.first(c).alias(c) for c in ("n", "own", "weak", "fp", "odd")]  # equal sets have equal ones
    classes = materialize(prints.groupBy("id").agg(F.min("ref").alias("low"), F.count("*").alias("copies"), *firsts), "classes")
    prints = prints.select("ref", "id")
    member = connected_components(similar_links(rows, classes, shingle, width, Fraction(str(similarity)))).withColumnRenamed("node", "id")
    least = materialize(member.join(classes.select("id", "low"), "id").groupBy("component").agg(F.min("low").alias("leader")), "least")
    moved = member.join(least, "component").select("id", "leader")
    group = materialize(
        classes.select("id", "low", "copies").join(moved, "id", "left").where("copies > 1 OR leader IS NOT NULL").select("id", F.coalesce("leader", "low").alias("leader")), "groups"
    )
    for x in (classes, least):
        discard(x)
    return prints.join(group, "id", "left").select("ref", F.coalesce("leader", "ref").alias("leader"))


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, group_id) for each row of ``docs`` with a doc_id: the least doc_id of its group in :func:`similar_classes`."""
    out = similar_classes(docs.select(F.col("doc_id").cast("long").alias("ref"), F.col("text").cast("string").alias("text")), shingle, similarity)
    return out.select(F.col("ref").alias("doc_id"), F.col("leader").alias("group_id"))
