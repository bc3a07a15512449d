"""Near-duplicates by an inverted join on MinHash signature coordinates.

A document's set holds its distinct word shingles. Equal sets are one class, so exact copies cost one row
from then on. Each class is posted under its COORDINATES (coordinate, value) pairs. Two sets with at least
the wanted similarity agree in `least` coordinates or more, but for a chance below `miss`; so they share one
of the `COORDINATES - least + 1` rarest pairs of either (prefix filter), and only those are merged. Pairs of
classes that collide often enough over whole signatures are confirmed on full sets, recomputed from whole texts.

Large groups of near copies are not expanded into all pairs: in STARS rounds each posting list is compared
with one member only, and members already in one component aren't compared again; a last round compares all
pairs that are still in different components. There the members of lists longer than CROWD are posted anew under
pairs of coordinates, of which similar sets share one but for a chance below `miss`; what is crowded even then
is compared in blocks. So no link between different texts is lost and no list is written out as pairs.

Texts move only where a pair needs them, as sets of hashes. Of a pair, the class with fewer pairs moves first, and a
class with more than SPREAD pairs is dealt over salts, so a hub's set is copied once a salt and not once a pair. Null and empty texts, and texts of white space, have
empty sets and are linked with nothing. A text with
fewer words than a shingle has its whole sequence as one. Other columns are ignored; an empty table gives an
empty result. doc_id names a row; identical repeated rows are copies of each other. A row without an id gets the component of its
set, null if no row with an id shares or links it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.graph import components
from ledgerline.llm.storage import discard, materialize
from ledgerline.llm.textarrays import mix, prefix_hash, repeat_of, shingle_hashes, span_hash, text_slices, word_spans

COORDINATES = 32
STARS = 2
CROWD = 32  # posting lists with more open members are split by further coordinates
BLOCK = 512  # members of a list that pairs of coordinates don't split
BLOCK_BYTES = 16 << 20  # of their sets; only a single larger set makes a larger block
SPREAD = 4096  # pairs of one class that meet in one task
SMALL = 200_000  # rows of (id, hash) that may be broadcast: 10 MB at most
_RNG = np.random.default_rng(411)
_ODD = _RNG.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _RNG.integers(0, 2**63, COORDINATES, dtype=np.uint64)
MATCHES = "doc_id long, n_shingles long, component_id long, kept boolean"


def least_collisions(similarity: float, miss: float = 1e-6, n: int = COORDINATES) -> int:
    """The most collisions that can be asked for so that a similar pair has fewer with a chance of at most miss."""
    below = 0.0
    for k in range(n + 1):
        below += math.comb(n, k) * similarity**k * (1 - similarity) ** (n - k)
        if below > miss:
            return max(1, k)
    return n


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the distinct shingles of text i are hashes[first[i]:first[i + 1]]."""
    start, end, first = word_spans(buf, offsets)
    h, first = shingle_hashes(span_hash(prefix_hash(buf, lower=True), start, end), first, size)
    doc = repeat_of(first)
    _, at = np.unique(mix(h + mix(doc.astype(np.uint64))), return_index=True)
    at.sort()
    return h[at], np.searchsorted(doc[at], np.arange(len(offsets)))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, thash, cls, n, sig): cls identifies the set (null if empty), sig is COORDINATES unsigned 32-bit minima. docs: (doc_id, thash, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in text_slices(batch, "text"):
                h, first = shingle_sets(buf, offsets, size)
                n = np.diff(first)
                full = np.flatnonzero(n)
                at = first[:-1][full]
                sig = np.empty((len(full), COORDINATES), np.uint32)
                cls = np.zeros(len(n), np.int64)
                if len(full):
                    for k in range(COORDINATES):
                        sig[:, k] = np.minimum.reduceat((((h ^ _XOR[k]) * _ODD[k]) >> np.uint64(32)).astype(np.uint32), at)
                    cls[full] = mix(np.add.reduceat(mix(h), at) ^ mix(np.bitwise_xor.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), at) + n[full].astype(np.uint64))).view(np.int64)
                sigs = np.full(len(n), None, object)
                sigs[full] = [s.tobytes() for s in sig]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cls, mask=n == 0), pa.array(n), pa.array(sigs, pa.binary())], names=["doc_id", "thash", "cls", "n", "sig"])

    return docs.select("doc_id", "thash", "text").mapInArrow(run, "doc_id long, thash long, cls long, n long, sig binary")


def _postings(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, COORDINATES).astype(np.uint64)
            keys = mix(sig + (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), COORDINATES)), pa.array(keys.reshape(-1).view(np.int64))], names=["cls", "key"])

    return classes.select("cls", "sig").mapInArrow(run, "cls long, key long")


def prefixes(classes: DataFrame, least: int) -> DataFrame:
    """(cls, key): each class under those of its rarest COORDINATES - least + 1 pairs that another class has too."""
    postings = materialize(_postings(classes), "postings")
    often = postings.groupBy("key").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    shared = postings.join(often, "key").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("often", "key"))).alias("keys"))
    take = F.greatest(F.lit(0), F.size("keys") - (least - 1))  # pairs that no other class has are the rarest of all
    out = materialize(shared.select("cls", F.explode(F.slice("keys", F.lit(1), take)).alias("k")).select("cls", "k.key"), "prefixes")
    discard(postings)
    return out


def _ends(pairs: DataFrame) -> DataFrame:
    """(cls, links): how many of the pairs (a, b) each class is in."""
    return pairs.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("links"))


def _meet(pairs: DataFrame, ends: DataFrame, facts: DataFrame) -> DataFrame:
    """Stored pairs (a, b) with facts (cls, value) of both: (a, b, va, vb). ends: what _ends() says of the pairs, stored.

    Of each pair b is the class with more links if that is a hub (more than SPREAD). Values move with a's rows, so a
    hub's value is copied once a salt.
    """
    hubs = ends.filter(F.col("links") > SPREAD)
    hubs = F.broadcast(hubs) if hubs.count() <= SMALL else hubs
    by = lambda cls, links: hubs.select(F.col("cls").alias(cls), F.col("links").alias(links))
    known = pairs.join(by("a", "la"), "a", "left").join(by("b", "lb"), "b", "left").withColumns({x: F.coalesce(x, F.lit(0)) for x in ("la", "lb")})
    swap = F.col("la") > F.col("lb")
    salts = F.greatest(F.lit(1), F.ceil(F.col("links") / SPREAD))
    turned = known.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"), F.greatest("la", "lb").alias("links"))
    turned = turned.withColumn("salt", F.pmod(F.xxhash64("a"), salts)).drop("links")
    one = facts.select(F.col("cls").alias("a"), F.col("value").alias("va"))
    two = facts.join(hubs, "cls", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    two = two.select(F.col("cls").alias("b"), F.col("value").alias("vb"), F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
    return turned.join(one, "a").join(two, ["b", "salt"]).select("a", "b", "va", "vb")


def _collide(pairs: DataFrame, classes: DataFrame, least: int, percent: int) -> DataFrame:
    """(a, b), stored: the pairs (a, b) whose signatures agree in `least` coordinates and whose set sizes allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(-1, COORDINATES) for k in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array((a == b).sum(1) >= least))

    pairs = materialize(pairs, "pairs")
    ends = materialize(_ends(pairs), "ends")
    both = _meet(pairs, ends, classes.select("cls", F.struct("n", "sig").alias("value")))
    both = both.filter((100 * F.col("va.n") >= percent * F.col("vb.n")) & (100 * F.col("vb.n") >= percent * F.col("va.n")))
    out = both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("va.sig").alias("sa"), F.col("vb.sig").alias("sb")).mapInArrow(run, "a long, b long")
    out = materialize(out, "collided")
    discard(pairs, ends)
    return out


def sets_of(wanted: DataFrame, texts: DataFrame, size: int, few: bool) -> DataFrame:
    """(cls, shingles), stored: the full sets of classes (cls, rt: the hash of one of its texts) as sorted 64-bit hashes.

    few: no more than SMALL are wanted, so texts are picked where they lie.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in text_slices(batch, "text"):
                h, first = shingle_sets(buf, offsets, size)
                rows = [np.sort(h[a:b]).tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary())], names=["cls", "shingles"])

    wanted = wanted.select("cls", F.col("rt").alias("thash"))
    some = texts.join(F.broadcast(wanted) if few else wanted, "thash")
    return materialize(some.groupBy("cls").agg(F.min("text").alias("text")).mapInArrow(run, "cls long, shingles binary"), "sets")


def _confirm(pairs: DataFrame, classes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b), stored: the stored pairs (a, b) that are links, on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                (ha, na), (hb, nb) = ((np.frombuffer(b"".join(x := part.column(k).to_pylist()), np.uint64), np.array([len(y) // 8 for y in x])) for k in (2, 3))
                owner = np.concatenate([np.repeat(np.arange(len(part)), n) for n in (na, nb)])
                keys = mix(np.concatenate([ha, hb]) + mix(owner.astype(np.uint64)))
                order = np.argsort(keys)
                common = np.bincount(owner[order][np.flatnonzero(keys[order][1:] == keys[order][:-1])], minlength=len(part))
                yield part.select(["a", "b"]).filter(pa.array(100 * common >= percent * (na + nb - common)))

    ends = materialize(_ends(pairs), "ends")
    sets = sets_of(ends.join(classes.select("cls", "rt"), "cls"), texts, size, ends.count() <= SMALL)
    both = _meet(pairs, ends, sets.withColumnRenamed("shingles", "value")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("va").alias("sa"), F.col("vb").alias("sb"))
    out = materialize(both.mapInArrow(run, "a long, b long").distinct(), "linked")
    discard(sets, ends)
    return out


def _bands(members: DataFrame) -> DataFrame:
    """(key, cls, comp, n): the members (cls, comp, n, sig) of crowded lists, posted anew under pairs of coordinates, whatever lists they come from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint32).reshape(-1, COORDINATES // 2, 2).astype(np.uint64)
            keys = mix(mix((sig[:, :, 0] << np.uint64(32)) + sig[:, :, 1]) + np.arange(COORDINATES // 2, dtype=np.uint64))
            of = pa.array(np.repeat(np.arange(len(batch)), COORDINATES // 2))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), *(batch.column(k).take(of) for k in range(3))], names=["key", "cls", "comp", "n"])

    return members.select("cls", "comp", "n", "sig").distinct().mapInArrow(run, "key long, cls long, comp long, n long")


def _by_size(lists: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lists (key, cls, comp, n, ...) that hold several components: of CROWD members at most, longer ones with `blocks`; and both, stored.

    A list's blocks have about BLOCK members and BLOCK_BYTES of sets.
    """
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") * 8 / BLOCK_BYTES))
    size = lists.groupBy("key").agg(F.count(F.lit(1)).alias("members"), blocks.alias("blocks"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key", "members", "blocks")
    sized = materialize(lists.join(size, "key"), "lists")
    return sized.filter(F.col("members") <= CROWD), sized.filter(F.col("members") > CROWD), sized


def _blocks(members: DataFrame, classes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b), stored: links among members (key, cls, comp, blocks) of crowded posting lists, enough of them to join all that link.

    Each two blocks of a list meet in one task, where full
    sets are compared by counting shared shingles in a matrix product. What leaves a task is a forest over
    components, never all pairs.
    """
    dealt = members.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "cls", "comp")
    wanted = materialize(members.select("cls").distinct().join(classes.select("cls", "rt"), "cls"), "wanted")
    sets = sets_of(wanted, texts, size, wanted.count() <= SMALL)

    def compare(pdf):
        import pandas as pd

        h = np.frombuffer(b"".join(pdf["shingles"]), np.uint64)
        cls, comp, n = pdf["cls"].to_numpy(), pdf["comp"].to_numpy(), np.array([len(x) // 8 for x in pdf["shingles"]])
        _, col, times = np.unique(h, return_inverse=True, return_counts=True)
        shared = times[col] > 1
        owner, col = np.repeat(np.arange(len(n)), n)[shared], np.unique(col[shared], return_inverse=True)[1]
        common = np.zeros((len(n), len(n)), np.float32)
        order = np.argsort(col, kind="stable")
        owner, col = owner[order], col[order]
        for lo in range(0, int(col.max(initial=-1)) + 1, 4096):
            a, b = np.searchsorted(col, [lo, lo + 4096])
            x = np.zeros((len(n), 4096), np.float32)
            x[owner[a:b], col[a:b] - lo] = 1
            common += x @ x.T
        near = (100 * common >= percent * (n[:, None] + n[None, :] - common)) & (comp[:, None] != comp[None, :])
        root = {c: c for c in comp.tolist()}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        out = []
        for a, b in zip(*(x.tolist() for x in np.nonzero(np.triu(near))), strict=True):
            ca, cb = find(comp[a]), find(comp[b])
            if ca != cb:
                root[ca] = cb
                out.append((cls[a], cls[b]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    links = dealt.join(sets, "cls").select("key", "i", "j", "cls", "comp", "shingles").groupBy("key", "i", "j").applyInPandas(compare, "a long, b long").distinct()
    out = materialize(links, "blocks")
    discard(wanted, sets)
    return out


def _links(posted: DataFrame, classes: DataFrame, texts: DataFrame, least: int, size: int, percent: int) -> list[DataFrame]:
    """Links (a, b), stored tables of them, that connect everything that links at all."""
    found: list[DataFrame] = []
    tested: list[DataFrame] = []
    rest, before = posted, None  # lists that may still hold members of several components
    for turn in range(STARS + 1):
        labels = components(_union(found)) if found else None
        if labels is None:
            own = rest.withColumn("comp", F.col("cls"))
        else:
            own = rest.join(labels, rest["cls"] == labels["node"], "left").select("cls", "key", F.coalesce("label", "cls").alias("comp"))
        open_keys = own.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min_by(F.struct("cls", "comp"), F.xxhash64("cls", F.lit(turn))).alias("hub")).filter("lo < hi")
        open_keys = materialize(open_keys.select("key", "hub"), "open-keys")
        own = materialize(own.join(open_keys, "key"), "open")
        discard(open_keys, *(x for x in (labels, before) if x is not None))
        rest, before = own.select("cls", "key"), own
        spent = []
        if turn < STARS:
            pairs = own.filter(F.col("comp") != F.col("hub.comp"))
            pairs = pairs.groupBy("cls", F.col("hub.cls").alias("hub")).agg(F.count(F.lit(1)).alias("often"))
            pairs = pairs.groupBy("cls").agg(F.max_by("hub", F.struct("often", "hub")).alias("hub")).select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b")).distinct()
        else:
            here = own.select("key", "cls", "comp").join(classes.select("cls", "n", "sig"), "cls").select("key", "cls", "comp", "n", "sig")
            few, many, sized = _by_size(here)
            few, spent = few.select("key", "cls", "comp", "n"), [own, sized]
            if not many.isEmpty():
                banded, many, sized = _by_size(_bands(many))
                few, spent = few.unionByName(banded.select("key", "cls", "comp", "n")), [*spent, sized]
            one = few.select("key", F.col("cls").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"))
            two = few.select("key", F.col("cls").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"))
            pairs = one.join(two, "key").filter((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & (100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na"))).select("a", "b").distinct()
            if not many.isEmpty():
                found.append(_blocks(many, classes, texts, size, percent))
        if tested:
            pairs = pairs.join(_union(tested), ["a", "b"], "left_anti")
        collided = _collide(pairs, classes, least, percent)
        discard(*spent)
        if not collided.isEmpty():
            found.append(_confirm(collided, classes, texts, size, percent))
        tested.append(collided)
    discard(*tested)
    return found


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def _decided(docs: DataFrame, size: int, percent: int, miss: float) -> DataFrame:
    """(doc_id, thash, n, cls, label), stored: docs (doc_id, thash, text) with the class and the component of each set; null ones are empty sets."""
    least = least_collisions(percent / 100, miss)
    signed = materialize(signatures(docs, size), "signatures")
    classes = materialize(signed.filter("n > 0").groupBy("cls").agg(F.min("thash").alias("rt"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
    posted = prefixes(classes, least)
    found = _links(posted, classes, docs.select("thash", "text"), least, size, percent)
    out = signed.select("doc_id", "thash", "n", "cls")
    labels = components(_union(found)) if found else None
    if labels is None:
        out = out.withColumn("label", F.col("cls"))
    else:
        out = out.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("doc_id", "thash", "n", "cls", F.coalesce("label", "cls").alias("label"))
    out = materialize(out, "decided")
    discard(signed, classes, posted, *found, *([labels] if labels is not None else []))
    return out


def _hashed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text, F.octet_length(text)).alias("thash"), text.alias("text"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """MATCHES, one row a document: its component's smallest doc_id, and whether it is that document."""
    decided = _decided(_hashed(docs), size, percent, miss)
    smallest = materialize(decided.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("least")), "smallest")
    component = F.coalesce("least", "doc_id")
    return decided.join(smallest, "label", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def without_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """The rows of docs (doc_id, text, any others) that are kept, with all their columns: one of each component.

    That is the row with the smallest id, of several texts under that id the one with the smallest hash, of rows
    that agree in both any one. A row without an id is kept if its component has no row with one. Rows with
    empty sets all stay, but those that repeat an id and a text.
    """
    rows = _decided(_hashed(docs), size, percent, miss).withColumn("rid", F.coalesce("doc_id", F.lit(-(2**63))))
    winners = rows.filter("label is not null").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "rid", "thash")).alias("best"))
    judged = rows.join(materialize(winners, "winners"), "label", "left").withColumn("kept", F.col("best").isNull() | ((F.col("best.rid") == F.col("rid")) & (F.col("best.thash") == F.col("thash"))))
    marks = materialize(judged.groupBy("rid", "thash").agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("rows")).filter("not kept or rows > 1 and rid is not null"), "marks")
    return _apply_marks(docs, marks)


def _apply_marks(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """docs without those marked as not kept, and one of those marked as repeated."""
    text = F.col("text").cast("string")
    names = _free_names(docs, 2)
    keyed = docs.withColumns({names[0]: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), names[1]: F.xxhash64(text, F.octet_length(text))})
    renamed = marks.select(F.col("rid").alias(names[0]), F.col("thash").alias(names[1]), "kept")
    small = marks.count() <= SMALL
    less = lambda part: F.broadcast(part) if small else part
    left = keyed.join(less(renamed.select(*names)), names, "left_anti")
    twice = keyed.join(less(renamed.filter("kept").select(*names)), names, "left_semi").dropDuplicates(names)
    return left.unionByName(twice).select(docs.columns)


def _free_names(docs: DataFrame, n: int) -> list[str]:
    """Column names that docs doesn't have."""
    taken, out, k = {c.lower() for c in docs.columns}, [], 0
    while len(out) < n:
        if (name := f"own_{k}") not in taken:
            out.append(name)
        k += 1
    return out
