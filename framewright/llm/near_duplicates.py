"""Near-duplicate groups by a signature-coordinate inverted join of MinHash signatures.

A document's shingle set has a signature of ``coordinates`` minima; each (coordinate, value) pair is a posting
key. Two sets that reach the similarity agree on at least ``matches`` coordinates (but for a chance that
:func:`miss_chance` states), so they share one of their ``coordinates - matches + 1`` rarest keys:
only that prefix of each document is posted, the frequent rest is skipped and counted by probing the other
signature. Sets with enough agreeing coordinates are confirmed on their full shingle sets.

Equal sets are one node from the start. Every posting list first links its members to one pivot, linear in its
length, which joins large groups of near copies; then pairs in different components are
found by the rarest shingles of their sets, so nothing emits all pairs of a group and yet no link between components is lost.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, batches, documents, mix, sheltered, span_hashes, spent, written

STEP = np.uint64(0x9E3779B97F4A7C15)


def miss_chance(coordinates: int, matches: int, similarity: float) -> float:
    """Chance that sets of that similarity agree on fewer than ``matches`` coordinates."""
    return sum(comb(coordinates, k) * similarity**k * (1 - similarity) ** (coordinates - k) for k in range(matches))


def shingle_sets(texts: pa.Array, width: int):
    """Of each text, the sorted distinct 64-bit hashes of its word shingles; one for the whole of a shorter text.

    A-Z count as a-z, words are parted by ASCII white space; a text without words (or null) has none.
    """
    words = Words(texts, lower=True)
    first, last = words.edges[:-1], words.edges[1:]
    starts = np.arange(len(words.hashes))
    owner_end = np.repeat(last, last - first)
    whole = np.repeat(first, last - first)
    ok = (starts + width <= owner_end) | (starts == whole)  # the latter: a text of fewer words
    starts = starts[ok]
    hashes = span_hashes(words.hashes, starts, np.minimum(starts + width, owner_end[ok]))
    edges = np.searchsorted(starts, words.edges)
    return [np.unique(hashes[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]


def signature_maker(coordinates: int, seed: int = 7):
    random = np.random.default_rng(seed)
    scale = (random.integers(0, 2**63, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
    shift = random.integers(0, 2**63, coordinates, dtype=np.uint64)[:, None]

    def make(shingles: np.ndarray) -> np.ndarray:
        out = np.full(coordinates, 2**32 - 1, np.uint32)
        for k in range(0, len(shingles), 2048):
            np.minimum(out, (((shingles[k : k + 2048] * scale + shift) >> np.uint64(32)).astype(np.uint32)).min(axis=1), out=out)
        return out

    return make


def _table(columns: list, names: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=names)


def _signatures(batch: pa.RecordBatch, coordinates: int) -> np.ndarray:
    values = batch.column(batch.schema.get_field_index("sig"))
    return np.frombuffer(b"".join(values.to_pylist()), np.uint32).reshape(-1, coordinates)


def _keys(signatures: np.ndarray) -> np.ndarray:
    """The posting keys: a 64-bit hash of coordinate number and value."""
    k = np.arange(signatures.shape[1], dtype=np.uint64) << np.uint64(32)
    return mix((signatures.astype(np.uint64) | k) + STEP)


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node, from links (a, b): alternating large-star and small-star rounds.

    Each round is joins and minima, written to the shared folder; only one row comes to the driver.
    """
    edges = written(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).where("v <> m").distinct(), "links")
    while True:
        both = edges.union(edges.select("m", "v"))
        lowest = both.groupBy("v").agg(F.min("m").alias("low")).withColumn("low", F.least("v", "low"))
        large = both.join(lowest, "v").where("m > v").select(F.col("m").alias("v"), F.col("low").alias("m")).distinct()
        least = large.groupBy("v").agg(F.min("m").alias("low"))
        small = large.join(least, "v").select(F.explode(F.array(F.struct("v", F.col("low").alias("m")), F.struct(F.col("m").alias("v"), F.col("low").alias("m"))))).select("col.*").where("v <> m").distinct()
        before, edges = edges, written(small, "links")
        spent(before)
        # Done when no node has two roots and no root has a root.
        ends = edges.select(F.explode(F.array(F.struct(F.col("v").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("root")), F.struct(F.col("m").alias("x"), F.lit(0).alias("child"), F.lit(1).alias("root")))).alias("e")).select("e.*")
        if not ends.groupBy("x").agg(F.sum("child").alias("c"), F.max("root").alias("r")).where("c > 1 OR (c > 0 AND r > 0)").head(1):
            return edges.select(F.col("v").alias("node"), F.col("m").alias("root")).union(edges.select("m", "m").distinct())


def reachable(members: DataFrame, misses: int, large: int) -> DataFrame:
    """Of list members (key, node, root, sig), those that may agree with a member of another component but for ``misses`` coordinates.

    Disagreeing coordinates are a distance. Each component of at least ``large`` members in a list has a centre: a pair across components is at
    least as far apart as the one's distance from the other's centre less the other's own. So a member of a large component
    stays only if it is as far from its centre as the nearest outsider asks for and, where that one is of a large component, too, comes near
    enough to such a one itself; a member of a small component stays if it does so or if there are other small ones. Every member meets each
    centre of its list once.
    """

    def distances(iterator):
        for batch in iterator:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sig", "centre"))
            yield _table([batch.column(c) for c in range(5)] + [pa.array((a != b).sum(axis=1), pa.int32())], ["key", "node", "root", "small", "of", "d"])

    parts = members.groupBy("key", "root").agg(F.min(F.struct("node", "sig")).alias("first"), F.count(F.lit(1)).alias("count"))
    parts = written(parts.withColumn("small", F.col("count") < large), "list-components")
    centres = parts.where("NOT small").select("key", F.col("root").alias("of"), F.col("first.sig").alias("centre"))
    placed = members.join(parts.select("key", "root", "small"), ["key", "root"])
    met = placed.join(centres, "key").select("key", "node", "root", "small", "of", "sig", "centre").mapInArrow(distances, "key long, node binary, root binary, small boolean, of binary, d int")
    met = written(met, "list-distances")
    own, d = F.col("root") == F.col("of"), F.col("d")
    span = met.groupBy("key", "of").agg(F.max(F.when(own, d)).alias("widest"), F.min(F.when(~own & F.col("small"), d)).alias("small_near"), F.min(F.when(~own & ~F.col("small"), d)).alias("large_near"))
    judged = met.join(span, ["key", "of"]).groupBy("key", "node", "root").agg(
        F.bool_or(own & (d >= F.col("small_near") - misses)).alias("to_small"), F.bool_or(own & (d >= F.col("large_near") - misses)).alias("leaves"), F.bool_or(~own & (d <= F.col("widest") + misses)).alias("arrives"),
    )
    singles = parts.where("small").groupBy("key").agg(F.count(F.lit(1)).alias("smalls"))
    judged = placed.join(judged, ["key", "node", "root"], "left").join(singles, "key", "left")
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    stays = F.when(F.col("small"), is_("arrives") | (F.col("smalls") > 1)).otherwise(is_("to_small") | is_("leaves") & is_("arrives"))
    return judged.where(stays).select(*members.columns)


def near_duplicates(
    docs: DataFrame, *, similarity: tuple[int, int] = (4, 5), width: int = 5, coordinates: int = 64, matches: int | None = None,
    doc_id: str = "doc_id", text: str = "text", block: int = 1024, slots: int = 1 << 20,
) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id of the group), kept, tag, group.

    ``tag`` is Spark's xxhash64 of the text and tells rows of one doc_id apart; ``group`` names the component, also where
    two have the same smallest doc_id (null for a row without shingles).

    Texts are linked if intersection / union of their shingle sets is at least ``similarity`` (a fraction of two
    integers). ``matches`` is by default the largest count that a linked pair misses with a chance below 2e-7.
    Null, empty and blank texts have no shingles and link with nothing: such a row is its own group. Repeated
    rows and equal texts are one group; rows that share a doc_id but not the text are judged by their texts.
    Null doc_ids take part but never name a group that has another id. Other columns are ignored.
    """
    num, den = similarity
    if matches is None:
        matches = max(t for t in range(1, coordinates + 1) if t == 1 or miss_chance(coordinates, t, num / den) < 2e-7)
    prefix = coordinates - matches + 1

    def sign(iterator):
        make = signature_maker(coordinates)
        for batch in batches(iterator, "text"):
            sizes, nodes, sigs = [], [], []
            for shingles in shingle_sets(batch.column(1), width):
                sizes.append(len(shingles))
                nodes.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                sigs.append(make(shingles).tobytes())
            yield _table([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "tag", "n", "node", "sig"])

    def count(iterator):
        for batch in iterator:
            yield _table([pa.array(_keys(_signatures(batch, coordinates)).ravel().view(np.int64))], ["key"])

    def posts(seen):
        def run(iterator):
            often = seen.value
            for batch in iterator:
                keys = _keys(_signatures(batch, coordinates))
                rank = (often[(keys & np.uint64(slots - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(40)) | (keys >> np.uint64(24))
                rarest = np.argpartition(rank, prefix - 1, axis=1)[:, :prefix]
                row = np.repeat(np.arange(batch.num_rows), prefix)
                row = pa.array(row)
                yield _table([pa.array(np.take_along_axis(keys, rarest, 1).ravel().view(np.int64)), *(batch.column(c).take(row) for c in range(3))], ["key", "node", "n", "lead"])

        return run

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed = written(rows.withColumn("tag", F.xxhash64("text")).mapInArrow(sign, "doc_id long, tag long, n long, node binary, sig binary"), "signatures")
    lead = F.coalesce(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "tag"))), F.min(F.struct("doc_id", "tag"))).alias("lead")
    nodes = signed.where("n > 0").groupBy("node").agg(lead, F.first("n").alias("n"), F.first("sig").alias("sig"))
    nodes = written(nodes.select("node", F.col("lead.doc_id").alias("lead"), F.col("lead.tag").alias("lead_tag"), "n", "sig"), "nodes")

    # How often the frequent keys occur, as a fixed number of slots: any function of the key gives a valid prefix order.
    counted = nodes.select("sig").mapInArrow(count, "key long").groupBy("key").count().where("count >= 16")
    slot = counted.groupBy(F.col("key").bitwiseAND(F.lit(slots - 1)).cast("int").alias("slot")).agg(F.max("count").alias("n")).toArrow()
    often = np.zeros(slots, np.uint32)
    often[slot["slot"].to_numpy()] = np.minimum(slot["n"].to_numpy(), 2**23)
    seen = docs.sparkSession.sparkContext.broadcast(often)
    # Postings are cheaper to make again than to keep: first the keys that several nodes have, by counts alone.
    post = nodes.select("node", "n", "lead", "sig").mapInArrow(posts(seen), "key long, node binary, n long, lead long")
    several = written(post.select("key").groupBy("key").count().where("count > 1").select("key"), "shared-keys")
    members = written(post.join(several, "key"), "shared-postings")
    spent(several)
    # The pivot is the earliest document: near copies are closer to their original than to each other.
    lists = written(members.groupBy("key").agg(F.min(F.struct("lead", "node", "n")).alias("pivot")), "list-pivots")
    shared = members.drop("lead").join(lists, "key")
    near = lambda a, b: F.least(a, b) * den >= F.greatest(a, b) * num

    def counted_pairs(iterator):
        for batch in iterator:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(-1, coordinates) for k in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array((a == b).sum(axis=1) >= matches))

    def fetch(iterator):
        for batch in batches(iterator, "text"):
            rows, sets = [], []
            for row, (node, shingles) in enumerate(zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), width))):
                shingles = shingles.tobytes()
                if xxhash.xxh3_128_digest(shingles) == node:
                    rows.append(row)
                    sets.append(shingles)
            rows = pa.array(rows, pa.int64())
            yield _table([batch.column(0).take(rows), batch.column(2).take(rows), pa.array(sets, pa.binary())], ["node", "root", "shingles"])

    def shingles_of(wanted: DataFrame) -> DataFrame:
        """(node, root, shingles) of the wanted (node, root); their texts are read again, by id and hash."""
        wanted = wanted.join(nodes.select("node", "lead", "lead_tag"), "node")
        lead = F.col("doc_id").eqNullSafe(F.col("lead")) & (F.xxhash64("text") == F.col("lead_tag"))
        sets = rows.join(wanted, lead).select("node", "text", "root").mapInArrow(fetch, "node binary, root binary, shingles binary")
        return written(sets.groupBy("node").agg(F.first("root").alias("root"), F.first("shingles").alias("shingles")), "shingle-sets")

    def confirm(iterator):
        for batch in batches(iterator, "b_set"):
            ok = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
                ok.append(both * den >= (len(a) + len(b) - both) * num)
            yield _table([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs that agree on enough coordinates and whose full shingle sets reach the similarity."""
        sig = lambda x: nodes.select(F.col("node").alias(x), F.col("sig").alias(f"{x}_sig"))
        counted = pairs.join(sig("b"), "b").join(sig("a"), "a").select("a", "b", "a_sig", "b_sig").mapInArrow(counted_pairs, "a binary, b binary")
        side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"{x}_set"))
        return written(counted.join(side("b"), "b").join(side("a"), "a").select("a", "b", "a_set", "b_set").mapInArrow(confirm, "a binary, b binary"), "near-links")

    star = shared.select(F.col("pivot.node").alias("a"), F.col("node").alias("b")).where((F.col("a") != F.col("b")) & near(F.col("pivot.n"), F.col("n"))).distinct()
    star = written(star, "star-pairs")
    spent(lists)
    star_sets = shingles_of(star.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")))
    links = confirmed(star, star_sets)
    spent(star, star_sets)

    def bytes_of(iterator):
        for batch in iterator:
            sig = _signatures(batch, coordinates).astype(np.uint8)
            yield _table([batch.column(0), pa.array([s.tobytes() for s in sig], pa.binary())], ["node", "sig"])

    # What is left are lists that hold several components. A member that agrees often enough with one of another
    # component stays open. Members of a list's largest component are compared with the others alone, which are few beside a
    # large group of near copies, block by block, on a byte of each coordinate; only members come out.
    def left_open(iterator):
        def members(group):
            n = group.column("n").to_numpy()
            _, root = np.unique(np.array([r.hex() for r in group.column("root").to_pylist()]), return_inverse=True)
            sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint8).reshape(-1, coordinates)
            own, other = (np.flatnonzero(group.column(c).to_numpy()) for c in ("own", "other"))
            hit = np.zeros(len(n), bool)
            for k in range(0, len(own), 32):
                a = own[k : k + 32]
                ok = (sig[a][:, None, :] == sig[other][None, :, :]).sum(axis=2) >= matches
                ok &= (root[a][:, None] != root[other][None, :]) & (np.minimum(n[a][:, None], n[other][None, :]) * den >= np.maximum(n[a][:, None], n[other][None, :]) * num)
                hit[a] |= ok.any(axis=1)
                hit[other] |= ok.any(axis=0)
            return np.flatnonzero(hit)

        def run(table, last):
            key = np.stack([table.column(c).to_numpy() for c in ("key", "with_main", "i", "j")], axis=1)
            edges = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(key)]])
            stop = len(edges) - 1 if last else len(edges) - 2
            rows = [a + members(table.slice(a, b - a)) for a, b in zip(edges[:stop].tolist(), edges[1 : stop + 1].tolist()) if b - a > 1]
            found = table.select(["node", "root"]).take(pa.array(np.concatenate([np.zeros(0, np.int64), *rows])))
            return found.combine_chunks().to_batches(), (None if last else table.slice(edges[-2]))

        held = None
        for batch in iterator:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
            if table.num_rows:
                found, held = run(table, False)
                yield from found
        if held is not None and held.num_rows:
            yield from run(held, True)[0]

    rooted = members.select("key", "node", "n").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = written(rooted, "rooted-postings")
    spent(members)
    # Of a list that takes more than a block, only members within reach of another component are compared.
    counts = rooted.groupBy("key", "root").count().groupBy("key").agg(F.max("count").alias("main"), F.sum("count").alias("m"), F.count(F.lit(1)).alias("roots"))
    wide = written(counts.where((F.col("roots") > 1) & (F.col("m") > block)).select("key"), "wide-lists")
    if wide.head(1):
        every = rooted
        held = every.join(wide, "key").join(nodes.select("node", "sig").mapInArrow(bytes_of, "node binary, sig binary"), "node").select("key", "node", "n", "root", "sig")
        held = written(held, "wide-postings")
        rooted = written(every.join(wide, "key", "left_anti").select("key", "node", "n", "root").union(reachable(held, coordinates - matches, block).drop("sig")), "rooted-postings")
        spent(every, held)
    spent(wide)
    mixed = rooted.groupBy("key", "root").count().groupBy("key").agg(F.max(F.struct("count", "root")).alias("main"), F.sum("count").alias("m"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    blocks = lambda m: F.ceil(m / block).cast("int")
    mixed = written(mixed.select("key", F.col("main.root").alias("main"), blocks(F.col("m") - F.col("main.count")).alias("others"), blocks(F.col("main.count")).alias("mains")), "mixed-lists")
    dealt = rooted.join(mixed, "key").withColumn("in_main", F.col("root") == F.col("main"))
    part = F.pmod(F.xxhash64("node"), F.when(F.col("in_main"), F.col("mains")).otherwise(F.col("others"))).cast("int")
    each = lambda count, make: F.transform(F.sequence(F.lit(0), F.col(count) - 1), make)
    place = lambda main, i, j, own, other: F.struct(F.lit(main).alias("with_main"), i.alias("i"), j.alias("j"), own.alias("own"), other.alias("other"))
    yes, no, p = F.lit(True), F.lit(False), F.col("part")
    with_others = each("others", lambda k: place(0, F.least(p, k), F.greatest(p, k), (p <= k), (p >= k)))
    with_mains = each("mains", lambda k: place(1, p, k, yes, no))
    places = F.when(F.col("in_main"), each("others", lambda k: place(1, k, p, no, yes))).otherwise(F.concat(with_others, with_mains))
    dealt = dealt.withColumn("part", part).select("key", "node", "root", "n", F.explode(places).alias("x")).select("key", "x.*", "node", "root", "n")
    dealt = dealt.join(nodes.select("node", "sig").mapInArrow(bytes_of, "node binary, sig binary"), "node").select("key", "with_main", "i", "j", "own", "other", "node", "root", "n", "sig")
    undone = dealt.repartition("key", "with_main", "i", "j").sortWithinPartitions("key", "with_main", "i", "j", "node").mapInArrow(left_open, "node binary, root binary").distinct()

    # Among the open nodes, pairs of different components are found by the rarest shingles of their full sets: sets that
    # reach the similarity share one of the n - ceil(n * similarity) + 1 rarest, and the places of the first shared
    # one bound what they can share.
    open_ = shingles_of(undone)
    spent(rooted, mixed)

    def frequent(iterator):
        """Slots that hold over twice the mean of this task's shingles."""
        counts = np.zeros(slots, np.int64)
        for batch in batches(iterator, "shingles"):
            every = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64)
            counts += np.bincount((every & np.uint64(slots - 1)).astype(np.int64), minlength=slots)
        often = np.flatnonzero(counts > max(1, 2 * counts.mean()))
        yield _table([pa.array(often, pa.int32()), pa.array(counts[often])], ["slot", "n"])

    def rarest(ranks):
        def run(iterator):
            often = ranks.value
            for batch in batches(iterator, "shingles"):
                columns = []
                for row, raw in enumerate(batch.column(2)):
                    shingles = np.frombuffer(raw.as_buffer(), np.uint64)
                    n = len(shingles)
                    order = np.lexsort((shingles, often[(shingles & np.uint64(slots - 1)).astype(np.int64)]))[: n - -(-n * num // den) + 1]
                    columns.append((np.full(len(order), row), np.full(len(order), n), np.arange(len(order)), shingles[order]))
                row, n, at, shingle = (np.concatenate(c) for c in zip(*columns))
                row = pa.array(row)
                yield _table([pa.array(shingle.view(np.int64)), batch.column(0).take(row), batch.column(1).take(row), pa.array(n), pa.array(at)], ["shingle", "node", "root", "n", "at"])

        return run

    slot = open_.select("shingles").mapInArrow(frequent, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most a row per slot
    often = np.zeros(slots, np.uint32)
    often[slot["slot"].to_numpy()] = np.minimum(slot["n"].to_numpy(), 2**32 - 1)
    ranks = docs.sparkSession.sparkContext.broadcast(often)
    rare = written(open_.select("node", "root", "shingles").mapInArrow(rarest(ranks), "shingle long, node binary, root binary, n long, at long"), "rare-shingles")
    several = rare.groupBy("shingle", "root").count().groupBy("shingle").agg(F.max(F.struct("count", "root")).alias("main"), F.count(F.lit(1)).alias("roots"))
    several = written(several.where("roots > 1").select("shingle", F.col("main.root").alias("main")), "shared-shingles")
    every, rare = rare, written(rare.join(several, "shingle"), "shared-rare-shingles")
    spent(every, several)
    # A list's largest component meets the others alone.
    x, y = (rare.select("shingle", "main", *(F.col(c).alias(f"{k}_{c}") for c in ("node", "root", "n", "at"))) for k in "xy")
    rest = F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at"))
    cross = x.where("x_root <> main").join(y.drop("main"), "shingle")
    cross = cross.where((F.col("x_root") != F.col("y_root")) & ((F.col("y_root") == F.col("main")) | (F.col("x_node") < F.col("y_node"))) & near(F.col("x_n"), F.col("y_n")) & (rest * (num + den) >= (F.col("x_n") + F.col("y_n")) * num))
    cross = written(cross.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct(), "cross-pairs")
    spent(rare)
    links = links.union(confirmed(cross, open_))
    spent(cross, open_)

    found = components(links).join(nodes.select("node", "lead"), "node")
    named = found.join(found.groupBy("root").agg(F.min("lead").alias("component_id")), "root").select("node", "component_id", "root")
    named = nodes.select("node", "lead").join(named, "node", "left").select("node", F.coalesce("component_id", "lead").alias("component_id"), F.coalesce("root", "node").alias("group"))
    full = signed.where("n > 0").select("doc_id", "n", "tag", "node").join(named, "node").select("doc_id", "n", "component_id", "tag", "group")
    out = full.union(signed.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), "tag", F.lit(None).cast("binary")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "tag", "group")


@sheltered
def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without near duplicates: of each group the rows of its smallest doc_id, and of those one.

    Rows without words are groups of their own; rows that repeat doc_id and text stay once. All columns stay.
    """
    keys = near_duplicates(docs, **options).where("kept").groupBy("doc_id", "tag", "group").count()
    keys = written(keys.groupBy("doc_id", F.coalesce("group", F.col("tag").cast("string").cast("binary")).alias("group")).agg(F.min("tag").alias("tag"), F.max("count").alias("rows")), "kept")
    keys = keys.groupBy(F.col("doc_id").alias("__doc"), F.col("tag").alias("__tag")).agg(F.max("rows").alias("__rows"))
    kept = docs.join(keys, docs["doc_id"].cast("long").eqNullSafe(F.col("__doc")) & (F.xxhash64(docs["text"]) == F.col("__tag")))
    if keys.where("__rows > 1").head(1):
        kept = kept.dropDuplicates(["__doc", "__tag"])
    return kept.select(*[kept[c] for c in docs.columns])


def op2_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Groups of all documents: three-word shingles, similarity of 0.85 or more."""
    return near_duplicates(documents(spark, sf_dir), similarity=(17, 20), width=3).select("doc_id", "n_shingles", "component_id", "kept")


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g
  FROM d WHERE w IS NOT NULL),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS v, doc_id AS u FROM n UNION SELECT r.v, l.b FROM r JOIN l ON r.u = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.c, d.doc_id)::BIGINT AS component_id,
  d.doc_id = coalesce(m.c, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT v, min(u) AS c FROM r GROUP BY v) m ON m.v = d.doc_id
"""
