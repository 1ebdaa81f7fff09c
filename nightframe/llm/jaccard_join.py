"""Exact n-gram Jaccard join in the metric space of shingle sets (operator 4).

Documents are points, the distance is one minus the Jaccard similarity, and
points within the radius are linked. Nearly all documents are at the greatest
distance from any pivot, where Voronoi cells separate nothing, so the space is
first cut where no link can cross:

1. Screen. A point shares at least a known number of its first fingerprints (in
   hash order) with any linked point. Points that share fewer with all others
   have no link and leave; equal sets become one point.
2. Islands. A point must share ``ceil(s n)`` of its shingles with others. In one
   global order of shingles, rare ones first, linked points share one of their
   first ``n - ceil(s n) + 1``. Points that are joined by chains of such shared
   shingles form an island; linked points lie on the same one.
3. Regions. An island beyond the size of a leaf draws pivots, the most central
   points and random ones. Distances to them are computed exactly; points within
   the radius of a pivot join it. Each point's home is the Voronoi region of its
   nearest pivot (a region of its own holds those far from every pivot). The
   triangle inequality gives the windows: a point is replicated to the regions of
   earlier pivots in which a linked point could be at home. Points of which no
   partner of a fitting size could be linked leave. Regions are split again until
   they are leaves, or hold one component only.
4. Rest. Where windows do not halve the work of a region (its points are about as
   far from each other as from any pivot), its points outside the largest known
   component meet that component and each other in blocks: every pair of
   different components still meets, within bounded tasks.
5. Leaves are joined exactly in their tasks, from an inverted list of their shared
   shingles, and give out a forest of links: never more rows than points.

No link is lost: components are exact, whatever the sizes and limits.

Shingles are compared by 64-bit hashes. That counts only between the sets of two
compared documents (a chance of n^2 / 2^64 that one number is wrong); equal sets
are told by two such sums and their size.

Words are split at ASCII white space and A-Z are lower-cased; fewer words than
``width`` make one shingle. Nulls and texts without words have an empty set and
link with nothing; null ids link with nothing and have no component; rows of one
id count as one document's versions; an empty table gives an empty result; other
columns are left alone.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import scratch
from .components import components
from .sharing import KEPT, shared
from .textbytes import LOWER, SpanHash, mix, runs, slices, text_bytes, windows, word_spans

WIDTH = 5
PERCENT = 75
#: Share of a set, beyond the part a link may lose, that the screen looks at.
EXTRA = 10
#: Points and shingles of a leaf; beyond either a region is split.
LEAF, WEIGHT = 512, 1 << 21
#: Pivots of a region: so many central points, and as many random ones.
CENTRES = 4
#: Distance beyond which a pivot is no point's home.
FAR = 0.5
#: Ids that may be broadcast: some tens of bytes each in the driver, and nothing else is.
BROADCAST_IDS = 1 << 18
#: Bytes of text whose shingles are held at once (a longer text stands alone).
SLICE = 1 << 20
#: Steps of the scale on which sizes of sets are counted.
STEP = 1.01


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int):
    """(row, hash) of the distinct shingles of each row, in hash order within a row; and their numbers."""
    starts, ends, first = word_spans(data, offsets)
    words = SpanHash(data, LOWER).of(starts, ends)
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, 0)
    row = np.repeat(np.arange(len(n)), count)
    h = windows(words, width)[np.repeat(first[:-1], count) + runs(count)] if count.any() else np.zeros(0, np.uint64)
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            more = n[short] > k
            at = np.minimum(first[short] + k, len(words) - 1)
            whole = np.where(more, mix(whole * np.uint64(31) + words[at] + np.uint64(k + 1)), whole)
        row, h = np.append(row, short), np.append(h, whole)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    keep = np.append(True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])) if len(row) else np.zeros(0, bool)
    row, h = row[keep], h[keep]
    return row, h, np.bincount(row, minlength=len(n))


def overlap(n, percent: int):
    """Least number of shared shingles of a point with ``n`` and any linked one."""
    return -(-np.asarray(n, np.int64) * percent // 100)


def _screen(n: np.ndarray, percent: int):
    """(fingerprints a point shows, shared ones it needs): the first common ones of a linked pair are shown by both."""
    extra = np.maximum(1, n * EXTRA // 100)
    extra = np.minimum(extra, overlap(n, percent))
    return np.minimum(n, n - overlap(n, percent) + extra), np.maximum(1, extra - 1)


def _screen_entries(width: int, percent: int):
    def entries(batches):
        for batch, data, offsets in slices(batches, "text", SLICE):
            row, h, n = shingle_sets(data, offsets, width)
            shown, _ = _screen(n, percent)
            keep = runs(n) < np.repeat(shown, n)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            some = n > 0
            yield ids[row[keep]], h[keep], ids[some], _screen(n, percent)[1][some]

    return entries


def _alive(docs, edge, _, need):
    """Documents that share as many of the fingerprints they show as a link takes."""
    return {"doc_id": pa.array(docs[np.diff(edge) >= need], pa.int64())}


def _sets(width: int, percent: int):
    """docs with alive -> (doc_id, n, two set hashes, shingles of those that may have a link)."""
    names = ["doc_id", "n", "h1", "h2", "shingles"]

    def run(batches):
        for batch, data, offsets in slices(batches, "text", SLICE):
            _, h, n = shingle_sets(data, offsets, width)
            alive = batch.column("alive").fill_null(False).to_numpy(zero_copy_only=False) & (n > 0)
            stop = np.append(0, np.cumsum(n))
            sums = [np.append(np.uint64(0), np.cumsum(x, dtype=np.uint64)) for x in (h, mix(h + np.uint64(0x51ED)))]
            raw, at = h.tobytes(), stop.tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n.astype(np.int32)), *(pa.array((s[stop[1:]] - s[stop[:-1]]).view(np.int64)) for s in sums), pa.array([raw[8 * a : 8 * b] if x else None for a, b, x in zip(at, at[1:], alive)], pa.binary())],
                names,
            )

    return run, "doc_id long, n int, h1 long, h2 long, shingles binary"


def _point_entries(batches):
    """All shingles of points, and how many each has."""
    for batch in batches:
        if batch.num_rows:
            data, offsets = text_bytes(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            n = np.diff(offsets) // 8
            yield np.repeat(ids, n), np.frombuffer(data.tobytes(), np.uint64), ids, n


def _cells(percent: int):
    """Shared shingles of points -> (cell, point, n, near): the rare ones name a point's cells; how many others have of them."""

    def finish(points, edge, h, n):
        near = np.diff(edge)
        row = np.repeat(np.arange(len(points)), near)
        # of n - least + 1 shingles, rare ones first, the point's own come first; all points agree on the order of the rest
        take = near - overlap(n, percent) + 1
        order = np.lexsort((h, h & np.uint64(0xFF00), row))
        h, row = h[order], row[order]
        keep = runs(near) < take[row]
        row = row[keep]
        return {"cell": pa.array((h[keep] & KEPT).view(np.int64)), "point": pa.array(points[row]), "n": pa.array(n[row], pa.int32()), "near": pa.array(near[row], pa.int32())}

    return finish, "cell long, point long, n int, near int"


def _islands(points: DataFrame, percent: int, tables: scratch.Working, many: bool) -> DataFrame:
    """(region, point, n, near, label): the island of each point that may have a link."""
    finish, schema = _cells(percent)
    cells = tables.written(shared(points, _point_entries, "point", "shingles", finish, schema), "cells")
    first = cells.groupBy("cell").agg(F.min("point").alias("a"), F.max("point").alias("z")).filter("a < z").drop("z")
    edges = cells.join(scratch.dealt(first, many), "cell").select("a", F.col("point").alias("b")).distinct()
    islands = components(edges).select(F.col("node").alias("point"), F.col("component").alias("region"))
    mine = cells.groupBy("point").agg(F.first("n").alias("n"), F.first("near").alias("near"))
    return islands.join(scratch.dealt(mine, many), "point").select("region", "point", "n", "near", F.col("point").alias("label"))


def _sets_of(table):
    """(shingles of all rows, row of each) of an Arrow table."""
    data, offsets = text_bytes(table.column("shingles"))
    return np.frombuffer(data.tobytes(), np.uint64), np.repeat(np.arange(table.num_rows), np.diff(offsets) // 8)


def _roots(label: np.ndarray, pairs) -> np.ndarray:
    """``label`` (small numbers) after the given pairs of labels became one."""
    for a, b in pairs:
        a, b = label[a], label[b]
        if a != b:
            label[label == max(a, b)] = min(a, b)
    return label


def _leaf(percent: int):
    """All rows of a leaf -> links (a, b) that join its components: fewer than it has points."""

    def run(table):
        out = ([], [])
        point = table.column("point").to_numpy()
        order = np.flatnonzero(np.append(True, np.diff(np.sort(point)) > 0))
        if len(order) < len(point):  # a point replicated twice into one leaf
            table = table.take(pa.array(np.unique(point, return_index=True)[1]))
            point = table.column("point").to_numpy()
        _, label = np.unique(table.column("label").to_numpy(), return_inverse=True)
        n = table.column("n").to_numpy().astype(np.int64)
        if len(point) > 1 and label.max() > 0:
            h, row = _sets_of(table)
            _, word, df = np.unique(h, return_inverse=True, return_counts=True)
            keep = df[word] > 1
            word, row = word[keep], row[keep]
            near = np.bincount(row, minlength=len(point))
            order = np.argsort(word, kind="stable")
            posts, start = row[order], np.append(0, np.cumsum(np.bincount(word, minlength=len(df))))
            mine = np.append(0, np.cumsum(near))
            own = label == np.bincount(label).argmax()
            # pairs within the largest known component need no look, all others are seen from the point outside it
            for x in np.flatnonzero(~own & (near >= overlap(n, percent))).tolist():
                w = word[mine[x] : mine[x + 1]]
                long = start[w + 1] - start[w]
                common = np.bincount(posts[np.repeat(start[w], long) + runs(long)], minlength=len(point))
                for y in np.flatnonzero((100 * common >= percent * (n[x] + n - common)) & (label != label[x])).tolist():
                    if label[x] != label[y]:
                        out[0].append(point[x])
                        out[1].append(point[y])
                        label = _roots(label, [(x, y)])
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return run, "a long, b long"


def _partner(n: np.ndarray, near: np.ndarray, sizes: np.ndarray, many: np.ndarray, percent: int) -> np.ndarray:
    """Whether the region has another point of a size with which a link is possible.

    A link with a point of size m needs ``percent / (100 + percent) * (n + m)`` common shingles, and ``near`` is the
    most there can be; and m is at least ``percent`` of n. ``sizes`` are classes of the scale, ``many`` their points.
    """
    top = np.floor(near * (100 + percent) / percent - n + 1e-6)
    low = np.floor(np.log(np.maximum(1, n * percent / 100)) / np.log(STEP)) - 1
    high = np.where(top >= 1, np.floor(np.log(np.maximum(1, top)) / np.log(STEP)) + 1, -1)
    sums = np.append(0, np.cumsum(many))
    seen = sums[np.searchsorted(sizes, high, "right")] - sums[np.searchsorted(sizes, low, "left")]
    own = np.floor(np.log(n) / np.log(STEP))
    return (seen - ((own >= low) & (own <= high))) > 0


def _measured(percent: int):
    """A chunk of a region and its pivots (``pivot`` >= 0) -> links with pivots, homes and windows of its points."""

    def run(table):
        at = table.column("pivot").to_numpy()
        pivots = table.filter(pa.array(at >= 0)).sort_by("pivot")
        rows = table.filter(pa.array(at < 0))
        h, row = _sets_of(rows)
        n, point, label = (rows.column(c).to_numpy().astype(np.int64) for c in ("n", "point", "label"))
        pn, pp = pivots.column("n").to_numpy().astype(np.int64), pivots.column("point").to_numpy()
        ph, prow = _sets_of(pivots)
        sets = [ph[prow == k] for k in range(len(pp))]

        def common(h, row, size):
            hit = lambda s: np.isin(h, s) if len(s) else np.zeros(len(h), bool)
            return np.stack([np.bincount(row[hit(s)], minlength=size) for s in sets], 1)

        c, cp = common(h, row, len(n)), common(ph, prow, len(pp))
        far = 1 - c / (n[:, None] + pn - c)
        linked = 100 * c >= percent * (n[:, None] + pn - c)
        joined = np.arange(len(pp))
        # by the links that are given out: of each point that with the first pivot within the radius
        for i, j in enumerate((100 * cp >= percent * (pn[:, None] + pn - cp)).argmax(1)):
            joined = _roots(joined, [(i, j)])
        first = linked.argmax(1)
        some = linked.any(1)
        sizes = np.array(pivots.column("sizes")[0].as_py(), np.int64).reshape(-1, 2)
        sizes = sizes[np.argsort(sizes[:, 0])]
        live = _partner(n, rows.column("near").to_numpy().astype(np.int64), sizes[:, 0], sizes[:, 1], percent) | some
        r = 1 - percent / 100
        home = np.where(far.min(1) < FAR, far.argmin(1), len(pp))
        near = far[np.arange(len(n)), np.minimum(home, len(pp) - 1)]
        reach = np.where(home < len(pp), near + 2 * r, FAR + r) + 1e-9
        window = (far <= reach[:, None]) & (np.arange(len(pp)) < home[:, None])
        window[np.arange(len(n))[home < len(pp)], home[home < len(pp)]] = True
        places = [[*np.flatnonzero(w).tolist(), *([len(pp)] if k == len(pp) else [])] for w, k in zip(window, home.tolist())]
        return pa.table({
            "region": rows.column("region"), "point": pa.array(point), "n": rows.column("n"), "near": rows.column("near"),
            "label": pa.array(np.where(some, pp[joined[first]], label)),
            "to": pa.array(np.where(some & (pp[first] != point), pp[first], -1)),
            "places": pa.array([p if x else [] for p, x in zip(places, live)], pa.list_(pa.int32())),
        })

    return run, "region long, point long, n int, near int, label long, to long, places array<int>"


def _split(big: DataFrame, points: DataFrame, percent: int, level: int, leaf: int, weight: int, tables: scratch.Working, many: bool):
    """(links with pivots, child regions, blocks of those that no window splits) of regions (region, point, n, near, label, chunks)."""
    draw = F.xxhash64(F.lit(level), "point")
    orders = ([(-F.col("near") / F.col("n")), draw], [draw])
    picks = None
    for k, order in enumerate(orders):
        best = Window.partitionBy("region").orderBy(*order, "point")
        some = big.withColumn("pivot", F.row_number().over(best)).filter(F.col("pivot") <= CENTRES).withColumn("pivot", F.col("pivot") + k * CENTRES)
        picks = some if picks is None else picks.union(some)
    picks = picks.groupBy("region", "point").agg(F.min("pivot").alias("pivot"), *(F.first(c).alias(c) for c in ("n", "near", "label", "chunks")))
    scale = F.floor(F.log("n") / F.log(F.lit(STEP)))
    sizes = big.groupBy("region", scale.alias("size")).count().groupBy("region").agg(F.flatten(F.collect_list(F.array("size", "count"))).alias("sizes"))
    columns = ["region", "chunk", "pivot", "point", "n", "near", "label", "sizes"]
    told = picks.join(scratch.dealt(sizes, many), "region").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(*columns)
    dealt = big.withColumns({"chunk": F.pmod(F.xxhash64("point"), F.col("chunks")).cast("int"), "pivot": F.lit(-1), "sizes": F.lit(None).cast("array<bigint>")}).select(*columns)
    run, schema = _measured(percent)
    rows = told.union(dealt).join(scratch.dealt(points.select("point", "shingles"), many), "point")
    seen = tables.written(rows.groupBy("region", "chunk").applyInArrow(run, schema), "measured")
    links = seen.filter("to >= 0").select(F.col("point").alias("a"), F.col("to").alias("b"))
    left = seen.filter(F.size("places") > 0)
    total = left.groupBy("region").agg(F.count("*").alias("m"))
    child = left.withColumn("place", F.explode("places"))
    parts = child.groupBy("region", "place").agg(F.count("*").alias("k"))
    halved = parts.groupBy("region").agg(F.sum(F.col("k") * F.col("k")).alias("work")).join(scratch.dealt(total, many), "region").select("region", (F.col("work") <= F.col("m") * F.col("m") / 2).alias("halved"))
    narrow = ["region", "point", "n", "near", "label"]
    children = child.join(scratch.dealt(halved.filter("halved"), many), "region").withColumn("region", F.xxhash64("region", "place")).select(*narrow)
    # the rest: points of the largest known component, and all others
    by_label = left.groupBy("region", "label").agg(F.count("*").alias("k"), F.sum("n").alias("w"))
    rest = by_label.join(scratch.dealt(halved.filter("not halved"), many), "region").groupBy("region").agg(F.max_by("label", "k").alias("main"), F.max("k").alias("in_main"), F.sum("k").alias("k"), F.max_by("w", "k").alias("w_main"), F.sum("w").alias("w"))
    blocks = lambda k, w: F.greatest(F.ceil(k * 2 / leaf), F.ceil(w * 2 / weight), F.lit(1)).cast("int")
    rest = rest.filter("in_main < k").select("region", "main", blocks(F.col("in_main"), F.col("w_main")).alias("g_main"), blocks(F.col("k") - F.col("in_main"), F.col("w") - F.col("w_main")).alias("g"))
    pool = left.join(scratch.dealt(rest, many), "region")
    inside = F.col("label") == F.col("main")
    own = F.when(inside, F.pmod(F.xxhash64("point"), F.col("g_main"))).otherwise(F.pmod(F.xxhash64("point"), F.col("g"))).cast("int")
    others = F.sequence(F.lit(0), F.col("g") - 1)
    meet = F.when(inside, F.transform(others, lambda j: F.struct(j.alias("a"), (-1 - F.col("own")).alias("b")))).otherwise(
        F.concat(
            F.transform(others, lambda j: F.struct(F.least(j, F.col("own")).alias("a"), F.greatest(j, F.col("own")).alias("b"))),
            F.transform(F.sequence(F.lit(0), F.col("g_main") - 1), lambda j: F.struct(F.col("own").alias("a"), (-1 - j).alias("b"))),
        )
    )
    met = pool.withColumn("own", own).withColumn("meet", F.explode(meet)).withColumn("region", F.xxhash64("region", "meet.a", "meet.b")).select(*narrow)
    return links, children, met


def link_components(points: DataFrame, percent: int = PERCENT, leaf: int = LEAF, weight: int = WEIGHT) -> DataFrame:
    """(point, component) of all points (point, n, shingles: distinct sets in hash order)."""
    run, schema = _leaf(percent)
    tables, many = scratch.Working(points.sparkSession), points.count() > scratch.BROADCAST_ROWS
    regions, links = _islands(points, percent, tables, many), []
    for level in count():
        regions = tables.written(regions, "regions")
        size = regions.groupBy("region").agg(F.count("*").alias("m"), F.sum("n").alias("w"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi")
        fits = (F.col("m") <= leaf) & (F.col("w") <= weight) | (F.col("m") <= 2)
        sized = regions.join(scratch.dealt(size.select("region", "m", "w", fits.alias("fits")), many), "region")
        leaves = sized.filter("fits").drop("m", "w", "fits")
        big = size.filter(~fits).limit(1).count()
        if big:
            chunks = F.greatest(F.ceil(F.col("m") / leaf), F.ceil(F.col("w") / weight)).cast("int")
            large = tables.written(sized.filter("not fits").withColumn("chunks", chunks).drop("m", "w", "fits"), "large")
            found, regions, met = _split(large, points, percent, level, leaf, weight, tables, many)
            links.append(found)
            leaves = leaves.union(met)
        ready = leaves.select("region", "point", "n", "label").join(scratch.dealt(points.select("point", "shingles"), many), "point")
        links.append(tables.written(ready.groupBy("region").applyInArrow(run, schema), "links"))
        if not big:
            break
    every = links[0]
    for more in links[1:]:
        every = every.union(more)
    merged = components(every)
    tables.clear()
    return points.select("point").join(scratch.dealt(merged.select(F.col("node").alias("point"), "component"), many), "point", "left").select("point", F.coalesce("component", "point").alias("component"))


def near_duplicates(df: DataFrame, width: int = WIDTH, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ids = scratch.written(shared(docs, _screen_entries(width, percent), finish=_alive, schema="doc_id long"), "alive").withColumn("alive", F.lit(True))
    run, schema = _sets(width, percent)
    # few ids go to the texts; otherwise the texts, but those without an id, go to the ids, and needn't be sorted
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("shuffle_hash")
    named = docs.filter("doc_id is not null").join(ids, "doc_id", "left")
    nameless = docs.filter("doc_id is null").withColumn("alive", F.lit(False))
    sets = scratch.written(named.unionByName(nameless).mapInArrow(run, schema), "sets")
    same = ["h1", "h2", "n"]
    alive = F.col("shingles").isNotNull() & F.col("doc_id").isNotNull()
    classes = sets.filter(alive).groupBy(*same).agg(F.min("doc_id").alias("rep"), F.first("shingles").alias("shingles"))
    classes = scratch.written(classes.withColumn("point", F.monotonically_increasing_id()), "points")
    many = classes.count() > scratch.BROADCAST_ROWS
    labels = link_components(classes.select("point", "n", "shingles"), percent)
    of_class = classes.select("point", "rep", *same).join(scratch.dealt(labels, many), "point")
    least = of_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_set = of_class.join(scratch.dealt(least, many), "component").select(*same, "component_id")
    linked = sets.filter(alive).drop("shingles").join(scratch.dealt(of_set, many), same)
    alone = sets.filter(~alive).drop("shingles").withColumn("component_id", F.col("doc_id"))
    return linked.unionByName(alone).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
