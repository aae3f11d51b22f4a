"""Exact Jaccard self-join on word shingles, as connected components of the links.

A document's set holds its distinct 5-word shingles. Two documents link where 100 |x n y| >= 75 |x u y|.

1. How many documents hold each shingle is counted over all of them. Only shared shingles can meet, so a
   document whose shared ones are too few for any link is out. The others order their shared shingles
   from rare to frequent; two sets that link have one in common among the first few (prefix filter, where
   the unshared ones count as the rarest).
2. Equal sets are one class. A prefix shingle's list holds its classes by size. At the first shingle that two
   linked sets have in common, its place in each bounds the size of the other, so neighbours in the list whose
   sizes and places allow a link are chained, and the others are not. Chains give groups, which links never
   leave. A task sends one class on for each size of a list, so a shingle that very many classes have is
   split and not gathered.
3. Within a group, lists of prefix shingles hold sets by size, so that blocks of other sizes are skipped,
   and of the rest those whose positions leave too few shingles to share. When a set has been compared with
   all others, the answers of a set similar to it come from those: what lies further from the first than
   the threshold and the two sets' distance is skipped, as is what is connected already.
4. A group of more than ``large`` classes (or ``heavy`` bytes) is cut into cells by size and hash, of about so many
   classes each. All cells are compared with a few pivots; of what these connect, the largest part needs no
   comparison within itself. What is left of the group is compared, cell by cell, with all cells whose sizes
   are near. So no task ever holds more than two cells.

Defined results: a text without words, or null, has an empty set, links with nothing and is its own
component; one with fewer than five words has its whole sequence as its one shingle. Copies are one
class. A null id counts as the smallest id, and a component that holds one has a null component id. Rows
that share an id are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, concat_columns, cut_lineage, let_go, mix64, pack_columns, roots, shuffle_parts, split_by
from .counting import NULL_ID, Part, with_counts

WORDS = 5
PERCENT = 75
#: Hash bits for counting documents a shingle. Two shingles that meet only seem shared, which loses nothing.
COUNT_BITS = 48
#: Classes, and bytes of their shingles, that one cell holds on average, and rounds of pivots.
LARGE = 1_000
HEAVY = 16_000_000
ROUNDS = 2
#: Sizes of linked sets differ by 4/3 at most, so by one step of this at most.
SIZE_STEP = 1.34


def shingles(part: Part, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Documents (numbers) and hashes of their distinct shingles, by document and hash."""
    w = part.words
    key = w.chained(words)
    doc = w.text[: len(key)]
    whole = w.text[words - 1 :] == doc if len(key) else np.zeros(0, bool)
    key, doc = key[whole], doc[whole]
    n = np.diff(w.first)
    few = np.flatnonzero((n > 0) & (n < words))
    if len(few):
        extra = np.empty(len(few), np.uint64)
        for k in range(1, words):
            h = w.chained(k)
            at = n[few] == k
            extra[at] = h[w.first[few[at]]]
        key, doc = np.concatenate([key, extra]), np.concatenate([doc, few])
    o = np.lexsort((key, doc))
    key, doc = key[o], doc[o]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], key[new]


def least_overlap(n: np.ndarray | int, percent: int = PERCENT):
    """Shingles that a set of n must share with any set that it links with."""
    return -(-percent * n // 100)


def link_groups(sets: list[np.ndarray], prefix: list[int], sizes: list[int], percent: int = PERCENT, start: np.ndarray | None = None) -> np.ndarray:
    """For each set the number of the first set that links lead to.

    sets: shared shingles, rare ones first; sizes count the unshared ones too; the first ``prefix`` ones are indexed.
    Sets with one ``start`` are connected already.
    """
    m = len(sets)
    label = np.full(m, -1)
    size = np.array(sizes, np.int64)
    if m == 2 and start is None:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        linked = 100 * both >= percent * (size.sum() - both)
        return np.array([0, 0 if linked else 1])
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    names, token = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), np.diff(at))
    position = np.arange(len(token)) - at[owner] + (size - np.diff(at))[owner]  # the unshared ones stand first
    indexed = np.flatnonzero(np.arange(len(token)) - at[owner] < np.array(prefix)[owner])
    indexed = indexed[np.lexsort((size[owner[indexed]], token[indexed]))]
    list_size, list_set, list_position = size[owner[indexed]], owner[indexed], position[indexed]
    # one sorted key for token and size finds the block of a token's list that has the right sizes
    span = int(size.max()) + 1
    list_key = token[indexed].astype(np.int64) * span + list_size
    mark = np.zeros(len(names), np.int32)
    free = np.ones(m, bool)

    def shared(y: int, others: np.ndarray) -> np.ndarray:
        mark[token[at[y] : at[y + 1]]] = 1
        n = at[others + 1] - at[others]
        ends = np.cumsum(n)
        hits = np.concatenate(([0], np.cumsum(mark[token[np.repeat(at[others] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]])))
        mark[token[at[y] : at[y + 1]]] = 0
        return hits[ends] - hits[ends - n]

    def distance(y: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = shared(y, others)
        union = size[y] + size[others] - both
        return 1 - both / union, 100 * both >= percent * union

    def candidates(y: int) -> np.ndarray:
        own = slice(at[y], at[y] + prefix[y])
        t, p = token[own].astype(np.int64), position[own]
        low, high = least_overlap(size[y], percent), 100 * size[y] // percent
        a, b = np.searchsorted(list_key, t * span + low), np.searchsorted(list_key, t * span + min(high, span - 1), "right")
        n = b - a
        ends = np.cumsum(n)
        e = np.repeat(a - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        p = np.repeat(p, n)
        e_ok = free[list_set[e]]
        e, p = e[e_ok], p[e_ok]
        need = -(-percent * (size[y] + list_size[e]) // (100 + percent))
        left = np.minimum(size[y] - p, list_size[e] - list_position[e])
        # what stands before the two places may be shared as well, where the token isn't the first one in common
        return np.unique(list_set[e[left + np.minimum(p, list_position[e]) >= need]])

    def take(found: np.ndarray, seed: int) -> list[int]:
        """Puts sets, and what is connected with them already, into the seed's component."""
        if start is not None and len(found):
            found = np.flatnonzero(free & np.isin(start, start[found]))
        free[found], label[found] = False, seed
        return found.tolist()

    slack = 1 - percent / 100 + 1e-9
    for seed in range(m):
        if not free[seed]:
            continue
        queue, far, own = take(np.array([seed]), seed), None, 0
        while queue:
            y = queue.pop()
            own += 1
            if far is None and own == 8 and free.any():  # a group worth the pass: compare its first set with all
                rest = np.flatnonzero(free)
                far = np.full(m, np.inf)
                members = np.flatnonzero(label == seed)
                far[members] = distance(seed, members)[0]
                far[rest], linked = distance(seed, rest)
                queue += take(rest[linked], seed)
            if far is not None:
                found = np.flatnonzero(free & (far <= slack + far[y]))
                if len(found) > 64:
                    found = np.intersect1d(found, candidates(y), assume_unique=True)
            else:
                found = candidates(y)
            if len(found):
                queue += take(found[distance(y, found)[1]], seed)
    return label


def chains(key: np.ndarray, n: np.ndarray, most: np.ndarray, owner: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of owners that keep together, within each key's list, all that may link by it.

    ``most`` is the largest set that an entry's place allows. The smaller one of a linked pair allows for the larger,
    so it is among those with ``most >= n``. These stand by size, each chained to the one before it if sizes allow; any
    other is chained to the largest one of these that it allows for. Sizes between those of a linked pair allow links with
    both, so a chain that parts does so where no link leads.
    """
    top = np.minimum(n, most)
    small = np.flatnonzero(most >= n)
    small = small[np.lexsort((owner[small], n[small], key[small]))]
    other = np.flatnonzero(most < n)
    names, code = np.unique(key, return_inverse=True)
    span = int(n.max(initial=0)) + 1
    place = code.astype(np.int64)[small] * span + n[small]
    x, y = small[:-1], small[1:]
    near = (key[x] == key[y]) & (n[x] >= least_overlap(n[y], percent))
    at = np.searchsorted(place, code.astype(np.int64)[other] * span + top[other], "right") - 1
    other, at = other[at >= 0], at[at >= 0]
    found = small[at]
    fits = (key[found] == key[other]) & (n[found] >= least_overlap(n[other], percent)) if len(found) else np.zeros(0, bool)
    return np.concatenate([owner[x[near]], owner[found[fits]]]), np.concatenate([owner[y[near]], owner[other[fits]]])


def thinned(key: np.ndarray, n: np.ndarray, most: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """The first entry of each key, size and bound, and pairs that tie the others to it."""
    top = np.minimum(n, most)
    o = np.lexsort((owner, most < n, top, n, key))
    new = np.ones(len(o), bool)
    if len(o):
        new[1:] = np.any([c[o][1:] != c[o][:-1] for c in (key, n, top, most < n)], axis=0)
    first = np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))
    tied = owner[o] != owner[o][first]
    return o[new], (owner[o][first][tied], owner[o][tied])


def settle_large(hot: DataFrame, percent: int, large: int, heavy: int) -> DataFrame:
    """Links ``a, b`` that connect what links connect in large groups: ``grp, cls, n, prefix, tokens``."""

    def parted(rows: DataFrame, name: str, salt: int) -> tuple[DataFrame, DataFrame]:
        """Rows with their cell's number among those of their group and size, and how many of these there are."""
        parts = F.ceil(F.greatest(F.count("*") / large, F.sum(F.length("tokens")) / heavy)).cast("int").alias(name)
        cells = cut_lineage(rows.groupBy("grp", "bin").agg(parts))
        return rows.join(cells, ["grp", "bin"]).withColumn(name, F.pmod(F.xxhash64("cls", F.lit(salt)), F.col(name)).cast("int")), cells

    def spread(cells: DataFrame, name: str) -> DataFrame:
        """A row for each cell and each size step whose sets may link with it."""
        x = cells.select("grp", F.col("bin").alias(f"{name}_bin"), F.explode(F.sequence(F.lit(0), F.col(name) - 1)).alias(name))
        return x.withColumn("bin", F.explode(F.array(*[F.col(f"{name}_bin") + k for k in (-1, 0, 1)])))

    hot = cut_lineage(hot.withColumn("bin", F.floor(F.log("n") / float(np.log(SIZE_STEP))).cast("int")))
    dealt, cells = parted(hot, "cell", 1)
    dealt = cut_lineage(dealt)
    order = F.struct((F.col("prefix") / F.col("n")).alias("q"), F.col("cls").alias("c"))  # least unshared, so likely what others were made from

    def compare(key: tuple, members: pa.Table, pivots: pa.Table) -> pa.Table:
        a, b = [], []
        ids, sizes, raw = members.column("cls").to_numpy(), members.column("n").to_numpy(), members.column("tokens").to_pylist()
        for p in pivots.column("pivot").to_pylist():
            base = np.sort(np.frombuffer(p["tokens"], np.uint64))
            both = np.array([np.isin(np.frombuffer(t, np.uint64), base, assume_unique=True).sum() for t in raw], np.int64)
            linked = (100 * both >= percent * (sizes + p["n"] - both)) & (ids != p["cls"])
            a.append(ids[linked])
            b.append(np.full(int(linked.sum()), p["cls"]))
        return pa.table({"a": np.concatenate(a) if a else np.zeros(0, np.int64), "b": np.concatenate(b) if b else np.zeros(0, np.int64)})

    found, rest = None, dealt
    for _ in range(ROUNDS):
        pivots = rest.groupBy("grp", "bin").agg(F.max_by(F.struct("cls", "n", "tokens"), order).alias("pivot"))
        sent = pivots.join(spread(cells, "cell").withColumnRenamed("cell_bin", "to_bin"), ["grp", "bin"]).select(F.col("grp").alias("to_grp"), "to_bin", F.col("cell").alias("to_cell"), "pivot")
        links = cut_lineage(dealt.groupBy("grp", "bin", "cell").cogroup(sent.groupBy("to_grp", "to_bin", "to_cell")).applyInArrow(compare, "a long, b long"))
        found = links if found is None else found.unionByName(links)
        labels = cut_lineage(components(found))
        named = dealt.join(labels.select(F.col("id").alias("cls"), F.col("component").alias("start")), "cls", "left").withColumn("start", F.coalesce("start", "cls"))
        main = named.groupBy("grp", "start").agg(F.count("*").alias("c")).groupBy("grp").agg(F.max_by("start", F.struct("c", "start")).alias("main"))
        named = cut_lineage(named.join(main, "grp"))
        rest = named.where("start <> main")
        if rest.groupBy("grp").count().where(F.col("count") > large).isEmpty():
            break
    asking, lots = parted(rest, "lot", 2)
    # each cell of what is left with each cell of near sizes
    kept = ["cls", "n", "prefix", "tokens", "start"]
    pairs = spread(lots, "lot").join(spread(cells, "cell").select("grp", F.col("cell_bin").alias("bin"), "cell").distinct(), ["grp", "bin"])
    pairs = cut_lineage(pairs.select("grp", "lot_bin", "lot", F.col("bin").alias("cell_bin"), "cell"))
    task = ["grp", "lot_bin", "lot", "cell_bin", "cell"]
    one = asking.withColumnRenamed("bin", "lot_bin").drop("cell").join(pairs, ["grp", "lot_bin", "lot"]).select(*task, *kept)
    two = named.withColumnRenamed("bin", "cell_bin").join(pairs, ["grp", "cell_bin", "cell"]).select(*task, *kept)

    def cross(table: pa.Table) -> pa.Table:
        cls, n, prefix, start = (table.column(c).to_numpy() for c in ("cls", "n", "prefix", "start"))
        cls, own = np.unique(cls, return_index=True)
        tokens, start = table.column("tokens").take(pa.array(own)).to_pylist(), start[own]
        label = link_groups([np.frombuffer(t, np.uint64) for t in tokens], prefix[own].tolist(), n[own].tolist(), percent, start)
        a, b = roots(start, start[label])
        return pa.table({"a": a, "b": b})

    return found.unionByName(one.unionByName(two).groupBy(*task).applyInArrow(cross, "a long, b long"))


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, large: int = LARGE, heavy: int = HEAVY) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row."""
    spark = df.sparkSession
    buckets = 2 * shuffle_parts(spark)

    def use(part: Part, look_up) -> pa.Table:
        doc, key = shingles(part, words)
        held_by = look_up(key)
        docs = len(part.id)
        n = np.bincount(doc, minlength=docs)
        shared = held_by >= 2
        n_shared = np.bincount(doc[shared], minlength=docs)
        need = least_overlap(n, percent)
        may = (n > 0) & (n_shared >= need)
        edge = np.searchsorted(doc, np.arange(docs + 1))
        total = np.concatenate(([0], np.cumsum(mix64(key), dtype=np.uint64)))
        other = np.concatenate(([0], np.cumsum(mix64(key ^ np.uint64(0xA5A5A5A55A5A5A5A)), dtype=np.uint64)))
        h1, h2 = (x[edge[1:]].astype(np.uint64) - x[edge[:-1]].astype(np.uint64) for x in (total.astype(np.uint64), other.astype(np.uint64)))
        tokens, seen = [None] * docs, set()
        for d in np.flatnonzero(may).tolist():
            if (name := (int(h1[d]), int(h2[d]), int(n[d]))) in seen:
                continue
            seen.add(name)
            own = slice(edge[d], edge[d + 1])
            k, c = key[own][shared[own]], held_by[own][shared[own]]
            tokens[d] = k[np.lexsort((k, c))].tobytes()
        prefix = np.where(may, n - need + 1 - (n - n_shared), 0)
        cols = [pa.array(part.id), pa.array(n.astype(np.int64)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(prefix.astype(np.int32)), pa.array(tokens, pa.binary())]
        return pa.table(cols, names=["id", "n", "h1", "h2", "prefix", "tokens"])

    def keys_of(part: Part) -> np.ndarray:
        return shingles(part, words)[1]

    rows = cut_lineage(with_counts(df, keys_of, use, "id long, n long, h1 long, h2 long, prefix int, tokens binary", id_col, text_col, COUNT_BITS))
    let_go(spark)
    name = ["h1", "h2", "n"]
    # each class has a number of its own, given before the checkpoint that all else reads
    heads = F.struct(F.substring("tokens", F.lit(1), F.col("prefix") * 8).alias("heads"), F.col("prefix").alias("prefix"), (F.length("tokens") / 8).cast("int").alias("shared"))
    classes = rows.where("prefix > 0").groupBy(*name).agg(F.min("id").alias("rep"), F.first(F.when(F.col("tokens").isNotNull(), heads), ignorenulls=True).alias("own"))
    classes = cut_lineage(classes.withColumn("cls", F.monotonically_increasing_id()).select("cls", *name, "rep", "own.*"))
    entry, pair = (np.uint64, np.int64, np.int64, np.int64), (np.int64, np.int64)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lists' entries to their buckets; and the pairs that stand for those left out, to buckets below 0."""
        for batch in batches:
            ids, n, shared = (batch.column(c).to_numpy() for c in ("cls", "n", "shared"))
            raw = batch.column("heads").to_pylist()
            count = np.array([len(r) // 8 for r in raw], np.int64)
            key, owner = np.frombuffer(b"".join(raw), np.uint64), np.repeat(ids, count)
            own = np.repeat(n, count)
            place = np.arange(len(key)) - np.repeat(np.cumsum(count) - count, count) + own - np.repeat(shared, count)
            most = (100 + percent) * (own - place) // percent - own
            o, tied = thinned(key, own, most, owner)
            key, own, most, owner = key[o], own[o], most[o], owner[o]
            found = [(b, pack_columns(key[x], own[x], most[x], owner[x])) for b, x in split_by((key % np.uint64(buckets)).astype(np.int64))]
            found += [(-1 - b, pack_columns(tied[0][x], tied[1][x])) for b, x in split_by((mix64(tied[1].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([r for _, r in found], pa.binary())], names=["bucket", "payload"])

    def meet(table: pa.Table) -> pa.Table:
        kinds = entry if table.column("bucket")[0].as_py() >= 0 else pair
        columns = concat_columns(table.column("payload").to_pylist(), kinds)
        a, b = roots(*(chains(*columns, percent) if kinds is entry else columns))  # what a bucket's chains join, as stars
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    met = classes.select("cls", "n", "shared", "heads").mapInArrow(entries, "bucket int, payload binary").groupBy("bucket").applyInArrow(meet, "a long, b long")
    groups = cut_lineage(components(met).select(F.col("id").alias("cls"), F.col("component").alias("grp")))
    grouped = classes.select("cls", *name).join(groups, "cls")
    sets = rows.where("tokens is not null").select(*name, "prefix", "tokens").join(grouped, name).select("grp", "cls", "n", "prefix", "tokens")
    # several parts may bring a class
    size = groups.join(classes.select("cls", "shared"), "cls").groupBy("grp").agg(F.count("*").alias("_n"), F.sum(8 * F.col("shared")).alias("_bytes"))
    crowded = cut_lineage(size.where((F.col("_n") > large) | (F.col("_bytes") > heavy)).select("grp"))

    def settle(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        grp, cls, n, prefix = (table.column(c).to_numpy() for c in ("grp", "cls", "n", "prefix"))
        cls, o = np.unique(cls, return_index=True)
        tokens = table.column("tokens").take(pa.array(o)).to_pylist()
        out = cls.copy()
        for _, at in split_by(grp[o]):
            if len(at) > 1:
                q = o[at]
                label = link_groups([np.frombuffer(tokens[i], np.uint64) for i in at.tolist()], prefix[q].tolist(), n[q].tolist(), percent)
                out[at] = cls[at][label]
        linked = out != cls
        return pa.table({"a": pa.array(cls[linked]), "b": pa.array(out[linked])})

    is_crowded = not crowded.isEmpty()
    small = sets.join(crowded, "grp", "left_anti") if is_crowded else sets
    small = small.withColumn("bucket", F.pmod(F.xxhash64("grp"), F.lit(2 * buckets)).cast("int"))
    # a link leads from each class of a small group to the one that its component is known by
    ends = small.select("bucket", "grp", "cls", "n", "prefix", "tokens").groupBy("bucket").applyInArrow(settle, "a long, b long").select(F.col("a").alias("cls"), F.col("b").alias("end"))
    if is_crowded:
        hot = sets.join(crowded, "grp", "left_semi").groupBy("grp", "cls", "n").agg(F.first("prefix").alias("prefix"), F.first("tokens").alias("tokens"))
        more = components(settle_large(hot, percent, large, heavy))
        ends = ends.unionByName(more.select(F.col("id").alias("cls"), F.col("component").alias("end")))
    ended = cut_lineage(classes.select(*name, "rep", "cls").join(ends, "cls", "left").select(*name, "rep", F.coalesce("end", "cls").alias("end")))
    settled = ended.join(ended.groupBy("end").agg(F.min("rep").alias("component")), "end").select(*name, "component")
    out = rows.select("id", *name).join(settled, name, "left").withColumn("component", F.coalesce("component", "id"))
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(real("id").alias("doc_id"), F.col("n").alias("n_shingles"), real("component").alias("component_id"))
