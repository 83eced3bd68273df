"""N-gram Jaccard join by vertical partitioning.

The global order of word n-grams is the order of their 64-bit hashes, cut into fragments. Every batch of documents sends each
fragment one row with its part of all the batch's sets, so the number of rows does not depend on the documents' lengths. A
fragment counts in how many documents each of its n-grams is; n-grams that many documents of one batch share are counted within
the batch and only the count travels. A document's overlaps with the rest of the corpus, counted by fragment, are summed: below
the threshold's share of its set it can have no partner. The few documents left get a prefix of their rarest shared n-grams.

Documents that share a prefix n-gram with few others form pairs; their overlaps are counted by fragment and summed. Those that
share one with more are gathered into groups, each document once. A group of up to ``block`` documents is one task. A larger one is cut
into cells by the size of its sets, in steps of the threshold: only documents of one cell or of neighbouring ones can be linked. Every document of a cell forms a pair
with the cell's pivot, counted like the others. Those linked to the pivot are in its component already and need no look at each
other; what is left (documents not linked to their pivot with all of their cells) is judged in blocks: a task takes two blocks
of documents, counts the overlaps of all its pairs fragment by fragment, adds them up, and answers with a spanning forest of the
links. So groups of copies and near copies never leave as pairs, and cost what their documents not close to the pivot cost.
Both counts are exact.

Links: ``threshold`` in hundredths; 100 * intersection >= threshold * union.

Defined cases: a document without words (or null) has an empty set and links with nothing; fewer than n words make one n-gram of
all of them; equal sets are one node; repeated rows and equal texts share a component; a null id takes part and yields to any
other id as the least; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexvane.llm.common import lean, shuffle_partitions, stored, whole_text
from lexvane.llm.components import components
from lexvane.llm.tokens import fresh

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class NgramParams:
    n: int = 5
    #: Hundredths of Jaccard similarity.
    threshold: int = 80
    #: An n-gram in so many documents of one batch is counted within the batch.
    local: int = 64
    #: Prefix n-grams of up to so many documents make pairs, others make groups.
    few: int = 4
    pair_fragments: int = 4
    #: Documents in a block of a group, and n-grams in a fragment of it.
    block: int = 512
    columns: int = 4096
    slice_bytes: int = 8 << 20
    #: Text for one fragment of the order, at most: what one call in a task has to hold follows from it.
    fragment_bytes: int = 64 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    return x ^ (x >> np.uint64(29))


def ngram_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Each text's set of n-gram hashes, sorted."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(fresh(texts.cast(pa.large_string())), "")))
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) if w else 0 for w in words), np.uint64, len(words))
    filled = np.array([bool(w) for w in words], bool)
    flat = coded.indices.to_numpy(zero_copy_only=False)
    keep = filled[flat] if len(words) else np.zeros(0, bool)
    owner = np.repeat(np.arange(len(counts)), counts)[keep]
    h = hashes[flat[keep]] if len(words) else np.zeros(0, np.uint64)
    sizes = np.bincount(owner, minlength=len(counts)).astype(np.int64)
    ends = np.cumsum(sizes)
    grams = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        grams = _mix(grams * _M1 + h[k : k + len(grams)] + np.uint64(k + 1))
    out = []
    for size, end in zip(sizes.tolist(), ends.tolist(), strict=True):
        if size >= n:
            out.append(np.unique(grams[end - size : end - n + 1]))
        elif size:
            whole = np.zeros(1, np.uint64)
            for x in h[end - size : end]:
                whole = _mix(whole * _M1 + x + np.uint64(size + 100))
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


_CUT = "frag int, kind int, batch long, ids array<long>, marks array<long>, ns array<long>, sigs array<binary>, toks binary, ords binary, hot binary, counts binary"
_CUT_SCHEMA = pa.schema([("frag", pa.int32()), ("kind", pa.int32()), ("batch", pa.int64()), ("ids", pa.list_(pa.int64())), ("marks", pa.list_(pa.int64())), ("ns", pa.list_(pa.int64())), ("sigs", pa.list_(pa.binary())), *[(c, pa.binary()) for c in ("toks", "ords", "hot", "counts")]])
_PART, _DOCS, _SHARED = 0, 1, 2


def _row(**cols) -> dict:
    return dict.fromkeys(_CUT_SCHEMA.names) | cols


def _slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")))
        upto = min(upto, at + 60_000)  # ordinals take two bytes
        yield at, upto - at
        at = upto


def _cut(batches: Iterator[pa.RecordBatch], p: NgramParams, fragments: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch's sets into fragments. One row for each fragment, one for the batch's documents."""
    batch = TaskContext.get().partitionId() << 32
    for b in batches:
        for at, n in _slices(b.column(1), p.slice_bytes):
            ids, marks, sets = b.column(0).slice(at, n).to_pylist(), b.column(2).slice(at, n).to_pylist(), ngram_sets(b.column(1).slice(at, n), p.n)
            sigs = [hashlib.md5(s.tobytes()).digest() for s in sets]
            first: dict[bytes, int] = {}
            for k, s in enumerate(sigs):
                first.setdefault(s, k)
            reps = [k for k in first.values() if len(sets[k])]
            toks = np.concatenate([sets[k] for k in reps]) if reps else np.zeros(0, np.uint64)
            ords = np.repeat(np.array(reps, np.uint16), [len(sets[k]) for k in reps]) if reps else np.zeros(0, np.uint16)
            order = np.argsort(toks, kind="stable")
            toks, ords = toks[order], ords[order]
            starts = np.flatnonzero(np.concatenate([[True], toks[1:] != toks[:-1]])) if len(toks) else np.zeros(0, np.int64)
            runs = np.diff(np.concatenate([starts, [len(toks)]]))
            often = runs >= p.local
            is_hot = np.repeat(often, runs)
            hot, counts = toks[starts[often]], runs[often].astype(np.uint32)
            rows = [_row(frag=int(batch % fragments), kind=_DOCS, batch=batch, ids=ids, marks=marks, ns=[len(s) for s in sets], sigs=sigs, toks=_planes(toks[is_hot]), ords=ords[is_hot].tobytes())]
            toks, ords = toks[~is_hot], ords[~is_hot]
            bounds = np.array([(f << 64) // fragments for f in range(1, fragments)], np.uint64)
            cut = np.concatenate([[0], np.searchsorted(toks, bounds), [len(toks)]])
            cut_hot = np.concatenate([[0], np.searchsorted(hot, bounds), [len(hot)]])
            for f in range(fragments):
                a, z, c, d = cut[f], cut[f + 1], cut_hot[f], cut_hot[f + 1]
                if z > a or d > c:
                    rows.append(_row(frag=f, kind=_PART, batch=batch, toks=_planes(toks[a:z]), ords=ords[a:z].tobytes(), hot=_planes(hot[c:d]), counts=counts[c:d].tobytes()))
            yield pa.RecordBatch.from_pylist(rows, _CUT_SCHEMA)
            batch += 1


def _planes(values: np.ndarray) -> bytes:
    """Ascending values as differences, first all lowest bytes, then all next ones: the upper ones are zeros and compress away."""
    return np.diff(values, prepend=np.zeros(1, np.uint64)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _values(planes: bytes | None) -> np.ndarray:
    if not planes:
        return np.zeros(0, np.uint64)
    return np.cumsum(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def _u64(cells: list) -> list[np.ndarray]:
    return [_values(x) for x in cells]


def _ints(cells: list, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x or b"", kind) for x in cells]


def _count_fragment(t: pa.Table) -> pa.Table:
    """Documents of each n-gram of a fragment; every batch gets back its shared ones with their counts."""
    kind = t["kind"].to_numpy()
    parts = t.filter(pa.array(kind == _PART))
    out = [t.filter(pa.array(kind == _DOCS)).cast(_CUT_SCHEMA)]
    if parts.num_rows:
        batch = parts["batch"].to_pylist()
        toks, ords = _u64(parts["toks"].to_pylist()), _ints(parts["ords"].to_pylist(), np.uint16)
        hot, counts = _u64(parts["hot"].to_pylist()), _ints(parts["counts"].to_pylist(), np.uint32)
        every = np.concatenate([*toks, *hot])
        times = np.concatenate([np.ones(sum(map(len, toks)), np.int64), *[c.astype(np.int64) for c in counts]])
        order = np.argsort(every, kind="stable")
        every, times = every[order], times[order]
        starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        df = np.add.reduceat(times, starts)
        shared = df >= 2
        known, df = every[starts][shared], np.minimum(df[shared], 65535).astype(np.uint16)
        rows = []
        for b, tk, od, h in zip(batch, toks, ords, hot, strict=True):
            at = np.searchsorted(known, tk)
            there = known[np.minimum(at, len(known) - 1)] == tk if len(known) else np.zeros(len(tk), bool)
            if there.any() or len(h):
                rows.append(_row(frag=0, kind=_SHARED, batch=b, toks=_planes(tk[there]), ords=od[there].tobytes(), hot=_planes(h), counts=np.concatenate([df[at[there]], df[np.searchsorted(known, h)]]).tobytes()))
        out.append(pa.Table.from_pylist(rows, _CUT_SCHEMA))
    return pa.concat_tables(out)


_FOUND = "id long, mark long, n long, sig binary, toks array<long>"
_FOUND_SCHEMA = pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("toks", pa.list_(pa.int64()))])


def _sum_batch(t: pa.Table, p: NgramParams) -> pa.Table:
    """Sum the fragments' overlaps of each document with the corpus. Those with enough keep their shared n-grams, rarest first."""
    kind = t["kind"].to_pylist()
    docs = t.filter(pa.array([k == _DOCS for k in kind])).to_pylist()[0]
    shared = t.filter(pa.array([k == _SHARED for k in kind]))
    toks, ords, hot = _u64(shared["toks"].to_pylist()), _ints(shared["ords"].to_pylist(), np.uint16), _u64(shared["hot"].to_pylist())
    counts = _ints(shared["counts"].to_pylist(), np.uint16)
    tok, ord_ = np.concatenate([*toks, np.zeros(0, np.uint64)]), np.concatenate([*ords, np.zeros(0, np.uint16)])
    df = np.concatenate([*[c[: len(x)] for c, x in zip(counts, toks, strict=True)], np.zeros(0, np.uint16)])
    hot_tok = np.concatenate([*hot, np.zeros(0, np.uint64)])
    hot_df = np.concatenate([*[c[len(x) :] for c, x in zip(counts, toks, strict=True)], np.zeros(0, np.uint16)])
    o = np.argsort(hot_tok)
    own_tok, own_ord = _values(docs["toks"]), np.frombuffer(docs["ords"], np.uint16)
    tok, ord_ = np.concatenate([tok, own_tok]), np.concatenate([ord_, own_ord])
    df = np.concatenate([df, hot_df[o][np.searchsorted(hot_tok[o], own_tok)] if len(own_tok) else np.zeros(0, np.uint16)])
    ns = np.array(docs["ns"], np.int64)
    total = np.bincount(ord_, minlength=len(ns))
    enough = (total * 100 >= p.threshold * ns) & (ns > 0) & (total > 0)
    keep = enough[ord_]
    tok, ord_, df = tok[keep], ord_[keep], df[keep]
    o = np.lexsort((tok, df, ord_))
    tok, ord_ = tok[o].view(np.int64), ord_[o]
    upto = np.searchsorted(ord_, np.arange(len(ns) + 1))
    lists = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(tok))
    # Only the first document of each set in the batch carries n-grams; the others have an empty list.
    return pa.Table.from_arrays([pa.array(docs["ids"], pa.int64()), pa.array(docs["marks"], pa.int64()), pa.array(ns), pa.array(docs["sigs"], pa.binary()), lists], schema=_FOUND_SCHEMA)


def _alike(a: str, b: str, t: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * t


def _overlaps(pairs: DataFrame, fragments: DataFrame, t: int) -> DataFrame:
    """Links among ``pairs`` (a, b, na, nb): partial overlaps by fragment, summed."""
    left = fragments.select(F.col("sig").alias("a"), "v", F.col("part").alias("x"))
    right = fragments.select(F.col("sig").alias("b"), "v", F.col("part").alias("y"))
    each = pairs.join(left, "a").join(right, ["b", "v"]).select("a", "b", "na", "nb", F.size(F.array_intersect("x", "y")).alias("c"))
    return each.groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c")).where(F.col("c") * 100 >= t * (F.col("na") + F.col("nb") - F.col("c"))).select("a", "b")


def _judge(x: pa.Table, p: NgramParams) -> pa.Table:
    """A spanning forest of the links between two blocks of a group (or within one)."""
    n, sig = x["n"].to_numpy().astype(np.float32), x["sig"].to_pylist()
    left, right = (np.flatnonzero(x[c].to_numpy()) for c in ("in_left", "in_right"))
    lists = x["toks"].combine_chunks()
    toks, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(sig)), lists.value_lengths().to_numpy())
    known, col, seen = np.unique(toks, return_inverse=True, return_counts=True)
    # Only n-grams that two of these documents have can add to an overlap; they are numbered anew, in order.
    use = seen >= 2
    number = np.cumsum(use) - 1
    keep = use[col]
    col, owner = number[col[keep]], owner[keep]
    order = np.argsort(col, kind="stable")
    col, owner = col[order], owner[order]
    overlap = np.zeros((len(left), len(right)), np.float32)
    for a in range(0, int(use.sum()), p.columns):
        lo, hi = np.searchsorted(col, [a, a + p.columns])
        part = np.zeros((len(sig), min(p.columns, int(use.sum()) - a)), np.float32)
        part[owner[lo:hi], col[lo:hi] - a] = 1
        overlap += part[left] @ part[right].T
    link = overlap * 100 >= p.threshold * (n[left][:, None] + n[right][None, :] - overlap)
    i, j = np.nonzero(link & (left[:, None] != right[None, :]))
    low = _forest(len(sig), left[i], right[j])
    some = np.flatnonzero(low != np.arange(len(sig)))
    return pa.Table.from_arrays([pa.array([sig[k] for k in some], pa.binary()), pa.array([sig[low[k]] for k in some], pa.binary())], ["a", "b"])


def _block_tasks(member: DataFrame, tied: DataFrame, p: NgramParams) -> DataFrame:
    """Which blocks each member of a group meets: sig, root and a task (two cells, two blocks) with the member's sides in it.

    ``member``: sig, root, bin, near (linked to its cell's pivot); ``tied``: root and bin of cells whose pivot is linked to the
    next cell's. Cells are (bin, near). Those near one pivot, or near two pivots that are linked, are in one component already.
    """
    cell = F.struct("bin", "near").alias("cell")
    extent = stored(member.groupBy("root", cell).agg(F.ceil(F.count(F.lit(1)) / p.block).cast("int").alias("blocks")), "ngram-extent")
    one, two = extent.select("root", F.col("cell").alias("x"), F.col("blocks").alias("bx")), extent.select(F.col("root").alias("root_y"), F.col("cell").alias("y"), F.col("blocks").alias("by"))
    # A group has few cells beside its members: two for each step of size.
    met = one.join(two, (F.col("root") == F.col("root_y")) & (F.col("x") <= F.col("y")) & (F.col("y.bin") - F.col("x.bin") <= 1)).drop("root_y")
    tie = tied.select(F.col("root").alias("root_t"), F.col("bin").alias("bin_t"), F.lit(True).alias("tied"))
    met = met.join(tie, (F.col("root") == F.col("root_t")) & (F.col("x.bin") == F.col("bin_t")), "left")
    done = F.col("x.near") & F.col("y.near") & ((F.col("x.bin") == F.col("y.bin")) | F.coalesce("tied", F.lit(False)))
    met = stored(met.where(~done).select("root", "x", "y", "bx", "by"), "ngram-cells")
    has = member.join(extent.withColumnRenamed("root", "root_e"), (F.col("root") == F.col("root_e")) & (cell == F.col("cell"))).withColumn("side", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")).select("sig", "root", "cell", "side")
    has = stored(has, "ngram-members").withColumnRenamed("root", "root_m")
    same = F.col("x") == F.col("y")
    as_left = has.join(met, (F.col("root_m") == F.col("root")) & (F.col("cell") == F.col("x"))).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("by") - 1)))
    as_left = as_left.withColumn("i", F.when(same, F.least("side", "o")).otherwise(F.col("side"))).withColumn("j", F.when(same, F.greatest("side", "o")).otherwise(F.col("o")))
    as_left = as_left.select("sig", "root", "x", "y", "i", "j", (F.col("side") == F.col("i")).alias("in_left"), (same & (F.col("side") == F.col("j"))).alias("in_right"))
    as_right = has.join(met.where(~same), (F.col("root_m") == F.col("root")) & (F.col("cell") == F.col("y"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("bx") - 1)))
    return as_left.unionByName(as_right.select("sig", "root", "x", "y", "i", F.col("side").alias("j"), F.lit(False).alias("in_left"), F.lit(True).alias("in_right")))


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each member's component."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def ngram_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: NgramParams = NgramParams()) -> DataFrame:
    """One row per row of ``df``: id, n_shingles, component_id (least id of its component), text_mark (xxhash64 of the text, null as empty)."""
    p, t = params, params.threshold
    src = df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), F.xxhash64(whole_text(text_col)).alias("mark"))
    size = src.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))).first()[0]
    fragments = max(4 * shuffle_partitions(df.sparkSession), -(-size // p.fragment_bytes))
    counted = src.mapInArrow(lambda it: lean(_cut(it, p, fragments)), _CUT).groupBy("frag").applyInArrow(_count_fragment, _CUT)
    found = stored(counted.groupBy("batch").applyInArrow(lambda x: _sum_batch(x, p), _FOUND), "ngram-found")

    docs = found.select("id", "mark", "n", "sig")
    sets = stored(found.where(F.size("toks") > 0).groupBy("sig", "n").agg(F.any_value("toks").alias("toks")), "ngram-sets")
    # The prefix of the rarest n - ceil(t n) + 1 n-grams, less those that no other document has.
    need = F.col("n") - F.ceil(F.col("n") * t / 100) + 1 - (F.col("n") - F.size("toks"))
    posts = stored(sets.where(need > 0).select("sig", "n", F.explode(F.slice("toks", 1, need.cast("int"))).alias("tok")), "ngram-posts")
    # Few documents: pairs.
    sizes = stored(posts.groupBy("tok").agg(F.count(F.lit(1)).alias("size"), F.min("sig").alias("lead")).where("size > 1"), "ngram-sizes")
    at = stored(posts.join(sizes, "tok"), "ngram-met")
    one = at.where(F.col("size") <= p.few).select("tok", F.col("sig").alias("a"), F.col("n").alias("na"))
    two = one.select("tok", F.col("a").alias("b"), F.col("na").alias("nb"))
    pairs = one.join(two, (one["tok"] == two["tok"]) & (F.col("a") < F.col("b")) & _alike("na", "nb", t)).select("a", "b", "na", "nb")

    # More documents: groups, and in each cell of a group pairs with the pivot, the least digest. Sizes more than a step of
    # the threshold apart can't be linked, so that cells two or more apart never meet.
    groups = components(at.where((F.col("size") > p.few) & (F.col("sig") != F.col("lead"))).select(F.col("sig").alias("a"), F.col("lead").alias("b")))
    step = math.log(100 / t) if t < 100 else 1e-9
    # A group of one block is one task: it needs neither cells nor a pivot.
    large = groups.groupBy("root").agg((F.count(F.lit(1)) > p.block).alias("large"))
    size_bin = F.when(F.col("large"), F.floor(F.log("n") / step * (1 - 1e-9))).otherwise(0).cast("long")
    member = stored(groups.withColumnRenamed("node", "sig").join(large, "root").join(sets.select("sig", "n"), "sig").withColumn("bin", size_bin), "ngram-grouped")
    pivot = stored(member.where("large").groupBy("root", "bin").agg(F.min_by(F.struct("sig", "n"), "sig").alias("pivot")).select("root", "bin", F.col("pivot.sig").alias("b"), F.col("pivot.n").alias("nb")), "ngram-pivots")
    to_pivot = member.join(pivot, ["root", "bin"]).where("sig <> b").select(F.col("sig").alias("a"), "b", F.col("n").alias("na"), "nb")
    following = pivot.select("root", (F.col("bin") - 1).alias("bin"), F.col("b").alias("a"), F.col("nb").alias("na"))
    ties = stored(pivot.join(following, ["root", "bin"]).select("root", "bin", "a", "b", "na", "nb"), "ngram-ties")
    asked = pairs.union(to_pivot.where(_alike("na", "nb", t))).union(ties.select("a", "b", "na", "nb").where(_alike("na", "nb", t)))

    within = lambda v: F.filter("toks", lambda x: F.floor((F.shiftright(x, 56) + 128) * p.pair_fragments / 256) == v)
    cut = sets.select("sig", F.posexplode(F.array(*[within(v) for v in range(p.pair_fragments)])).alias("v", "part"))
    links = stored(_overlaps(stored(asked.distinct(), "ngram-pairs"), cut, t), "ngram-links")

    tied = ties.join(links, ["a", "b"], "left_semi").select("root", "bin")
    close = member.join(pivot.select("root", "bin", "b"), ["root", "bin"], "left").join(links.select(F.col("a").alias("sig"), "b", F.lit(True).alias("hit")), ["sig", "b"], "left")
    close = stored(close.select("sig", "root", "bin", (F.coalesce("hit", F.lit(False)) | F.coalesce(F.col("sig") == F.col("b"), F.lit(False))).alias("near")), "ngram-close")
    tasks = _block_tasks(close, tied, p)
    held = sets.join(tasks, "sig").groupBy("root", "x", "y", "i", "j")
    forest = held.applyInArrow(lambda x: _judge(x, p), "a binary, b binary")
    roots = components(links.union(stored(forest, "ngram-forest")))

    least = docs.where("n > 0").groupBy("sig").agg(F.min("id").alias("least"))
    joined = least.join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    joined = stored(joined, "ngram-least")
    tops = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    by_set = stored(joined.join(tops, "root").select("sig", "component_id"), "ngram-components")
    out = docs.join(by_set, "sig", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), F.col("mark").alias("text_mark"))
