"""A refreshable index of chunk embeddings: cells with zone maps, codes of one byte and another, exact rescoring.

Layout, under the index path. Each version is a folder of its own and is never changed:

- ``rows``, by cell: the chunks, their embeddings (those they have, as unit vectors, or of their text) and keys;
- ``blocks``, by cell: packs of up to ``block`` chunks of one cell and one access class: keys, validity days, codes as bytes and a second
  byte for each, ``fine``, of what the first leaves;
- ``kinds``: how many chunks there are of everything that the filters look at, so that counts of what was denied need no scan;
- ``zones``: a row for each cell and class with what decides access (roles, rank, source type, jurisdiction), the least and the
  greatest day of validity, and the number of chunks;
- a file in ``versions`` that names the folder. It is made last and only where there is none of its number, so readers see whole
  versions, and of two writers one has to start anew from the other's.

``refresh`` compares the corpus with the version by a digest over all columns of all chunks, so an index never answers for other
chunks, roles or dates than it was built from. Embeddings of texts that the version has are taken over; only new texts are embedded.

A search matches the requests with the zones first, on the driver: both are few. Cells that a request may not read at its date are left out before any vector is
read, and its nearest remaining cells are probed: as many as its role needs by the measured recall, and more where these hold fewer
readable chunks than ``enough`` times what is asked. Codes and requests meet in blocks as whole numbers of two bytes: their products are
exact in 64-bit floats. The best ``oversample`` times k of each request are scored again with the stored vectors; of more chunks whose
codes are the same, those of the lowest ids.

Equal rows count once. A request whose vector is zero finds nothing. An index of no chunks answers with no rows.
"""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lexvane.functions.schemas import CLEARANCE, REQUEST
from lexvane.functions.vectors import dot, embed, hash_embeddings, unit
from lexvane.operators.cells import fit_cells, usable
from lexvane.operators.retrieval import _chunk, _with_fields, embedding_text, top
from lexvane.operators.security import access_of, as_requests, chunk_kinds, local_requests, may_see, scope_reason

#: What decides access to a chunk, besides its dates.
CLASS = ["allowed_roles", "security_rank", "source_type", "jurisdiction"]
_FIRST, _LAST = -(2**31), 2**31 - 1


@dataclass(frozen=True)
class IndexParams:
    #: Cells for so many chunks each, up to ``most_cells``.
    cell_rows: int = 512
    most_cells: int = 2048
    #: Chunks to a pack, and chunks of a cell to a file, about.
    block: int = 1024
    task_rows: int = 50_000
    #: Bytes of codes that a task of a search reads, about.
    task_bytes: int = 64 << 20
    #: The share of components within the scale of codes; vectors with others are divided to fit.
    quantile: float = 0.999
    oversample: int = 3
    enough: int = 4
    recall: float = 0.95
    #: Queries that the number of probes is measured with, for each role, and how many neighbours they ask for.
    samples: int = 48
    sample_k: int = 20


@dataclass(frozen=True)
class IndexMeta:
    folder: str
    points: int
    digest: str
    dims: int
    scale: float
    schemas: dict[str, str] = field(repr=False)
    centres: list[list[float]] = field(repr=False)
    probes: dict[str, int] = field(default_factory=dict)


def corpus_digest(chunks: DataFrame) -> str:
    """A digest of all columns of all chunks, whatever their order."""
    cols = [F.to_json(F.col(c)) if dict(chunks.dtypes)[c].startswith("map") else F.col(c) for c in sorted(chunks.columns)]
    a, b = F.xxhash64(*cols), F.xxhash64(F.lit(17), *reversed(cols))
    r = chunks.select(a.alias("a"), b.alias("b")).agg(F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(38,0)")), F.bit_xor("b"), F.sum(F.col("b").cast("decimal(38,0)"))).first()
    return f"{sorted(chunks.dtypes)}|{r[0]}|{r[1]}|{r[2]}|{r[3]}"


def quantised(vectors: np.ndarray, scale: float) -> np.ndarray:
    """Components as whole numbers from -127 to 127; those beyond ``scale`` are clipped."""
    return np.clip(np.rint(vectors * (127 / scale)), -127, 127).astype(np.int8)


def _days(c: Column, open_end: int) -> Column:
    return F.coalesce(F.unix_date(c.cast("date")), F.lit(open_end))


class _Files:
    """The few small files of an index, by Hadoop's file system, so that any store Spark reads will do."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.conf, self.path = spark._jvm, spark._jsc.hadoopConfiguration(), path.rstrip("/")
        self.fs = self._at("versions").getFileSystem(self.conf)

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def names(self) -> list[str]:
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self._at("versions"))) if self.fs.exists(self._at("versions")) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(f"versions/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, content: str) -> bool:
        """Whether the file could be made: written whole beside, and renamed, which fails where the name is taken."""
        aside = self._at(f"tmp-{uuid.uuid4().hex}")
        stream = self.fs.create(aside, False)
        stream.write(bytearray(content.encode()))
        stream.close()
        self.fs.mkdirs(self._at("versions"))
        to = self._at(f"versions/{name}")
        if not self.fs.exists(to) and self.fs.rename(aside, to):
            return True
        self.fs.delete(aside, False)
        return False


def _drop(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _first_cell(centres: np.ndarray, batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for v in batches:
        yield pd.Series(np.argmax(np.stack(v.to_numpy()).astype(np.float64) @ centres.T, axis=1).astype(np.int32) if len(v) else np.zeros(0, np.int32))


def both_bytes(vectors: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, a second byte for what each leaves (in 254ths), and what a vector with components beyond ``scale`` was divided by."""
    stretch = np.maximum(1, np.abs(vectors).max(axis=1, initial=0) / scale).astype(np.float32)
    vectors = vectors / stretch[:, None].astype(np.float64)
    codes = quantised(vectors, scale)
    left = np.clip(vectors * (127 / scale) - codes, -0.5, 0.5)
    return codes, np.rint(left * 254).astype(np.int8), stretch


#: What the largest component of a request and the scale of an index stand at in whole numbers of two bytes.
_WHOLE = 127 * 254
_BLOCKS = "cell int, class string, keys array<long>, starts array<int>, ends array<int>, codes binary, fine binary, stretch array<float>"


def _pack(rows: pa.Table, scale: float) -> pa.Table:
    """The rows of one pack as a row."""
    rows = rows.combine_chunks()
    vectors = rows["embedding"].combine_chunks()
    codes, fine, stretch = both_bytes(vectors.flatten().to_numpy().reshape(len(rows), -1), scale)
    lists = [pa.array([rows[c].to_numpy()], pa.list_(kind)) for c, kind in (("place", pa.int64()), ("start", pa.int32()), ("end", pa.int32()))]
    coded = [pa.array([codes.tobytes()]), pa.array([fine.tobytes()]), pa.array([stretch], pa.list_(pa.float32()))]
    return pa.table([rows["cell"][:1].cast(pa.int32()), rows["class"][:1], *lists, *coded], ["cell", "class", "keys", "starts", "ends", "codes", "fine", "stretch"])


#: The day of a request without a date.
_ANY_DAY = 2**31


#: Heads that a task holds before it compares them, and the requests whose heads it holds at a time.
_HELD = 1_000_000
_GROUP = 4096


@dataclass(frozen=True)
class _Asked:
    """Requests and zones as arrays.

    What a request reads follows from them, and is worked out for a group of requests at a time: for all of them it is a number for
    each request, cell and class, which grows with the square of a corpus that asks for a share of its own rows.
    """

    vectors: np.ndarray
    most: np.ndarray
    days: np.ndarray
    #: Which of the profiles each request has, and the cells and chunks that it reads at least.
    profile: np.ndarray
    probes: np.ndarray
    wanted: np.ndarray
    #: The classes that each profile reads (profiles x classes).
    readable: np.ndarray
    classes: list[str]
    centres: np.ndarray
    #: The zones' cells, classes (by number), chunks and days.
    cell: np.ndarray
    kind: np.ndarray
    n: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def groups(self) -> list[tuple[int, int]]:
        """Requests from and to, so many that a task can hold the best of each of a group."""
        out, low, held = [], 0, 0
        for k, n in enumerate(self.most.tolist()):
            if k > low and (held + n > _HELD // 2 or k - low >= _GROUP):
                out.append((low, k))
                low, held = k, 0
            held += n
        return [*out, (low, len(self.most))] if len(self.most) else []

    def places(self, low: int, high: int) -> np.ndarray:
        """The place of each cell among those that each request of a group reads, -1 where it does not (cells x requests)."""
        out = np.full((max(1, len(self.centres)), high - low), -1, np.int32)
        for a in range(low, high, 256):
            own = slice(a, min(a + 256, high))
            if len(self.centres):
                order = np.argsort(-(self.vectors[own] @ self.centres.T), axis=1, kind="stable")
            else:
                order = np.zeros((own.stop - a, 1), np.int64)
            kinds, which = np.unique(np.stack([self.profile[own], self.days[own]], axis=1), axis=0, return_inverse=True)
            held = np.take_along_axis(np.stack([self._held(*k) for k in kinds])[which.ravel()], order, 1)
            there = held > 0
            near, before = np.cumsum(there, axis=1) - 1, np.cumsum(held, axis=1) - held
            read = there & ((near < self.probes[own, None]) | (before < self.wanted[own, None]))
            np.put_along_axis(out[:, a - low : own.stop - low], order.T, np.where(read, near, -1).T.astype(np.int32), 0)
        return out

    def _held(self, profile: int, day: int) -> np.ndarray:
        """How many chunks that may be read each cell has."""
        mask = self.readable[profile, self.kind]
        if day != _ANY_DAY:
            mask = mask & (self.start <= day) & (day <= self.end)
        return np.bincount(self.cell[mask], self.n[mask], max(1, len(self.centres)))

    def readers(self, places: np.ndarray, low: int, high: int, cell: int, kind: int, start: int, end: int) -> np.ndarray:
        """Those of a group, by number within it, that read rows of a cell and class with days from ``start`` to ``end``."""
        day = self.days[low:high]
        return np.flatnonzero((places[cell] >= 0) & self.readable[self.profile[low:high], kind] & ((day == _ANY_DAY) | ((start <= day) & (day <= end))))

    def cells(self) -> list[int]:
        """The cells that any request reads."""
        some = np.zeros(max(1, len(self.centres)), bool)
        for low, high in self.groups():
            some |= (self.places(low, high) >= 0).any(axis=1)
        return np.flatnonzero(some).tolist()

    @property
    def at(self) -> dict[tuple[int, str], tuple[np.ndarray, np.ndarray]]:
        """For each cell and class those that read it, with the place of the cell among theirs: to look at, as a search never holds it."""
        out: dict[tuple[int, str], tuple[np.ndarray, np.ndarray]] = {}
        for low, high in self.groups():
            places = self.places(low, high)
            for cell, kind, start, end in zip(self.cell.tolist(), self.kind.tolist(), self.start.tolist(), self.end.tolist(), strict=True):
                who = self.readers(places, low, high, cell, kind, start, end)
                if len(who):
                    z, none = (cell, self.classes[kind]), np.zeros(0, np.int64)
                    a, b = out.get(z, (none, none))
                    out[z] = np.append(a, who + low), np.append(b, places[cell, who])
        return out


def _best_heads(parts: list[tuple[np.ndarray, ...]], most: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of (request, cell, nth, key, guess) the best of each request, as many as it wants."""
    who, cell, nth, key, guess = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((key, -guess, who))
    own = who[order]
    first = np.flatnonzero(np.diff(own, prepend=-1))
    place = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
    order = order[place < most[own]]
    return who[order], cell[order], nth[order], key[order], guess[order]


def _heads(batches: Iterator[pa.RecordBatch], asked: _Asked, scale: float) -> Iterator[pa.RecordBatch]:
    """The best of a task's packs for each request that reads them, by codes. Where there are several groups the packs are held."""
    names, groups = ["asked", "cell", "nth", "place", "guess"], asked.groups()
    packs = list(batches) if len(groups) > 1 else batches
    for low, high in groups:
        parts, held, bars = [], 0, np.full(high - low, -np.inf)
        for part in _pack_heads(packs, asked, scale, low, high, bars):
            parts.append(part)
            held += len(part[0])
            if held > _HELD:
                parts = [_best_heads(parts, asked.most)]
                who, guess, held = parts[0][0], parts[0][4], len(parts[0][0])
                # A request that has all it wants takes no less than the last of these.
                last = np.flatnonzero(np.diff(who, append=-1))
                last = last[np.diff(last, prepend=-1) >= asked.most[who[last]]]
                bars[who[last] - low] = guess[last]
                if held > _HELD // 2:  # one request that wants very many: what follows is compared by the plan
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in parts[0]], names)
                    parts, held = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _best_heads(parts, asked.most)], names)


#: Scores of a pack that are worked on at a time.
_SCORES = 1 << 18


def _pack_heads(batches: Iterable[pa.RecordBatch], asked: _Asked, scale: float, low: int, high: int, bars: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Of each pack and the requests of a group that read it, the pairs that reach a request's bar: request, cell, nth, key and guess."""
    vectors, dims, places = asked.vectors[low:high], asked.vectors.shape[1], asked.places(low, high)
    most = np.maximum(np.abs(vectors).max(axis=1, keepdims=True), 1e-300)
    coded = np.rint(vectors * (_WHOLE / most))
    days, number = asked.days[low:high], {c: k for k, c in enumerate(asked.classes)}
    for b in batches:
        cols = dict(zip(b.schema.names, b.columns, strict=True))
        for k in range(b.num_rows):
            cell, kind = cols["cell"][k].as_py(), number[cols["class"][k].as_py()]
            starts, ends, keys = (cols[c][k].values.to_numpy() for c in ("starts", "ends", "keys"))
            own = asked.readers(places, low, high, cell, kind, starts.min(), ends.max())
            if not len(own):
                continue
            codes, fine = (np.frombuffer(cols[c][k].as_buffer(), np.int8).reshape(-1, dims).astype(np.float64) for c in ("codes", "fine"))
            codes, stretch = codes * 254 + fine, cols["stretch"][k].values.to_numpy()
            step = max(1, _SCORES // len(codes))
            for who in (own[i : i + step] for i in range(0, len(own), step)):
                score = (coded[who] @ codes.T) * (most[who] * scale / _WHOLE**2) * stretch
                day = days[who][:, None]
                score[(day != _ANY_DAY) & ((day < starts) | (day > ends))] = -np.inf
                row, place = np.nonzero((score >= bars[who][:, None]) & (score > -np.inf))
                if len(row):
                    at = who[row]
                    yield (at + low).astype(np.int32), np.full(len(row), cell, np.int32), places[cell, at], keys[place], score[row, place]


class VectorIndex:
    """One version of the index at ``path``."""

    def __init__(self, spark: SparkSession, path: str, meta: IndexMeta, params: IndexParams = IndexParams()) -> None:
        self.spark, self.path, self.meta, self.params = spark, path.rstrip("/"), meta, params
        self._zone_rows: dict[str, np.ndarray] | None = None
        self._seen: dict[tuple, dict[tuple, set[str]]] = {}
        at = f"{self.path}/{meta.folder}"
        # With schemas, as an index of no chunks has no files.
        self.rows, self.blocks, self.zones, self.kinds = (spark.read.schema(StructType.fromJson(json.loads(meta.schemas[t]))).parquet(f"{at}/{t}") for t in ("rows", "blocks", "zones", "kinds"))

    @classmethod
    def open(cls, spark: SparkSession, path: str, params: IndexParams = IndexParams()) -> VectorIndex | None:
        """The newest version, or None."""
        files = _Files(spark, path)
        names = files.names()
        return cls(spark, path, IndexMeta(**json.loads(files.read(names[-1]))), params) if names else None

    @classmethod
    def refresh(cls, chunks: DataFrame, path: str, params: IndexParams = IndexParams(), recreate: bool = False) -> VectorIndex:
        """The index of just these chunks: the newest version where it is that, else a new one."""
        spark, files = chunks.sparkSession, _Files(chunks.sparkSession, path)
        digest = corpus_digest(chunks)
        while True:
            names = files.names()
            old = None if recreate else cls.open(spark, path, params)
            if old and old.meta.digest == digest and "place" in old.rows.columns:
                return old
            new = cls._write(chunks, path, digest, old, params)
            if files.create(f"{int(names[-1]) + 1 if names else 0:08d}", json.dumps(asdict(new.meta))):
                return new
            recreate = False  # another writer was first: start from its version

    @property
    def chunks(self) -> DataFrame:
        """The indexed chunks with their embeddings."""
        return self.rows.drop("text_key", "row_key", "class", "cell", "place")

    def count(self) -> int:
        """Indexed points, as counted when the version was written."""
        return self.meta.points

    @classmethod
    def _write(cls, chunks: DataFrame, path: str, digest: str, old: VectorIndex | None, p: IndexParams) -> VectorIndex:
        spark, folder = chunks.sparkSession, f"v-{uuid.uuid4().hex[:12]}"
        at = f"{path.rstrip('/')}/{folder}"
        c = _with_fields(chunks)
        text = embedding_text()
        keyed = c.withColumn("text_key", F.md5(text.cast("binary"))).withColumn("row_key", F.xxhash64(*[F.col(x) for x in sorted(c.columns) if not dict(c.dtypes)[x].startswith("map")]))
        keyed = keyed.withColumn("class", F.md5(F.to_json(F.struct(*CLASS)).cast("binary")))
        if "embedding" in chunks.columns:
            # Vectors of their own: those without a direction are near nothing.
            embedded = keyed.withColumn("embedding", F.col("embedding").cast("array<double>")).where(usable(F.col("embedding"))).withColumn("embedding", unit(F.col("embedding")))
        elif old is None:
            embedded = keyed.withColumn("embedding", embed(text))
        else:
            known = old.rows.select("text_key", "embedding").dropDuplicates(["text_key"])
            fresh = keyed.join(known.select("text_key"), "text_key", "left_anti").withColumn("embedding", embed(text))
            embedded = keyed.join(known, "text_key").unionByName(fresh)
        embedded.write.parquet(f"{at}/embedded")
        embedded = spark.read.schema(embedded.schema).parquet(f"{at}/embedded")

        points = embedded.count()
        cells = max(1, min(p.most_cells, round(points / p.cell_rows)))
        reuse = old is not None and len(old.meta.centres) > 1 and abs(len(old.meta.centres) - cells) <= 0.5 * cells
        centres = np.array(old.meta.centres) if reuse else fit_cells(embedded, cells) if cells > 1 else np.zeros((0, 0))
        sample = embedded if points <= 4096 else embedded.sample(4096 / points, 3)
        big = sample.select(F.explode("embedding").alias("x")).where("x <> 0").agg(F.percentile_approx(F.abs("x"), p.quantile)).first()[0]
        dims = embedded.select(F.size("embedding")).first()
        dims, scale = dims[0] if dims else 0, float(big or 1.0)

        # Numbers that rise with the chunk ids: of chunks with the same codes the lower ids go first, as in the exact search.
        embedded = embedded.orderBy("chunk_id", "row_key").withColumn("place", F.monotonically_increasing_id())
        if len(centres):
            placed = embedded.withColumn("cell", cls._udf(centres, _first_cell, "int")(F.col("embedding")))
        else:
            placed = embedded.withColumn("cell", F.lit(0))
        # A large cell is written by several tasks.
        tasks = max(1, -(-points // (cells * p.task_rows)))
        placed.repartition("cell", F.pmod(F.xxhash64("row_key"), F.lit(tasks))).write.partitionBy("cell").parquet(f"{at}/rows")
        rows = spark.read.schema(placed.schema).parquet(f"{at}/rows")
        start, end = _days(F.col("valid_from"), _FIRST), _days(F.col("valid_to"), _LAST)
        ranged = rows.withColumn("start", start).withColumn("end", end)
        zones = ranged.groupBy("cell", "class").agg(*[F.any_value(x).alias(x) for x in CLASS], F.count(F.lit(1)).alias("n"), F.min("start").alias("start"), F.max("end").alias("end"))
        zones.coalesce(1).write.parquet(f"{at}/zones")
        zones = spark.read.schema(zones.schema).parquet(f"{at}/zones")
        parts = F.ceil(F.col("n") / p.block).cast("int")
        packs = ranged.join(zones.select("cell", "class", parts.alias("parts")), ["cell", "class"]).withColumn("part", F.pmod(F.xxhash64("row_key"), F.col("parts")))
        # All classes of a cell are packed in one task, so that its folder gets a file for 1,024 rows of each, not a file for each task.
        grouped = packs.select("cell", "class", "part", "place", "start", "end", "embedding").repartition("cell", "part").groupBy("cell", "class", "part")
        packed = grouped.applyInArrow(lambda t: _pack(t, scale), _BLOCKS)
        packed.write.partitionBy("cell").parquet(f"{at}/blocks")
        kinds = chunk_kinds(rows)
        kinds.write.parquet(f"{at}/kinds")
        _drop(spark, f"{at}/embedded")
        schemas = {"kinds": kinds.schema.json(), "rows": placed.schema.json(), "blocks": packed.schema.json(), "zones": zones.schema.json()}
        meta = IndexMeta(folder, points, digest, dims, scale, schemas, [list(map(float, r)) for r in centres])
        out = cls(spark, path, meta, p)
        return cls(spark, path, IndexMeta(**(asdict(meta) | {"probes": out._measured()})), p)

    @staticmethod
    def _udf(centres: np.ndarray, f, kind: str):
        @F.pandas_udf(kind)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            yield from f(centres, batches)

        return run

    def _measured(self) -> dict[str, int]:
        """For each role the fewest probes that meet the recall, on short queries made of the indexed texts.

        Half of them ask at a day in the middle of the chunks' validities: with fewer chunks to choose from, those wanted lie in more
        cells. The harder half decides.
        """
        p, n = self.params, len(self.meta.centres)
        if n <= 1 or not self.meta.points:
            return {}
        some = self.rows.orderBy(F.xxhash64("text_key"), "chunk_id").limit(p.samples).select("chunk_id", "text").collect()
        starts = self._zones()["start"]
        known = np.sort(starts[starts > _FIRST])
        day = datetime.date(1970, 1, 1) + datetime.timedelta(days=int(known[len(known) // 2])) if len(known) else None
        asked = []
        for k, r in enumerate(some):
            words = (r["text"] or "").split()
            for role in CLEARANCE:
                asked.append({"query_id": f"{role}|{k % 2}|{k}", "query": " ".join(words[len(words) // 2 :][:8]), "role": role, "top_k": p.sample_k, "source_types": [], "jurisdiction": None, "as_of_date": day if k % 2 else None, "method": None})
        requests = self.spark.createDataFrame(pa.Table.from_pylist(asked, to_arrow_schema(REQUEST)), REQUEST)
        kind = F.substring_index("query_id", "|", 2)
        found = {(r["kind"], r["nth"]): r["count"] for r in self.found(requests, probes=n).groupBy(kind.alias("kind"), "nth").count().collect()}
        out = {}
        for role in CLEARANCE:
            need = []
            for half in ("0", "1"):
                counts = np.array([found.get((f"{role}|{half}", k), 0) for k in range(n)])
                need.append(int(np.searchsorted(np.cumsum(counts) / counts.sum(), p.recall)) + 1 if counts.sum() else 0)
            out[role] = max(need) or n
        return out

    def _zones(self) -> dict[str, np.ndarray]:
        """The zones on the driver: a row for each cell and access class."""
        if self._zone_rows is None:
            rows = self.zones.select("cell", "class", "n", "start", "end").orderBy("cell", "class").toArrow()
            self._zone_rows = {c: np.asarray(rows[c].to_pylist() if c == "class" else rows[c]) for c in rows.column_names}
        return self._zone_rows

    def _readable(self, profiles: list[tuple], clearance: dict[str, str]) -> dict[tuple, set[str]]:
        """The access classes that each (role, source types, jurisdiction) may read, as ``security`` decides it; remembered."""
        held = self._seen.setdefault(tuple(sorted(clearance.items())), {})
        if new := [p for p in dict.fromkeys(profiles) if p not in held]:
            asked = self.spark.createDataFrame([(str(k), role, list(types), jurisdiction) for k, (role, types, jurisdiction) in enumerate(new)], "query_id string, role string, source_types array<string>, jurisdiction string")
            none = F.lit(None).cast("date")
            scope = scope_reason(F.col("q_source_types"), F.col("q_jurisdiction"), none, F.col("source_type"), F.col("jurisdiction"), none, none)
            classes = self.zones.select("class", *CLASS).dropDuplicates(["class"])
            for p in new:
                held[p] = set()
            for r in classes.join(as_requests(asked), (access_of(clearance) == "authorized") & (scope == "in_scope")).select("query_id", "class").collect():
                held[new[int(r["query_id"])]].add(r["class"])
        return held

    def cells_of(self, requests: DataFrame, clearance: dict[str, str] = CLEARANCE, probes: int | None = None) -> tuple[list[str], _Asked]:
        """Ids of the requests with a direction, and what tells which cells and classes each of them reads."""
        p, zones = self.params, self._zones()
        table = local_requests(requests).toArrow()
        own = "embedding" in table.column_names
        rows = table.drop_columns(["embedding"] if own else []).to_pylist()
        if own and rows:
            vectors = np.stack(table["embedding"].to_numpy()).astype(np.float64)
        else:
            vectors = hash_embeddings([r["query"] for r in rows])
        there = [k for k in range(len(rows)) if vectors[k].any()]
        rows, vectors = [rows[k] for k in there], vectors[there] if there else np.zeros((0, self.meta.dims))
        profiles = [(r["role"], tuple(r["source_types"] or ()), r["jurisdiction"]) for r in rows]
        distinct, readable = list(dict.fromkeys(profiles)), self._readable(profiles, clearance)
        classes, kind = np.unique(zones["class"], return_inverse=True)
        reads = np.array([np.isin(classes, list(readable[x])) for x in distinct], bool).reshape(len(distinct), len(classes))
        number = {x: k for k, x in enumerate(distinct)}
        days = np.array([_ANY_DAY if r["as_of_date"] is None else (r["as_of_date"] - datetime.date(1970, 1, 1)).days for r in rows], np.int64)
        most = np.array([r["top_k"] * p.oversample for r in rows], np.int64)
        least = np.array([probes or self.meta.probes.get(r["role"], len(self.meta.centres) or 1) for r in rows], np.int64)
        centres = np.array(self.meta.centres, np.float64)
        who = np.array([number[x] for x in profiles], np.int64)
        return [r["query_id"] for r in rows], _Asked(vectors, most, days, who, least, p.enough * most, reads, classes.tolist(), centres, zones["cell"], kind, zones["n"], zones["start"], zones["end"])

    def found(self, requests: DataFrame, clearance: dict[str, str] = CLEARANCE, probes: int | None = None) -> DataFrame:
        """The best ``top_k`` chunks of each request: query_id, rank, chunk, dense_score, cell and nth.

        Requests and zones are few and on the driver, so the cells to read are partitions known before the plan is made.
        """
        p, requests = self.params, local_requests(requests)
        ids, asked = self.cells_of(requests, clearance, probes)
        cells, scale = asked.cells(), self.meta.scale
        inside = F.col("cell").isin(cells) if cells else F.lit(False)
        kept = pa.table({"asked": pa.array(range(len(ids)), pa.int32()), "query_id": pa.array(ids, pa.string()), "most": pa.array(asked.most, pa.int64())})
        by_number = F.broadcast(self.spark.createDataFrame(kept, "asked int, query_id string, most long"))
        directed = pa.table({"query_id": kept["query_id"], "q_embedding": pa.array(list(asked.vectors), pa.list_(pa.float64()))})
        directions = F.broadcast(self.spark.createDataFrame(directed, "query_id string, q_embedding array<double>"))
        # Packs of many cells and classes meet in a task, so that their heads are compared before they leave it.
        tasks = max(self.spark.sparkContext.defaultParallelism, -(-2 * self.meta.points * self.meta.dims // p.task_bytes))
        packs = self.blocks.where(inside).select("cell", "class", "starts", "ends", "keys", "codes", "fine", "stretch").coalesce(tasks)
        heads = packs.mapInArrow(lambda it: _heads(it, asked, scale), "asked int, cell int, nth int, place long, guess double")
        heads = heads.join(by_number, "asked")
        heads = top(heads, F.col("most"), F.desc("guess"), F.col("place")).drop("rank")
        rows = _with_fields(self.rows.where(inside))
        exact = rows.join(heads.select("query_id", "cell", "nth", "place"), ["cell", "place"])
        # What codes found was chosen among what may be read; a number is no proof, so access is asked again of the row.
        limits = as_requests(requests.select("query_id", "role", "source_types", "jurisdiction", "as_of_date", "top_k"))
        exact = exact.join(limits, "query_id").where(may_see(clearance)).join(directions, "query_id")
        # The vectors of requests meet the rows last and go no further: no head carries one through a shuffle.
        scored = exact.select("query_id", "row_key", "q_top_k", _chunk(rows), dot(F.col("embedding"), F.col("q_embedding")).alias("dense_score"), "cell", "nth").dropDuplicates(["query_id", "row_key"])
        return top(scored.drop("row_key"), F.col("q_top_k"), F.desc("dense_score"), F.col("chunk.chunk_id")).drop("q_top_k")

    def search(self, requests: DataFrame, least: int = 0, clearance: dict[str, str] = CLEARANCE) -> DataFrame:
        """As ``retrieval.dense``: query_id, chunk, dense_score, rank; the best max(top_k, least) of each request."""
        asked = requests.withColumn("top_k", F.greatest("top_k", F.lit(least))) if least else requests
        return self.found(asked, clearance).drop("cell", "nth")

    def bytes_read(self) -> dict[str, int]:
        """Bytes of codes, of their second bytes and of vectors in the index: what a search of all cells reads of each."""
        return {"codes": self.meta.points * self.meta.dims, "fine": self.meta.points * self.meta.dims, "vectors": 8 * self.meta.points * self.meta.dims}
