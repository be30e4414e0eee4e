"""The passage index as stored tables: passages, their placements and postings, built in generations and searched by stems."""

from __future__ import annotations

import hashlib
import re
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.responses import first_heading
from lodestone.functions.stem import stemmed
from lodestone.operators import chunker, text
from lodestone.operators.search import B, DEPTH, K1, fused, query_phrases, terms
from lodestone.operators.vectors import VectorStore, ranked
from lodestone.shipping import ship
from lodestone.sources.log import exists

SCHEMA_VERSION = 4
#: Hits that fusion keeps for the reranker, and further placements that a hit shows.
KEPT, SHOWN = 40, 8
#: Stems, and passages' hashes, that a task remembers.
REMEMBERED = 1_000_000
_WORD = re.compile(r"[^\W_]+")

_PLACED = "source string, resource string, blob_sha string, derived_sha string, doc_id long, at timestamp, title string, ordinal long, heading_path string, char_start long, char_end long, chunk_hash string, chunk_text string"
_TABLES = {"chunk": "chunk_hash string, chunk_text string, chars long, dl long", "placement": _PLACED.rsplit(", ", 1)[0], "posting": "stem string, term string, chunk_hash string, dl int, positions array<int>",
           "bare": "source string, resource string, blob_sha string, derived_sha string, at timestamp"}
#: What a generation takes out of those before it: placements by key, all of a source, passages without any placement left.
_REMOVED = {"gone": "source string, resource string, derived_sha string", "cleared": "source string", "dead": "chunk_hash string"}
#: Tables as they are stored where that is another form: a passage has a number (born, id) of its own, and a row of postings is a word with
#: the passages of one batch that hold it.
_STORED = _TABLES | {"chunk": f"{_TABLES['chunk']}, born int, id long", "posting": "stem string, term string, born int, low long, ids array<long>, positions array<array<int>>"}
_ORDER = {"chunk": ["chunk_hash"], "posting": ["stem", "term", "born", "low"], "placement": ["chunk_hash", "source", "resource"], "bare": ["resource"]}
_META = "seq long, generation string, full boolean, removes boolean, home string, schema_version int"
_POSTED = _STORED["posting"]


def derivations(documents: DataFrame, at: Column | None = None) -> DataFrame:
    """Documents (doc_id, source, text) as derivations at an address: resource, derived_sha, time, and the title from the whole text."""
    return documents.where("text is not null").select(
        "source", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("resource"), F.sha2(F.col("text").cast("binary"), 256).alias("derived_sha"), F.col("doc_id").cast("long").alias("doc_id"),
        (F.lit(None) if at is None else at).cast("timestamp").alias("at"), first_heading(F.col("text")).alias("title"), "text",
    )


def _cut(records: bool, stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages of stripped texts; their spans lie in the texts as they were. A task gives the text of a passage that repeats once (while it remembers it)."""
    seen: set[str] = set()
    names = [c.split()[0] for c in _PLACED.split(", ")]
    schema = pa.schema([(n, {"long": pa.int64(), "timestamp": pa.timestamp("us", "UTC")}.get(k, pa.string())) for n, k in (c.split() for c in _PLACED.split(", "))])
    for batch in stream:
        rows = []
        for r in batch.to_pylist():
            kept, origin = r["kept_from"], r["source_from"]

            def source(at: int, kept: list[int] = kept, origin: list[int] = origin) -> int:
                k = bisect_right(kept, at) - 1
                return origin[k] + at - kept[k]

            for i, (path, a, b, piece) in enumerate(chunker.chunked(r["text"], records=records)):
                key = hashlib.sha256(piece.encode()).hexdigest()
                rows.append((r["source"], r["resource"], r["blob_sha"], r["derived_sha"], r["doc_id"], r["at"], r["title"], i, path, source(a), source(b - 1) + 1, key, None if key in seen else piece))
                if len(seen) > REMEMBERED:
                    seen.clear()
                seen.add(key)
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _of_blobs(derived: DataFrame) -> DataFrame:
    """Derivations with the blob that each was made of; one that names none is its own, so nothing supersedes it."""
    return derived if "blob_sha" in derived.columns else derived.withColumn("blob_sha", F.col("derived_sha"))


def passages(derived: DataFrame, learnt: DataFrame | None = None, records: bool = True) -> DataFrame:
    """The placements of derivations, with their passages' texts: boilerplate of the source stripped, the rest chunked (``records``: see the chunker)."""
    ship(derived.sparkSession)
    derived = _of_blobs(derived)
    stripped = text.boilerplate_text(derived, learnt)
    marks = [F.transform("marks", lambda m: m["kept_from"]).alias("kept_from"), F.transform("marks", lambda m: m["source_from"]).alias("source_from")]
    return stripped.select("source", "resource", "blob_sha", "derived_sha", "doc_id", "at", "title", "text", *marks).mapInArrow(partial(_cut, records), _PLACED)


def _posted(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word of a batch of passages with its stem, the passages that hold it, and its places in each."""
    stems: dict[str, str] = {}
    for batch in stream:
        if not batch.num_rows:
            continue
        words = [_WORD.findall(body.lower()) for body in batch.column("chunk_text").to_pylist()]
        sizes = np.array([len(x) for x in words])
        terms: dict[str, int] = {}
        flat = np.fromiter((terms.setdefault(w, len(terms)) for x in words for w in x), np.int64, sizes.sum())
        row = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = np.argsort(flat, kind="stable")  # places of a word stay in order of passages
        flat, row, place = flat[order], row[order], place[order]
        fresh = np.flatnonzero(np.append(True, (flat[1:] != flat[:-1]) | (row[1:] != row[:-1]))[: len(flat)])  # a word in a passage
        heads = np.searchsorted(flat[fresh], np.arange(len(terms) + 1))  # a word
        ids = batch.column("id").to_numpy()[row[fresh]]
        if len(stems) > REMEMBERED:
            stems.clear()
        for word in terms:
            if word not in stems:
                stems[word] = stemmed(word)
        ends = pa.array(heads, pa.int32())
        places = pa.ListArray.from_arrays(pa.array(np.append(fresh, len(flat)), pa.int32()), pa.array(place, pa.int32()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([stems[w] for w in terms], pa.string()), pa.array(list(terms), pa.string()), pa.array(np.full(len(terms), batch.column("born")[0].as_py()), pa.int32()), pa.array(ids[heads[:-1]], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(ids, pa.int64())), pa.ListArray.from_arrays(ends, places)],
            names=[c.split()[0] for c in _POSTED.split(", ")],
        )


class IndexStore:
    """Index tables in a folder that all executors reach.

    Each build writes a generation of its own and is committed by one row of ``meta``: what a failed build has
    written is never read, and a repeated build adds only what is missing. A generation may also take rows out of those
    before it; readers merge, and ``compact`` writes what is in force as one generation. A ``snapshot`` reads the
    generations that are in force when it is made, whatever is committed later.
    """

    def __init__(self, spark: SparkSession, folder: str, generations: list | None = None):
        self.spark, self.folder, self._pinned = spark, folder.rstrip("/"), generations

    def generations(self) -> list:
        """The rows of ``meta`` in force: the last full generation and all after it."""
        if self._pinned is not None:
            return self._pinned
        if not exists(self.spark, f"{self.folder}/meta"):
            return []
        rows = sorted(self.spark.read.schema(_META).parquet(f"{self.folder}/meta").collect(), key=lambda r: r["seq"])
        if any(r["schema_version"] != SCHEMA_VERSION for r in rows):
            raise ValueError(f"{self.folder} has another schema version than {SCHEMA_VERSION}")
        full = max((i for i, r in enumerate(rows) if r["full"]), default=0)
        return rows[full:]

    def snapshot(self) -> IndexStore:
        return IndexStore(self.spark, self.folder, self.generations())

    def fork(self, folder: str) -> IndexStore:
        """An index of its own that begins with this one's generations; only their names are written."""
        found = self.generations()
        if found:
            self.spark.createDataFrame(found, _META).coalesce(1).write.parquet(f"{folder.rstrip('/')}/meta")
        return IndexStore(self.spark, folder)

    def _read(self, generations: list, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{g['home']}/{g['generation']}/{name}" for g in generations])

    def table(self, name: str) -> DataFrame:
        """``chunk``, ``placement``, ``posting`` or ``bare`` (derivations that gave no passage): the rows of all generations in force that no later one takes out.

        Generations between two that remove are read together, so plans grow with removals only, until the next compaction.
        """
        columns = [c.split()[0] for c in _TABLES[name].split(", ")]
        if name == "posting":
            return self.places(self.blocks()).join(self.numbered("chunk_hash", F.col("dl").cast("int").alias("dl")), ["born", "id"]).select(*columns)
        return self._in_force(name).select(*columns)

    def numbered(self, *columns: Column | str) -> DataFrame:
        """born, id and more columns of the passages in force."""
        return self._in_force("chunk").select("born", "id", *columns)

    def blocks(self) -> DataFrame:
        """Rows of postings as they are stored, those of passages that are out of force among them: stem, term, born, low (the first of ids), ids, positions."""
        found = self.generations()
        return self._read(found, "posting", _STORED["posting"]) if found else self.spark.createDataFrame([], _STORED["posting"])

    @staticmethod
    def places(blocks: DataFrame) -> DataFrame:
        """A row for each word and passage: stem, term, born, id, positions."""
        return blocks.select("stem", "term", "born", F.explode(F.arrays_zip("ids", "positions")).alias("p")).select("stem", "term", "born", F.col("p.ids").alias("id"), F.col("p.positions").alias("positions"))

    def words(self) -> DataFrame:
        """term, passages, places: in how many passages each word is, and how often. Rows are met with passages only where some are out of force."""
        posted = self.blocks().select("term", F.size("ids").cast("long").alias("n"), F.size(F.flatten("positions")).cast("long").alias("m"))
        if any(g["removes"] for g in self.generations()[1:]):
            posted = self.places(self.blocks()).join(self.numbered(), ["born", "id"], "left_semi").select("term", F.lit(1).cast("long").alias("n"), F.size("positions").cast("long").alias("m"))
        return posted.groupBy("term").agg(F.sum("n").alias("passages"), F.sum("m").alias("places"))

    def _in_force(self, name: str) -> DataFrame:
        runs: list[list] = []
        for g in self.generations():
            if not runs or g["removes"]:
                runs.append([])
            runs[-1].append(g)
        if not runs:
            return self.spark.createDataFrame([], _STORED[name])
        parts = []
        for i, run in enumerate(runs):
            rows, later = self._read(run, name, _STORED[name]), [r[0] for r in runs[i + 1 :]]
            if later and name in ("placement", "bare"):
                gone, cleared = (self._read(later, x, _REMOVED[x]).distinct() for x in ("gone", "cleared"))
                rows = rows.join(gone, rows["source"].eqNullSafe(gone["source"]) & (rows["resource"] == gone["resource"]) & (rows["derived_sha"] == gone["derived_sha"]), "left_anti")
                rows = rows.join(cleared, rows["source"].eqNullSafe(cleared["source"]), "left_anti")
            elif later:
                rows = rows.join(self._read(later, "dead", _REMOVED["dead"]).distinct(), "chunk_hash", "left_anti")
            parts.append(rows.select(*[c.split()[0] for c in _STORED[name].split(", ")]))
        return reduce(DataFrame.unionByName, parts)

    def _commit(self, name: str, parts: dict[str, DataFrame], full: bool = False, removes: bool = False) -> None:
        for table, rows in parts.items():
            rows.write.parquet(f"{self.folder}/{name}/{table}")
        seq = max((r["seq"] for r in self.generations()), default=-1) + 1
        self.spark.createDataFrame([(seq, name, full, removes, self.folder, SCHEMA_VERSION)], _META).coalesce(1).write.mode("append").parquet(f"{self.folder}/meta")

    def _stored(self, name: str, rows: DataFrame) -> DataFrame:
        """rows, written once under a generation that isn't committed yet, and read from there."""
        path = f"{self.folder}/{name}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def build(self, derived: DataFrame, learnt: DataFrame | None = None, records: bool = True) -> None:
        """Adds the derivations (see ``derivations``) that have no placement yet; bodies that are stored stay one.

        Of several derivations of one blob (``blob_sha``, where the column is there) at an address only the newest by time, then
        hash, is in the index: an older one is not added, and one that is stored is taken out, with passages that nothing else has.
        Without ``records`` all texts are prose: see the chunker.
        """
        key, derived, now = ["source", "resource", "derived_sha"], _of_blobs(derived), self.snapshot()
        name = uuid.uuid4().hex
        placed = now.table("placement")
        known = placed.select(*key, "blob_sha", "at").unionByName(now.table("bare"))
        versions = known.withColumn("stored", F.lit(True)).unionByName(derived.select(*key, "blob_sha", F.col("at").cast("timestamp").alias("at"), F.lit(False).alias("stored"))).distinct()
        one = versions.groupBy("source", "resource", "blob_sha", "derived_sha").agg(F.max("at").alias("at"), F.max("stored").alias("stored"))
        each = one.groupBy("source", "resource", "blob_sha").agg(F.max(F.struct("at", "derived_sha")).alias("best"), F.collect_list(F.struct("derived_sha", "at", "stored")).alias("all"))
        judged = each.select("source", "resource", "blob_sha", F.col("best.derived_sha").alias("best"), F.explode("all").alias("d")).select("source", "resource", "blob_sha", "d.*", (F.col("d.derived_sha") == F.col("best")).alias("newest"))
        add = F.col("newest") & ~F.col("stored")
        judged = self._stored(f"{name}/judged", judged)  # a row an address and derivation
        n, n_old, n_all = judged.agg(F.count_if(add), F.count_if(F.col("stored") & ~F.col("newest")), F.count(F.lit(1))).first()
        few = n * 2 > n_all  # texts are matched with the shorter list, of what is added or of what isn't
        listed = judged.where(~add if few else add).select(F.col("source").alias("s"), F.col("resource").alias("r"), F.col("derived_sha").alias("d"))
        missing = derived.join(listed, derived["source"].eqNullSafe(F.col("s")) & (derived["resource"] == F.col("r")) & (derived["derived_sha"] == F.col("d")), "left_anti" if few else "left_semi")
        cut = self._stored(f"{name}/passage", passages(missing, learnt, records))
        fresh = cut.where("chunk_text is not null").select("chunk_hash", "chunk_text")
        if now.generations():
            fresh = self._stored(f"{name}/fresh", fresh.join(now.table("chunk").select("chunk_hash"), "chunk_hash", "left_anti"))
        # Dealt by ranges of hashes, in which equal ones meet, so texts travel once for telling them apart and for the order.
        fresh = fresh.repartitionByRange("chunk_hash").dropDuplicates(["chunk_hash"]).sortWithinPartitions("chunk_hash")
        born = F.lit(uuid.uuid4().int >> 97).cast("int")
        fresh = self._stored(f"{name}/chunk", fresh.select("*", F.length("chunk_text").cast("long").alias("chars"), F.size(terms(F.col("chunk_text"))).cast("long").alias("dl"), born.alias("born"), F.monotonically_increasing_id().alias("id")))
        # Sorted by stem over all files, so a search reads the few row groups of its stems; a frequent stem spans several files.
        # Sorting by ranges reads its input twice, so what is costly to make is stored first.
        posted = self._stored(f"{name}/posted", fresh.select("born", "id", "chunk_text").mapInArrow(_posted, _POSTED))
        by = _ORDER["posting"]
        parts = {
            "posting": posted.repartitionByRange(*by).sortWithinPartitions(*by),
            "placement": cut.drop("chunk_text").repartitionByRange(*_ORDER["placement"]).dropDuplicates([*key, "ordinal", "chunk_hash"]).sortWithinPartitions("chunk_hash"),
        }
        # A derivation without a passage is known all the same: an older one of its blob that comes later doesn't take its place.
        cut_keys, added = cut.select(*(F.col(c).alias(f"_{c}") for c in key)).distinct(), judged.where(add)
        has = added["source"].eqNullSafe(F.col("_source")) & (added["resource"] == F.col("_resource")) & (added["derived_sha"] == F.col("_derived_sha"))
        parts["bare"] = added.join(cut_keys, has, "left_anti").select(*(c.split()[0] for c in _TABLES["bare"].split(", ")))
        if n_old:
            old = self._stored(f"{name}/gone", judged.where("stored and not newest").select(*key))
            same = placed["source"].eqNullSafe(old["source"]) & (placed["resource"] == old["resource"]) & (placed["derived_sha"] == old["derived_sha"])
            left = placed.join(old, same, "left_anti").select("chunk_hash").unionByName(cut.select("chunk_hash"))
            parts["dead"] = placed.join(old, same, "left_semi").select("chunk_hash").distinct().join(left, "chunk_hash", "left_anti")
            parts["cleared"] = self.spark.createDataFrame([], _REMOVED["cleared"])
        self._commit(name, parts, removes=bool(n_old))

    def clear(self, *source: str | None) -> None:
        """Takes out a source's placements (None: those without a source) and the passages that have none left, by names alone; without a source all."""
        none = {x: self.spark.createDataFrame([], schema) for x, schema in _STORED.items()}
        if not source:
            self._commit(uuid.uuid4().hex, none, full=True)
            return
        placed = self.snapshot().table("placement")
        own = F.col("source").eqNullSafe(F.lit(source[0]))
        # One pass: passages with a placement in the source and none elsewhere.
        dead = placed.groupBy("chunk_hash").agg(F.min(own).alias("only")).where("only").select("chunk_hash")
        removed = {"gone": self.spark.createDataFrame([], _REMOVED["gone"]), "cleared": self.spark.createDataFrame([(source[0],)], _REMOVED["cleared"]), "dead": dead}
        self._commit(uuid.uuid4().hex, none | removed, removes=True)

    def compact(self) -> None:
        """Writes what is in force as one generation, in the layout of a build."""
        now, name = self.snapshot(), uuid.uuid4().hex
        parts = {x: now._in_force(x) for x in ("chunk", "placement", "bare")}
        live = now.places(now.blocks()).join(now.numbered(), ["born", "id"], "left_semi")
        # In blocks again: those of a word and 8,192 numbers in a row.
        blocks = live.groupBy("stem", "term", "born", F.shiftright("id", 13).alias("_run")).agg(F.array_sort(F.collect_list(F.struct("id", "positions"))).alias("p"))
        parts["posting"] = self._stored(f"{name}/posted", blocks.select("stem", "term", "born", F.col("p.id")[0].alias("low"), F.col("p.id").alias("ids"), F.col("p.positions").alias("positions")))
        self._commit(name, {x: rows.repartitionByRange(*_ORDER[x]).sortWithinPartitions(*_ORDER[x]) for x, rows in parts.items()}, full=True)

    def counts(self) -> DataFrame:
        """chunks, chars, placements, sources of the index."""
        chunks = self.table("chunk").agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("chars"), F.lit(0)).cast("long").alias("chars"))
        placed = self.table("placement").agg(F.count(F.lit(1)).alias("placements"), F.count_distinct("source").alias("sources"))
        return chunks.join(F.broadcast(placed))  # one row each


def _minus(n: int):
    return lambda x: x - n


def word_search(store: IndexStore, query: str, depth: int = DEPTH, source: str | None = None, stems: bool = True) -> DataFrame:
    """chunk_hash, score, rank of the passages that hold every phrase of the query, best first, by BM25.

    A term with punctuation inside is a phrase. Words match by their stems, or as they are. With a source only
    passages placed there are ranked; counts of documents are those of the whole index. No word, no hit.
    """
    spark, store = store.spark, store.snapshot()
    phrases = [[stemmed(w) if stems else w for w in words] for words in query_phrases(query)]
    wanted = sorted({w for words in phrases for w in words})
    if not wanted:
        return spark.createDataFrame([], "chunk_hash string, score double, rank long")
    key = F.col("stem" if stems else "term")
    posted = store.blocks().where(F.col("stem").isin(sorted({stemmed(w) for w in wanted}) if not stems else wanted) & key.isin(wanted))
    places = store.places(posted).groupBy("born", "id").agg(*[F.flatten(F.collect_list(F.when(key == w, F.col("positions")))).alias(f"at{i}") for i, w in enumerate(wanted)])
    column = {w: f"at{i}" for i, w in enumerate(wanted)}

    def count(phrase: list[str]) -> Column:
        starts = F.col(column[phrase[0]])
        for i, w in enumerate(phrase[1:], 1):
            starts = F.array_intersect(starts, F.transform(column[w], _minus(i)))
        return F.size(starts)

    numbers = range(len(phrases))
    hits = places.select("born", "id", *[count(p).alias(f"tf{i}") for i, p in enumerate(phrases)]).join(store.numbered("chunk_hash", "dl"), ["born", "id"])  # those in force
    df = hits.agg(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in numbers])
    total = store.table("chunk").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("words"))
    scored = hits.where(" and ".join(f"tf{i} > 0" for i in numbers)).join(F.broadcast(df)).join(F.broadcast(total))  # one row each
    if source is not None:
        scored = scored.join(store.table("placement").where(F.col("source") == source).select("chunk_hash"), "chunk_hash", "left_semi")

    def part(i: int) -> Column:
        n, tf = F.col(f"df{i}"), F.col(f"tf{i}")
        return F.ln((F.col("n") - n + 0.5) / (n + 0.5) + 1) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / (F.col("words") / F.col("n"))))

    best = scored.select("chunk_hash", F.round(sum((part(i) for i in numbers), F.lit(0.0)), 6).alias("score")).orderBy(F.desc("score"), "chunk_hash").limit(depth)
    return best.select("chunk_hash", "score", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_hash")).cast("long").alias("rank"))


def first_placements(placed: DataFrame, hits: list[str], shown: int = SHOWN) -> DataFrame:
    """Of each hit its first placement by source, document and ordinal, up to ``shown`` further ones, and how many others it has.

    ``hits`` are a search's (100 at most), so they prune the scan. A task keeps the least few of its own placements of
    a hit before they meet, so a passage with very many costs no task more.
    """
    order = F.struct("source", "doc_id", "ordinal")
    at = placed.where(F.col("chunk_hash").isin(hits)).select("chunk_hash", order.alias("p"), F.pmod(F.xxhash64("doc_id", "ordinal"), F.lit(64)).alias("part"))
    near = Window.partitionBy("chunk_hash", "part").orderBy("p")
    few = at.withColumn("n", F.row_number().over(near)).where(F.col("n") <= shown + 1)
    few = few.groupBy("chunk_hash").agg(F.slice(F.array_sort(F.collect_list("p")), 1, shown + 1).alias("few"))
    total = at.groupBy("chunk_hash").agg((F.count(F.lit(1)) - 1).alias("also_at_total"))
    return few.join(total, "chunk_hash")


def vector_search(store: IndexStore, vectors: VectorStore, query: list[float], depth: int = DEPTH, source: str | None = None) -> DataFrame:
    """chunk_hash, similarity, rank of the passages nearest to a vector by cosine; vectors of passages no longer in the index are left out.

    Without a source the store's best are checked against the index, a few hundred names at most in most cases; within one
    every vector's score meets the source's passages.
    """
    store = store.snapshot()
    if source is not None:
        inside = store.table("placement").where(F.col("source") == source).select("chunk_hash")
        return ranked(vectors.scores(query).join(inside, "chunk_hash", "left_semi"), depth)
    present = lambda hashes: {r["chunk_hash"] for r in store.table("chunk").select("chunk_hash").where(F.col("chunk_hash").isin(hashes)).collect()}
    rows = [(h, s, i) for i, (h, s) in enumerate(vectors.top(query, depth, present), 1)]
    return store.spark.createDataFrame(rows, "chunk_hash string, similarity double, rank long")


def hybrid(store: IndexStore, query: str, vectors: VectorStore, asked: list[float], limit: int = 10, source: str | None = None, reranker=None, snippet: int = 400, stems: bool = True) -> DataFrame:
    """The best passages of a query by words and by vector: fused by rank, reranked where a reranker is given, with provenance.

    Both arms rank 100 passages of the index, or of ``source`` in it (see ``word_search``, ``vector_search``). ``reranker`` scores a list of at most 40 texts; without
    one, or if it fails, ranks stand and ``no_rerank`` says why.
    """
    from lodestone.operators.embed import reranked

    store = store.snapshot()
    placed = store.table("placement")
    inside = placed if source is None else placed.where(F.col("source") == source)
    by_vector = vector_search(store, vectors, asked, source=source)
    both = fused(word_search(store, query, source=source, stems=stems), by_vector)
    best = both.orderBy(F.desc("rrf_score"), "chunk_hash").limit(max(KEPT, limit)).collect()  # 40 rows
    texts = {r["chunk_hash"]: r["chunk_text"] for r in store.table("chunk").where(F.col("chunk_hash").isin([r["chunk_hash"] for r in best])).collect()} if best else {}
    ranked, why = reranked([(r["chunk_hash"], float(r["rrf_score"]), texts.get(r["chunk_hash"], "")) for r in best], reranker)
    ranked = ranked[:limit]
    method = "bm25+vector→rrf" + ("" if why else "→rerank")
    rows = [(h, i, s, texts.get(h, "")) for i, (h, s) in enumerate(ranked, 1)]
    shown = store.spark.createDataFrame(rows, "chunk_hash string, rank long, score double, chunk_text string")
    at = first_placements(inside, [h for h, _ in ranked])
    first = F.element_at("few", 1)
    return F.broadcast(shown).join(at, "chunk_hash").select(
        "rank", "chunk_hash", "score", first["source"].alias("source"), first["doc_id"].alias("doc_id"), first["ordinal"].alias("ordinal"),
        F.transform(F.slice("few", 2, SHOWN), lambda p: p["doc_id"]).alias("also_at"), "also_at_total",
        F.when(F.length("chunk_text") <= snippet, F.col("chunk_text")).otherwise(F.concat(F.substring("chunk_text", 1, snippet), F.lit("…"))).alias("snippet"),
        F.lit(method).alias("method"), F.lit(why).cast("string").alias("no_rerank"),
    )
