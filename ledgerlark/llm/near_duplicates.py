"""Operator 9: near duplicates by consistent weighted sampling over TF-IDF shingles.

1. Tasks gather shingle hashes of some million shingles into a block, sorted, and send them to hash ranges: one entry
   per block and shingle with the number of documents, however many of them hold it.
2. A hash range knows the document frequency of its shingles and answers each block, but only about shingles that
   other texts hold too.  A text most of whose weight no other text shares cannot reach the threshold and ends here.
3. The rest is sampled (improved consistent weighted sampling) and banded; a pair belongs to the first band that it
   shares.  A first turn shrinks the work: bands are dealt into parts of bounded size, each text is verified against
   the likeliest of its part by the exact weighted Jaccard similarity, and linked texts form groups.
4. The second turn is whole: in each band that still holds several groups, all texts outside its largest group meet
   all others, part by part, and every pair across groups that the samples do not rule out is verified where the part
   lies.  A part gives out only links that join groups of it, so rows are linear in a band; no pair is capped.  Work
   beyond a band's size is only for texts outside its largest group.

Equal texts are one class from the start: they are never compared, and all take the group of their class.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import M64, ODD, SLICE_ROWS, WORD, SpanHasher, cut, gram_hashes, hash_words, mixed, texts

WORDS = 5
THRESHOLD = 0.8
#: A shingle weighs its count times 1 + IDF * log((N+1)/(df+1)) / log(N+1).  The share of IDF is small, as a full one
#: lets the few rare shingles of an edit outweigh all that a large group of near copies has in common.
IDF = 0.25
BANDS, ROWS = 16, 3
SAMPLES = BANDS * ROWS
#: Pairs of a band whose samples agree less often than this are not verified.  Given the three of the band, a pair at the
#: threshold misses it with chance 1.4e-7 (21 or more of 45 are left to agree); the bands miss such a pair with chance 1e-5.
HOPELESS = 0.5
#: Bands with more members are dealt into parts of this size, anew in every band.
PART = 512
#: Likewise bands whose weighted sets take more bytes than this, in the turn that moves them.
PART_BYTES = 16 << 20
BLOCK_SHINGLES = 1 << 20
BLOCK_TEXTS = 60_000
BUCKET_SHINGLES = 1 << 19
MANY = 0xFFFF
TABLE = 1 << 16

SENT = "kind int, block long, bucket int, doc_id {id}, key binary, hash binary, docs binary, text binary, count binary"
SETS = "block long, doc_id {id}, key binary, total double, hash binary, weight binary"


def _planes(a: np.ndarray) -> bytes:
    """Bytes of an integer array, most significant bytes of all values first, so that a codec sees their likeness."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def _unplaned(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _pack(h: np.ndarray) -> bytes:
    return _planes(np.diff(h, prepend=np.uint64(0)))


def _unpack(raw: bytes) -> np.ndarray:
    return np.cumsum(_unplaned(raw, np.uint64))


def shingles(text: str, words: int = WORDS) -> tuple[bytes | None, np.ndarray, np.ndarray]:
    """Key of a text's word sequence (A-Z in lower case), its distinct shingle hashes and their counts.

    A text of fewer words is one shingle; one without words has no key and no shingles.
    """
    x = hash_words(WORD.findall(text.encode().lower().decode()))
    if not len(x):
        return None, np.empty(0, np.uint64), np.empty(0, np.int64)
    a, b = SpanHasher(x).spans(np.zeros(1, np.int64), np.array([len(x)]))
    h, n = np.unique(gram_hashes(x, words) if len(x) >= words else gram_hashes(x, len(x)) ^ np.uint64(len(x)), return_counts=True)
    return a.tobytes() + b.tobytes(), h, n


def idf_weight(df: np.ndarray, documents: int) -> np.ndarray:
    return 1 + IDF * np.log((documents + 1) / (df + 1)) / math.log(documents + 2)


class _Block:
    """Shingles of distinct texts on their way to the hash ranges."""

    def __init__(self, buckets: int, mask: int, partition: int = 0) -> None:
        self.buckets, self.mask = buckets, np.uint64(mask)
        self.partition, self.turn = partition, 0
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.copies: list[int] = []
        self.hashes: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.ids: list = []
        self.keys: list[bytes | None] = []
        self.size = 0

    def add(self, doc_id, text: str) -> None:
        key, h, n = shingles(text)
        self.ids.append(doc_id)
        self.keys.append(key)
        if key is None:
            return
        at = self.index.setdefault(key, len(self.copies))
        if at < len(self.copies):
            self.copies[at] += 1
            return
        self.copies.append(1)
        self.hashes.append(h & ~self.mask)
        self.counts.append(n)
        self.size += len(h)

    def full(self) -> bool:
        return self.size >= BLOCK_SHINGLES or len(self.copies) >= BLOCK_TEXTS or len(self.ids) >= 4 * BLOCK_TEXTS

    def rows(self, schema: pa.Schema, id_type: pa.DataType) -> pa.RecordBatch:
        """All rows of the block; its name is made of its content and place, so that a task run again names it alike."""
        columns: dict[str, list] = {f.name: [] for f in schema}

        def put(**values) -> None:
            for name, column in columns.items():
                column.append(values.get(name))

        sizes = [len(h) for h in self.hashes]
        seed = np.array([self.partition, self.turn, len(self.ids), self.size, *(int.from_bytes(k[:8], "little") for k in self.index)], np.uint64)
        block = int(mixed(np.bitwise_xor.reduce(mixed(seed * ODD + np.arange(len(seed), dtype=np.uint64)), keepdims=True))[0] ^ np.uint64(hash_words([repr(self.ids[0])])[0])) - (1 << 63)
        if sizes:
            h = np.concatenate(self.hashes)
            order = np.argsort(h, kind="stable")
            h, n = h[order], np.concatenate(self.counts)[order]
            text = np.repeat(np.arange(len(sizes)), sizes)[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            run = np.diff(np.append(first, len(h)))
            docs = np.add.reduceat(np.asarray(self.copies)[text], first)
            single = run == 1
            sent_text = np.where(single, text[first], MANY).astype(np.uint16)
            sent_count = np.where(single, n[first], 0).astype(np.uint32)
            bucket = self.bucket(h[first])
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(first)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                put(kind=0, block=block, bucket=int(bucket[a]), hash=_pack(h[first[a:b]]), docs=_planes(docs[a:b].astype(np.uint32)), text=_planes(sent_text[a:b]), count=_planes(sent_count[a:b]))
            shared = np.repeat(~single, run)
            totals = np.array([c.sum() for c in self.counts], np.int64)
            put(kind=1, block=block, bucket=block % self.buckets, key=b"".join(self.index), hash=_pack(h[shared]), docs=np.stack([totals, np.asarray(self.copies)]).tobytes(), text=_planes(text[shared].astype(np.uint16)), count=_planes(n[shared].astype(np.uint32)))
        for doc_id, key in zip(self.ids, self.keys):
            put(kind=2, block=block, bucket=block % self.buckets, doc_id=doc_id, key=key)
        self.turn += 1
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns.values(), schema)], schema=schema)

    def bucket(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)


def _answer(table: pa.Table) -> pa.Table:
    """Document frequencies of one hash range, told to each block for the shingles that other texts hold; other rows pass."""
    mine = table.filter(pc.equal(table.column("kind"), 0))
    rest = table.filter(pc.not_equal(table.column("kind"), 0))
    if not mine.num_rows:
        return rest
    h = [_unpack(v) for v in mine.column("hash").to_pylist()]
    source = np.repeat(np.arange(len(h)), [len(v) for v in h])
    h = np.concatenate(h)
    docs, text, count = (np.concatenate([_unplaned(v, t) for v in mine.column(c).to_pylist()]) for c, t in (("docs", np.uint32), ("text", np.uint16), ("count", np.uint32)))
    order = np.argsort(h, kind="stable")  # then by block, as the entries stand
    ho = h[order]
    first = np.flatnonzero(np.concatenate([[True], ho[1:] != ho[:-1]]))
    run = np.diff(np.append(first, len(ho)))
    df = np.repeat(np.add.reduceat(docs[order].astype(np.int64), first), run)
    repeated = (np.repeat(run, run) > 1) | (text[order] == MANY)
    order, df = order[repeated], df[repeated]
    back = np.argsort(source[order], kind="stable")
    order, df = order[back], df[back]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(source[order])) + 1, [len(order)]]).tolist() if len(order) else [0]
    blocks = mine.column("block").to_pylist()
    told = [(blocks[source[order[a]]], order[a:b], df[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    n = len(told)
    return pa.concat_tables([rest, pa.table([
        pa.array([0] * n, pa.int32()), pa.array([b for b, _, _ in told], pa.int64()), pa.array([0] * n, pa.int32()), pa.nulls(n, table.schema.field("doc_id").type), pa.nulls(n, pa.binary()),
        pa.array([_pack(h[o]) for _, o, _ in told], pa.binary()), pa.array([_planes(np.minimum(d, 0xFFFFFFFF).astype(np.uint32)) for _, _, d in told], pa.binary()),
        pa.array([_planes(text[o]) for _, o, _ in told], pa.binary()), pa.array([_planes(count[o]) for _, o, _ in told], pa.binary()),
    ], schema=table.schema)])


def _sets(documents: int, threshold: float, id_type: pa.DataType):
    """Weighted shingle sets of a block's texts that may have a partner, and the (doc_id, key) of all its documents."""
    schema = pa.schema([("block", pa.int64()), ("doc_id", id_type), ("key", pa.binary()), ("total", pa.float64()), ("hash", pa.binary()), ("weight", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind")
        named = table.filter(pc.equal(kind, 2)).select(["block", "doc_id", "key"])
        for name in ("total", "hash", "weight"):
            named = named.append_column(name, pa.nulls(named.num_rows, schema.field(name).type))
        home = table.filter(pc.equal(kind, 1)).to_pylist()
        told = table.filter(pc.equal(kind, 0))
        if not home or not told.num_rows:
            return named.cast(schema)
        totals, copies = np.frombuffer(home[0]["docs"], np.int64).reshape(2, -1)
        h = np.concatenate([_unpack(v) for v in told.column("hash").to_pylist()])
        df, text, count = (np.concatenate([_unplaned(v, t) for v in told.column(c).to_pylist()]) for c, t in (("docs", np.uint32), ("text", np.uint16), ("count", np.uint32)))
        order = np.argsort(h)
        h, df, text, count = h[order], df[order], text[order], count[order]
        own = _unpack(home[0]["hash"])
        at = np.searchsorted(h, own)
        one = text != MANY
        h, df, text, count = (
            np.concatenate([h[one], own]), np.concatenate([df[one], df[at]]),
            np.concatenate([text[one], _unplaned(home[0]["text"], np.uint16)]), np.concatenate([count[one], _unplaned(home[0]["count"], np.uint32)]),
        )
        weight = count * idf_weight(df.astype(np.float64), documents)
        shared = np.bincount(text, weight, len(totals))
        alone = (totals - np.bincount(text, count, len(totals))) * idf_weight(copies.astype(np.float64), documents)
        total = shared + alone
        hopeful = shared >= threshold * total * (1 - 1e-9)
        order = np.lexsort((h, text))
        order = order[hopeful[text[order]]]
        cuts = np.searchsorted(text[order], np.arange(len(totals) + 1))
        which = np.flatnonzero(hopeful & (shared > 0)).tolist()
        keys = home[0]["key"]
        return pa.concat_tables([named.cast(schema), pa.table([
            pa.array([home[0]["block"]] * len(which), pa.int64()), pa.nulls(len(which), id_type), pa.array([keys[16 * i : 16 * i + 16] for i in which], pa.binary()), pa.array(total[which]),
            pa.array([h[order[cuts[i] : cuts[i + 1]]].tobytes() for i in which], pa.binary()), pa.array([weight[order[cuts[i] : cuts[i + 1]]].tobytes() for i in which], pa.binary()),
        ], schema=schema)])

    return run


_tables: list[np.ndarray] = []


def _random_tables() -> list[np.ndarray]:
    """Gamma(2,1) rates, uniform shifts and log Gamma(2,1) numerators, shared by all samples through mixed indices."""
    if not _tables:
        u = (mixed(np.arange(1, 5 * TABLE + 1, dtype=np.uint64) * ODD).astype(np.float64) + 1) / 2.0**64
        u = np.clip(u.reshape(5, TABLE), 1e-12, 1 - 1e-12)
        _tables.extend([-np.log(u[0] * u[1]), u[2], np.log(-np.log(u[3] * u[4]))])
    return _tables


def weighted_samples(h: np.ndarray, w: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """Improved consistent weighted samples of one weighted set: a 64-bit value each, equal with the weighted Jaccard similarity's chance."""
    rate, shift, top = _random_tables()
    log_w, out = np.log(w), np.empty(samples, np.uint64)
    for s, seed in enumerate(np.arange(1, samples + 1, dtype=np.uint64) * ODD):
        i = (mixed(h + seed) >> np.uint64(48)).astype(np.int64)
        r = rate[i]
        t = np.floor(log_w / r + shift[i])
        least = np.argmin(top[i] - r * (t - shift[i] + 1))
        out[s] = int(h[least]) ^ (int(t[least]) * int(ODD) & M64)
    return mixed(out)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray, float], b: tuple[np.ndarray, np.ndarray, float]) -> float:
    """Of two sets (sorted hashes, weights, total weight, which also counts what no other text holds)."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0]
    both = float(np.minimum(a[1][same], b[1][at[same]]).sum())
    return both / (a[2] + b[2] - both)


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            m = part.num_rows
            got = np.stack([weighted_samples(np.frombuffer(h, np.uint64), np.frombuffer(w, np.float64)) for h, w in zip(part.column("hash").to_pylist(), part.column("weight").to_pylist())])
            band = np.zeros((m, BANDS), np.uint64)
            for r in range(ROWS):
                band = mixed(band * ODD + got.reshape(m, BANDS, ROWS)[:, :, r] + np.arange(BANDS, dtype=np.uint64))
            signs = [bytes(r) for r in (got & np.uint64(255)).astype(np.uint8)]
            codes = [r.tobytes() for r in (band & np.uint64(0xFFFFFFFF)).astype(np.uint32)]
            columns = [part.column("key"), part.column("total"), pa.array([2 * len(h) for h in part.column("hash").to_pylist()], pa.int64()), pa.array(signs, pa.binary()), pa.array(codes, pa.binary()), pa.array(list(band.view(np.int64)), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "total", "bytes", "sign", "codes", "bands"])


class _Part(NamedTuple):
    """Texts of a part of one band: signatures, codes of all bands, totals, numbered groups, side and the band's place."""

    signs: np.ndarray
    codes: np.ndarray
    totals: np.ndarray
    roots: np.ndarray
    side: np.ndarray
    place: int


def _hopeful(p: _Part, threshold: float) -> np.ndarray:
    """How alike the samples of each two texts are; 0 for pairs of one group, pairs of an earlier band and hopeless ones."""
    alike = (p.signs[:, None, :] == p.signs[None, :, :]).mean(axis=2)
    earlier = (p.codes[:, None, : p.place] == p.codes[None, :, : p.place]).any(axis=2)
    open_ = (p.roots[:, None] != p.roots) & (np.minimum(p.totals[:, None], p.totals) >= threshold * np.maximum(p.totals[:, None], p.totals))
    return np.where(open_ & ~earlier & (alike >= HOPELESS), alike, 0.0)


def _likeliest(p: _Part, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in a part: each text with the most alike one."""
    alike = _hopeful(p, threshold)
    a, top = np.arange(len(alike)), alike.argmax(axis=1)
    some = alike[a, top] > 0
    return a[some], top[some]


def _all_hopeful(p: _Part, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places that are worth verifying, the most alike first; of two different parts, those across them."""
    alike = np.triu(_hopeful(p, threshold), 1)
    if p.side.any():
        alike = np.where(p.side[:, None] != p.side, alike, 0.0)
    a, b = np.nonzero(alike)
    order = np.argsort(-alike[a, b], kind="stable")
    return a[order], b[order]


def _joining(a: np.ndarray, b: np.ndarray, sets: list, roots: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Those of the pairs that are links and join two groups of the part; a pair within a group is not looked at."""
    up = list(range(len(roots)))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    out = []
    for i, j in zip(a.tolist(), b.tolist()):
        x, y = find(int(roots[i])), find(int(roots[j]))
        if x != y and weighted_jaccard(sets[i], sets[j]) >= threshold:
            up[x] = y
            out.append((i, j))
    return out


PAIRS, WORTH, JOINS = "pairs", "worth", "joins"


def _compared(kind: str, threshold: float):
    """Over rows sorted by (band, part), one part held at a time, one of three results.

    PAIRS: (key, key2) of the likeliest pairs.  WORTH: the rows of texts with any pair worth verifying.
    JOINS: (key, key2) of the links that join groups, verified in place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in itertools.chain(batches, (None,)):
            table = pa.Table.from_batches([b for b in (carry, batch) if b is not None]) if carry is not None or batch is not None else None
            if table is None or not table.num_rows:
                continue
            rows = table.combine_chunks().to_batches()[0]
            band, part = rows.column("band").to_numpy(), rows.column("part").dictionary_encode().indices.to_numpy()
            first = np.flatnonzero(np.concatenate([[True], (band[1:] != band[:-1]) | (part[1:] != part[:-1])]))
            end = np.append(first[1:], len(band))
            if batch is not None:  # the last part may go on
                carry = rows.slice(int(first[-1]))
                first, end = first[:-1], end[:-1]
            signs = np.frombuffer(b"".join(rows.column("sign").to_pylist()), np.uint8).reshape(-1, SAMPLES)
            codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint32).reshape(-1, BANDS)
            totals, roots = rows.column("total").to_numpy(), rows.column("root").dictionary_encode().indices.to_numpy()
            place, side = rows.column("place").to_numpy(), rows.column("side").to_numpy()
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i, j in zip(first.tolist(), end.tolist()):
                if j - i < 2:
                    continue
                p = _Part(signs[i:j], codes[i:j], totals[i:j], np.unique(roots[i:j], return_inverse=True)[1], side[i:j], int(place[i]))
                x, y = _likeliest(p, threshold) if kind == PAIRS else _all_hopeful(p, threshold)
                if kind == JOINS and len(x):
                    h, w = rows.column("hash").slice(i, j - i).to_pylist(), rows.column("weight").slice(i, j - i).to_pylist()
                    sets = [(np.frombuffer(u, np.uint64), np.frombuffer(v, np.float64), t) for u, v, t in zip(h, w, totals[i:j].tolist())]
                    x, y = np.array(_joining(x, y, sets, p.roots, threshold), np.int64).reshape(-1, 2).T
                a.append(x + i)
                b.append(y + i)
            a, b = np.concatenate(a), np.concatenate(b)
            if kind == WORTH:
                yield rows.select(["band", "part", "place", "side", "key", "total", "sign", "codes", "root"]).take(pa.array(np.unique(np.concatenate([a, b]))))
            else:
                yield pa.RecordBatch.from_arrays([rows.column("key").take(pa.array(x)) for x in (a, b)], names=["key", "key2"])

    return run


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for at in range(0, batch.num_rows, SLICE_ROWS):
                columns = [batch.slice(at, SLICE_ROWS).column(c).to_pylist() for c in ("hash", "weight", "total", "hash2", "weight2", "total2")]
                for ha, wa, ta, hb, wb, tb in zip(*columns):
                    a = np.frombuffer(ha, np.uint64), np.frombuffer(wa, np.float64), ta
                    b = np.frombuffer(hb, np.uint64), np.frombuffer(wb, np.float64), tb
                    keep.append(weighted_jaccard(a, b) >= threshold)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def components(links: DataFrame) -> DataFrame:
    """(key, root) of the connected components of (a, b): least labels spread along links and jump to their label's label."""
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("key"), F.least("a", "b").alias("root"))
    labels, changed = cut(labels, "labels"), True
    while changed:
        near = both.join(labels.select(F.col("key").alias("b"), "root"), "b").groupBy(F.col("a").alias("key")).agg(F.min("root").alias("near"))
        step = labels.join(near, "key").select("key", F.least("root", "near").alias("next"), "root")
        jump = step.select(F.col("key").alias("next"), F.col("next").alias("far"))
        new = cut(step.join(jump, "next").select("key", "root", F.least("next", "far").alias("new")), "labels")
        changed = bool(new.where("new <> root").limit(1).count())
        labels = new.select("key", F.col("new").alias("root"))
    return labels


MEMBER = "band long, part string, place int, side int, key binary, total double, sign binary, codes binary, root binary"


def _members(parts: DataFrame) -> DataFrame:
    return parts.select("band", F.col("part").cast("string").alias("part"), "place", "side", "key", "total", "sign", "codes", "root")


def _together(parts: DataFrame) -> DataFrame:
    return parts.repartition("band", "part").sortWithinPartitions("band", "part")


def _dealt(banded: DataFrame) -> DataFrame:
    """Each member of a band of several texts in one part of it."""
    bands = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    part = F.pmod(F.xxhash64("key", "band"), F.ceil(F.col("n") / PART))
    return _members(banded.join(bands, "band").withColumn("part", part).withColumn("side", F.lit(0)).withColumn("root", F.col("key")))


def _met(members: DataFrame) -> DataFrame:
    """Members of bands of several groups, as often as it takes for each one outside its band's largest group to meet all.

    A small band is one part.  A larger one has parts 0 .. r-1 of the rest and r .. r+b-1 of the largest group; each part
    of the rest meets itself, the other ones of the rest and each of the largest group.
    """
    sizes = members.groupBy("band", "root").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    bands = sizes.groupBy("band").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max(F.struct("n", "root", "bytes")).alias("body")).where("n > body.n")
    parts = lambda n, size: F.greatest(F.ceil(n / PART), F.ceil(size / PART_BYTES))
    body = F.col("body.n"), F.col("body.bytes")
    bands = bands.select("band", F.col("body.root").alias("body"), parts(F.col("n"), F.col("bytes")).alias("all"), parts(F.col("n") - body[0], F.col("bytes") - body[1]).alias("r"), parts(*body).alias("b"))
    rest, draw, small = F.col("root") != F.col("body"), F.xxhash64("key", "band"), F.col("all") <= 1
    own = F.when(small, 0).when(rest, F.pmod(draw, "r")).otherwise(F.col("r") + F.pmod(draw, "b"))
    last = F.when(small, 0).when(rest, F.col("r") + F.col("b") - 1).otherwise(F.col("r") - 1)
    spread = members.join(bands, "band").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    return _members(spread.withColumn("part", F.concat_ws("-", F.least("own", "other"), F.greatest("own", "other"))).withColumn("side", (F.col("own") > F.col("other")).cast("int")))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: class_id (least doc_id of equal texts), group_id (least doc_id of linked texts), sizes.

    Texts are equal if their words are, A-Z in lower case; they are linked if the weighted Jaccard similarity of their
    five-word shingles reaches the threshold.  Texts of fewer words are one shingle.  A null or empty text, or one of white space, has no words and stays alone: its ids are its
    own doc_id.  Repeated rows are equal texts and count in the sizes.  A null doc_id is the least of its class, like
    any other.  No rows give no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
    from pyspark.sql.types import StructType

    id_name = docs.schema["doc_id"].dataType.simpleString()
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    docs = texts(docs)
    documents, characters = docs.agg(F.count("*"), F.sum(F.length("text"))).first()
    buckets = max(1, math.ceil((characters or 0) / 6 / BUCKET_SHINGLES))
    mask = (1 << max(0, 16 - math.ceil(math.log2(buckets)))) - 1  # 48 bits are left within a hash range
    sent = StructType.fromDDL(SENT.format(id=id_name))
    sent_schema = to_arrow_schema(sent)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(buckets, mask, TaskContext.get().partitionId())
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    block.add(doc_id, text)
                    if block.full():
                        yield block.rows(sent_schema, id_type)
        if block.ids:
            yield block.rows(sent_schema, id_type)

    told = docs.mapInArrow(gather, sent).groupBy("bucket").applyInArrow(_answer, sent)
    sets = cut(told.groupBy("block").applyInArrow(_sets(documents, threshold, id_type), SETS.format(id=id_name)), "sets")
    named = sets.where("total is null").select("doc_id", "key", "block")
    # Of equal texts in several blocks one set is used: that of the least block.
    classes = cut(named.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("class_id"), F.min("block").alias("block"), F.count("*").alias("class_size"), F.max(F.col("doc_id").isNull()).alias("nameless")), "classes")
    classes = classes.withColumn("class_id", F.when(~F.col("nameless"), F.col("class_id"))).drop("nameless")
    own = sets.where("total is not null").select("key", "block", "total", "hash", "weight")
    sampled = cut(own.mapInArrow(_sample, "key binary, total double, bytes long, sign binary, codes binary, bands array<long>"), "samples").dropDuplicates(["key"])
    banded = cut(sampled.select("key", "total", "bytes", "sign", "codes", F.posexplode("bands").alias("place", "band")), "bands")

    def sets_of(keys: DataFrame) -> DataFrame:
        """One set per wanted text, that of its class's block; the narrow side finds the block, so that sets need not move."""
        wanted = keys.distinct().join(classes.select("key", "block"), "key")
        return cut(own.join(wanted, ["key", "block"]).dropDuplicates(["key"]).select("key", "total", "hash", "weight"), "used")

    pairs = _together(_dealt(banded)).mapInArrow(_compared(PAIRS, threshold), "key binary, key2 binary")
    pairs = cut(pairs.select(F.least("key", "key2").alias("a"), F.greatest("key", "key2").alias("b")).distinct(), "pairs")
    used = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("key")))
    left = used.select(F.col("key").alias("a"), "total", "hash", "weight")
    right = used.select(F.col("key").alias("b"), F.col("total").alias("total2"), F.col("hash").alias("hash2"), F.col("weight").alias("weight2"))
    links = cut(pairs.join(left, "a").join(right, "b").mapInArrow(_verified(threshold), "a binary, b binary"), "links")
    members = banded.join(components(links), "key", "left").withColumn("root", F.coalesce("root", "key"))
    worth = cut(_together(_met(members)).mapInArrow(_compared(WORTH, threshold), MEMBER), "worth")
    joins = _together(worth.join(sets_of(worth.select("key")).drop("total"), "key")).mapInArrow(_compared(JOINS, threshold), "key binary, key2 binary")
    links = links.unionByName(cut(joins.select(F.least("key", "key2").alias("a"), F.greatest("key", "key2").alias("b")), "links"))
    roots = components(links)
    rooted = classes.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    first = F.min(F.struct(F.col("class_id").isNotNull().alias("known"), F.col("class_id")))
    groups = rooted.groupBy("root").agg(first["class_id"].alias("group_id"), F.sum("class_size").alias("group_size"))
    full = rooted.join(groups, "root").select("key", "class_id", "class_size", "group_id", "group_size", F.lit(True).alias("named"))
    out = named.join(full, "key", "left")
    return out.select(
        "doc_id", *(F.when(F.col("named"), F.col(c)).otherwise(F.col("doc_id")).alias(c) for c in ("class_id", "group_id")),
        *(F.coalesce(F.col(c), F.lit(d)).cast("long").alias(c) for c, d in (("class_size", 1), ("group_size", 1))),
    )


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
