"""Near duplicates against all pairs by brute force, and the sampler against the similarity it must meet."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import no_rows, texts_of
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ledgerlark.llm import near_duplicates as near


def plain_groups(rows, threshold=0.8):
    """doc_id's class, group and links, from all pairs of distinct word sequences that share a shingle."""
    lower = lambda t: t.translate({c: c + 32 for c in range(65, 91)})
    words = [tuple(re.findall(r"[^\x20\x09-\x0D]+", lower(t))) for _, t in rows]
    grams = {w: Counter(w[i : i + 5] for i in range(len(w) - 4)) if len(w) >= 5 else Counter([w]) for w in set(words) if w}
    df = Counter(g for w in words if w for g in grams[w])
    weight = {g: float(near.idf_weight(np.array([n], float), len(rows))[0]) for g, n in df.items()}
    total = {w: sum(c * weight[g] for g, c in gs.items()) for w, gs in grams.items()}
    holders = {}
    for w, gs in grams.items():
        for g in gs:
            holders.setdefault(g, []).append(w)
    root, links = {w: w for w in grams}, Counter()

    def find(w):
        while root[w] != w:
            w = root[w]
        return w

    for a, b in {(a, b) for ws in holders.values() for a in ws for b in ws if a < b}:
        both = sum(min(c, grams[b][g]) * weight[g] for g, c in grams[a].items() if g in grams[b])
        if both / (total[a] + total[b] - both) >= threshold:
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    least = lambda ids: min(ids, key=lambda i: (i is not None, i))
    ids, groups = {}, {}
    for (i, _), w in zip(rows, words):
        if w:
            ids.setdefault(w, []).append(i)
            groups.setdefault(find(w), []).append(i)
    for (i, _), w in zip(rows, words):
        yield (i, least(ids[w]), least(groups[find(w)]), len(ids[w]), len(groups[find(w)]), links[w]) if w else (i, i, i, 1, 1, 0)


COLUMNS = ("doc_id", "class_id", "group_id", "class_size", "group_size")


def check(docs):
    want = sorted((w[:5] for w in plain_groups(texts_of(docs))), key=repr)
    got = near.near_duplicates(docs)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=repr) == want


def test_documents(documents):
    check(documents)


def test_awkward(awkward):
    check(awkward)
    assert near.near_duplicates(no_rows(awkward)).count() == 0


@pytest.mark.parametrize("part", [near.PART, 8])
def test_groups_of_near_copies(spark, monkeypatch, part):
    """Groups of edited copies, small and large, beside texts that share one passage; bands in one part and in many."""
    monkeypatch.setattr(near, "PART", part)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage, rows = [word() for _ in range(40)], []
    for size in (2, 3, 5, 60):
        base = [word() for _ in range(150)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(150)] = word()
            rows.append(" ".join(copy))
    rows += [" ".join([word() for _ in range(60)] + passage) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in near.near_duplicates(docs).collect()}
    assert [w[0] for w in plain_groups(list(enumerate(rows))) if got[w[0]]["group_id"] != w[2]] == []


def test_samples_meet_similarity():
    rng = np.random.default_rng(1)
    h = np.sort(rng.integers(0, 2**63, 400).astype(np.uint64))
    w = rng.uniform(1, 5, 400)
    a, b = h[:300], h[60:]
    wb = w[60:] * np.where(np.arange(340) % 3 == 0, 1.3, 1.0)
    sim = near.weighted_jaccard((a, w[:300], w[:300].sum()), (b, wb, wb.sum()))
    got = (near.weighted_samples(a, w[:300], 2000) == near.weighted_samples(b, wb, 2000)).mean()
    assert abs(got - sim) < 0.04


def test_codec_of_hash_ranges():
    h = np.sort(np.random.default_rng(2).integers(0, 2**63, 1000).astype(np.uint64))
    assert (near._unpack(near._pack(h)) == h).all() and len(near._unpack(near._pack(h[:0]))) == 0


def test_no_pair_of_a_band_is_lost_to_its_samples():
    """Pairs a little above the threshold that share a band are all hopeful."""
    rng, shared = np.random.default_rng(5), 0
    for _ in range(1500):
        h = np.sort(rng.integers(0, 2**63, 111).astype(np.uint64))
        got = np.stack([near.weighted_samples(s, np.ones(100)) for s in (h[:100], h[11:])])  # 89 of 111
        agree = (got[0] == got[1]).reshape(near.BANDS, near.ROWS).all(axis=1)
        if agree.any():
            shared += 1
            codes = np.stack([np.arange(near.BANDS), np.where(agree, np.arange(near.BANDS), 99)]).astype(np.uint32)
            part = near._Part((got & np.uint64(255)).astype(np.uint8), codes, np.full(2, 100.0), np.arange(2), np.zeros(2, int), int(agree.argmax()))
            assert len(near._all_hopeful(part, near.THRESHOLD)[0]) == 1
    assert shared > 1400


def test_blocks_of_one_content(spark):
    """Equal blocks of two tasks, and of one task, have names of their own; a task run again names them alike."""
    schema = to_arrow_schema(StructType.fromDDL(near.SENT.format(id="long")))

    def names(partition):
        block = near._Block(1, 0, partition)
        for _ in range(2):
            block.add(7, "a text of a few words that two tasks read")
            yield block.rows(schema, schema.field("doc_id").type).column("block")[0].as_py()

    assert len({*names(0), *names(1)}) == 4 and [*names(1)] == [*names(1)]
