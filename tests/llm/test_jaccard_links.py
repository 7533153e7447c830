"""The n-gram Jaccard join where signatures fail: few n-grams, and families of half-similar texts."""

import random

import numpy as np
import pyarrow as pa
import pytest
from brute import doc_frame, jaccard_components
from pyspark.sql import functions as F

from spanmill.llm import components, jaccard
from spanmill.llm.tasks import in_arrow
from spanmill.session import small_copy

PAIRS = 20_000


def words(draw, n):
    return ["%x" % draw.getrandbits(48) for _ in range(n)]


def test_small_pairs_at_the_threshold_are_all_linked(spark):
    """8 of 10 n-grams in common, 9 of 11, 12 of 15, 16 of 20: in front, behind, or on both sides."""
    draw = random.Random(8)
    docs = []
    for small, large in ((8, 10), (9, 11), (12, 15), (16, 20)):
        for _ in range(PAIRS):
            text, more = words(draw, small + 4), words(draw, large - small)
            cut = draw.randint(0, len(more))
            docs += [" ".join(text), " ".join([*more[:cut], *text, *more[cut:]])]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").repartition(16)
    apart = jaccard.jaccard_classes(frame).filter("component_id <> doc_id - pmod(doc_id, 2)")
    assert apart.count() == 0


@pytest.mark.parametrize("few,leaders", [(24, 256), (4, 5)])
def test_families_equal_all_pairs(spark, monkeypatch, few, leaders):
    """Texts of one template with so many changes that some pairs are links and most are not, copies among them."""
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "LEADERS", leaders)
    draw = random.Random(3)
    template = words(draw, 150)
    texts = []
    for k in range(260):
        text = list(template)
        for at in draw.sample(range(150), draw.randint(1, 7)):
            text[at] = words(draw, 1)[0]
        texts.append(" ".join(text[draw.randint(0, 12) : 150 - draw.randint(0, 12)]))
    texts += texts[:40] + [" ".join(words(draw, 40) + template[:60]) for _ in range(60)] + [None, "", "one two"]
    docs = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_classes(doc_frame(spark, docs)).collect()}
    assert got == jaccard_components(docs)


def test_parity_bits_never_exceed_the_difference(spark):
    draw = random.Random(5)
    base = words(draw, 80)
    rows = [(k, " ".join(base[: 80 - k] + words(draw, k))) for k in range(0, 60, 7)]
    bits = {r["node"]: r["bits"] for r in jaccard._parities(spark.createDataFrame(rows, "node bigint, text string"), 5).collect()}
    grams = {k: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for k, t in rows}
    for a in grams:
        for b in grams:
            apart = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(bits[a], bits[b], strict=True))
            assert apart <= len(grams[a] ^ grams[b]) and (a == b) == (apart == 0)


def test_families_are_judged_by_differences_from_a_pivot(spark):
    """What a family has in common, the pivot's own words too, makes no key; one comparison for each set is left."""
    draw = random.Random(7)
    template = words(draw, 100)
    rows = []
    for k in range(120):
        text = list(template)
        for at in draw.sample(range(100), 4):
            text[at] = words(draw, 1)[0]
        rows.append((k, " ".join(text)))
    sets = jaccard._ranked_sets(spark.createDataFrame(rows, "node bigint, text string"), 5)
    family = sets.selectExpr("1L AS signature", "node", "cast(size(grams) AS bigint) AS size", "node AS class")
    pivots = spark.createDataFrame([(1, 0)], "signature bigint, pivot bigint")
    apart = jaccard._differences(family, pivots, sets, 80)
    grams = {k: {tuple(t.split()[i : i + 5]) for i in range(96)} for k, t in rows}
    assert {r["node"]: r["distance"] for r in apart.collect()} == {k: len(grams[k] ^ grams[0]) for k in grams}
    pairs, settled = jaccard._settled_by_nearest(apart)
    assert pairs.count() < 120
    assert jaccard._difference_keys(settled, 80).count() < 120 * 96


def test_rounds_read_the_documents_no_more(spark, monkeypatch):
    """Families take several rounds; all documents are read for the first pairs and once for what is left, and classes
    are found once for each table of links."""
    reads, tables = [], []
    documents_of, components = jaccard._documents_of, jaccard.components
    monkeypatch.setattr(jaccard, "FEW", 4)
    monkeypatch.setattr(jaccard, "LEADERS", 5)
    monkeypatch.setattr(jaccard, "_documents_of", lambda *a: reads.append(1) or documents_of(*a))
    monkeypatch.setattr(jaccard, "components", lambda links: tables.append(links.count()) or components(links))
    draw = random.Random(3)
    template = words(draw, 150)
    texts = []
    for k in range(200):
        text = list(template)
        for at in draw.sample(range(150), draw.randint(1, 7)):
            text[at] = words(draw, 1)[0]
        texts.append(" ".join(text[draw.randint(0, 12) : 150 - draw.randint(0, 12)]))
    docs = list(enumerate(texts))
    jaccard.jaccard_links(doc_frame(spark, docs))
    assert len(reads) <= 3
    assert len(set(tables)) == len(tables)


def test_batches_are_bounded_by_bytes(spark):
    """Rows of 1 MB come some at a time, not 64 MB at once."""
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["size"])

    rows = spark.range(0, 48, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    assert in_arrow(rows, run, "size bigint").agg(F.max("size")).first()[0] < 24 << 20


def test_small_copies_come_as_one_partition(spark):
    """All rows stay; a table above the bound stays dealt out."""
    rows = spark.range(0, 1000, 1, 40)
    small, large = small_copy(rows, 1000), small_copy(rows, 999)
    assert (small.rdd.getNumPartitions(), small.count(), large.count()) == (1, 1000, 1000)
    assert large.rdd.getNumPartitions() > 1


def nested_texts(draw):
    """Texts of one template that all share most of their changes, so that a round with a pivot only takes the pivot away."""
    template, changes = words(draw, 150), words(draw, 60)
    texts = []
    for k in range(70):
        text = list(template)
        for at in draw.sample(range(60), 42):
            text[2 * at] = changes[at]
        for at in draw.sample(range(150), k % 4):
            text[at] = words(draw, 1)[0]
        texts.append(" ".join(text))
    return texts + texts[:10]


@pytest.mark.parametrize("settled,most", [(4096, 0), (4, 6)])
def test_bounded_families_are_settled_without_rounds(spark, monkeypatch, settled, most):
    """No differences from a pivot are written where tasks hold the family; larger families go by rounds as long as those help."""
    rounds, differences = [], jaccard._differences
    monkeypatch.setattr(jaccard, "FEW", 4)
    monkeypatch.setattr(jaccard, "SETTLED_SETS", settled)
    monkeypatch.setattr(jaccard, "_differences", lambda *a: rounds.append(1) or differences(*a))
    draw = random.Random(11)
    docs = list(enumerate(nested_texts(draw) + nested_texts(draw)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_classes(doc_frame(spark, docs)).collect()}
    assert got == jaccard_components(docs)
    assert bool(rounds) == bool(most) and len(rounds) <= most


def test_one_task_links_what_all_pairs_link():
    """Sets around the threshold: as many links as classes that all pairs join, whatever the signs of their hashes."""
    draw = np.random.default_rng(2)
    for _ in range(20):
        base = draw.integers(-(2**63), 2**63 - 1, 40)
        sets = [set(base[draw.random(40) < 0.93].tolist()) | set(draw.integers(-(2**63), 2**63 - 1, 2).tolist()) for _ in range(60)]
        grams, sizes = np.concatenate([np.array(sorted(s)) for s in sets]), np.array([len(s) for s in sets])
        before = draw.integers(0, 50, 60)
        links = jaccard._family_links(np.arange(60), before.copy(), sizes, grams, 80)
        found, expected = before.tolist(), before.tolist()
        for a, b in links:
            assert found[a] != found[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
            found = [found[a] if c == found[b] else c for c in found]
        for a in range(60):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    expected = [expected[a] if c == expected[b] else c for c in expected]
        assert [found.index(c) for c in found] == [expected.index(c) for c in expected]


def test_components_of_one_task_equal_those_of_rounds(spark, monkeypatch):
    draw = random.Random(4)
    pairs = [(draw.randint(-400, 400), draw.randint(-400, 400)) for _ in range(420)] + [(k, k + 1) for k in range(1000, 1300)] + [(7, 7)]
    links = spark.createDataFrame(draw.sample(pairs, len(pairs)), "a bigint, b bigint")
    one = components.components(links)
    assert components.components(links.limit(0)).count() == 0
    monkeypatch.setattr(components, "ONE_TASK", 0)
    assert sorted(one.collect()) == sorted(components.components(links).collect())
