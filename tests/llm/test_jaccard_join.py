import itertools
import random

import numpy as np
import pytest

from geomill.llm import jaccard_join
from geomill.llm.jaccard_join import drop_near_duplicates, linked_classes, string_set
from geomill.llm.wordhash import word_hashes


def brute(rows, shingle, percent):
    sets = {i: string_set((t or "").encode(), shingle) for i, t in rows if i is not None}
    tree = {i: i for i in sets}

    def top(x):
        while tree[x] != x:
            x = tree[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        both = len(x & y)
        if x and y and both * 100 >= (len(x) + len(y) - both) * percent:
            p, q = sorted((top(a), top(b)))
            tree[q] = p
    return {i: (len(s), top(i)) for i, s in sets.items()}


def families(seed, count=12):
    """Texts edited here and there, some with a common beginning, and unlike texts with it."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(1500)]
    head = r.choices(vocabulary, k=25)
    out = []
    for f in range(count):
        base = (head if f % 3 == 0 else []) + r.choices(vocabulary, k=r.choice([8, 12, 30, 80, 200]))
        for _ in range(r.choice([3, 12, 30])):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 14))):
                k, how = r.randrange(len(w)), r.random()
                w[k : k + 1] = [r.choice(vocabulary)] if how < 0.5 else [] if how < 0.75 and len(w) > 1 else [w[k], r.choice(vocabulary)]
            out.append(" ".join(w))
    out += [" ".join(head + r.choices(vocabulary, k=r.randint(1, 60))) for _ in range(80)]
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("shingle", "percent", "block", "frequent"), [(3, 90, 1024, 64), (5, 80, 8, 3), (2, 70, 16, 4)])
def test_equals_brute_force(documents, monkeypatch, shingle, percent, block, frequent):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    rows = families(shingle)
    want = brute(rows, shingle, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in linked_classes(documents(rows), shingle=shingle, percent=percent).collect()}
    assert got == want


def test_odd_rows(documents, odd_rows):
    rows = [r for r in odd_rows if r[0] != 8]
    want = brute(rows, 3, 90)
    got = linked_classes(documents(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id not in (None, 8)} == want
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    stays = drop_near_duplicates(documents(odd_rows))
    assert stays.columns == documents(odd_rows).columns
    assert sorted(r.doc_id for r in stays.collect() if r.doc_id is not None) == [1, 2, 3, 4, 5, 6, 8, 9, 9, 10, 11, 13]


def test_empty(documents):
    assert linked_classes(documents([])).count() == 0
    assert drop_near_duplicates(documents([])).count() == 0


def test_bands_hold_similar_sizes():
    for percent in (70, 80, 90):
        bands = jaccard_join.Bands(percent)
        for a in range(1, 400):
            for b in range(a, a * 100 // percent + 1):
                assert bands.of(b) - bands.of(a) in (0, 1)


@pytest.mark.parametrize("percent", [70, 80, 90])
def test_similar_sets_agree_in_enough_partitions(percent):
    r = random.Random(percent)
    bands = jaccard_join.Bands(percent)
    for _ in range(400):
        base = [r.getrandbits(64) for _ in range(r.choice([1, 5, 9, 10, 20, 60, 300]))]
        other = [x for x in base if r.random() > 0.12] + [r.getrandbits(64) for _ in range(r.randint(0, 1 + len(base) // 12))]
        a, b = (np.unique(np.array(s, np.uint64)) for s in (base, other))
        if not len(b) or not len(np.intersect1d(a, b)) * 100 >= len(np.union1d(a, b)) * percent:
            continue
        if len(a) == len(b) and (a == b).all():
            continue
        band = max(bands.of(len(a)), bands.of(len(b)))
        k, n = bands.parameters(band)
        assert k and (bands.sketch(a, band) == bands.sketch(b, band)).sum() >= jaccard_join.SECOND * n - k
        signs = [{s for x, _, found, *_ in bands.signatures(own) if x == band for s in found.tolist()} for own in (a, b)]
        assert signs[0] & signs[1]
        # with any signatures left out, as many as one of the sets may lose, they still share one
        mine = {x: (spare, found, part, many) for x, spare, found, part, many in bands.signatures(a)}[band]
        spare, found, part, many = mine
        gone, lost = set(), 0
        for p in r.sample(sorted(set(part.tolist()) - {-1}), len(set(part.tolist()) - {-1})):
            own = [s for s, q in zip(found.tolist(), part.tolist(), strict=True) if q == p]
            out = r.sample(own, r.randint(1, len(own)))
            price = int(jaccard_join._price(np.array(len(own)), 0) - jaccard_join._price(np.array(len(own)), len(out)))
            if lost + price <= spare:
                gone, lost = gone | set(out), lost + price
        assert spare < 0 or (signs[0] & signs[1]) - gone


def test_partitions_stay_few():
    """However small the sets, there are at most a few times k partitions."""
    for percent in (70, 80, 90):
        bands = jaccard_join.Bands(percent)
        for size in range(1, 3000):
            k, n = bands.parameters(bands.of(size))
            assert not k or n <= 2 * k + 2


def test_sets_in_one_place_sign_together():
    """Sets whose elements all lie in one partition are found too."""
    bands = jaccard_join.Bands(80)
    a = np.sort(np.arange(60, dtype=np.uint64) + np.uint64(7 << 40))
    b = np.sort(np.r_[a[3:], a[-1] + np.uint64(9)])
    signs = [{s for _, _, found, *_ in bands.signatures(own) for s in found.tolist()} for own in (a, b)]
    assert signs[0] & signs[1]


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("size", [16, 256, 2048, 4096])
def test_long_words_of_the_same_letters_differ(spark, documents, size):
    word = thue_morse(size)
    other = word.translate(str.maketrans("ab", "ba"))
    assert len({*np.concatenate(word_hashes([word.encode(), other.encode(), (word[::-1] + "c").encode()])).tolist()}) == 3
    rows = [(1, word), (2, other), (3, word.upper() + " ")]
    assert {r.doc_id: r.component_id for r in linked_classes(documents(rows)).collect()} == {1: 1, 2: 2, 3: 1}
    assert {r.doc_id for r in drop_near_duplicates(documents(rows)).collect()} == {1, 2}


def test_equal_hashes_are_confirmed_on_texts(spark):
    """Sets whose hashes are equal though their texts aren't; and equal sets of different words."""
    texts = {1: "a b c d", 2: "e f g h", 3: "A  b c d", 4: "e f g h", 5: "x x x x", 6: "x x x x x", 7: "x x x x"}
    digest = jaccard_join._words_digest
    sets = spark.createDataFrame([(i, 1 if i < 5 else 2, 9, digest(t.encode())) for i, t in texts.items()], "id long, h1 long, h2 long, words binary")
    rows = spark.createDataFrame([(i, t.encode()) for i, t in texts.items()], "id long, text binary")
    assert {(r.a, r.b) for r in jaccard_join._equal(sets, rows, 3, 90).collect()} == {(3, 1), (4, 2), (7, 5), (6, 5)}
